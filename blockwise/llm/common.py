"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

#: More rows than this are never broadcast by hint; Spark then plans a shuffled join.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text, null counting as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` agrees, and is faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """64 bits that stand for a text next to its doc_id."""
    return F.xxhash64(text)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written once and read back, with its number of rows."""
    df = stage(df)
    return df, df.count()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` written once; marked for broadcast only if it was found to have at most ``rows`` rows."""
    df, n = counted(df)
    return F.broadcast(df) if n <= rows else df


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id, written as text, leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))
