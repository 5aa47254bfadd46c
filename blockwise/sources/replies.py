"""Recogniser replies (JSON) to detections, and what could not be read to error rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwise import schemas


def parsed_replies(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Reply texts parsed against the declared schema; a text that is not JSON leaves ``corrupt`` set."""
    schema = T.StructType([*schemas.REPLY.fields, T.StructField("_corrupt", T.StringType())])
    parsed = replies.withColumn("_r", F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select(*[c for c in replies.columns if c != text], "_r.*").withColumnRenamed("_corrupt", "corrupt")


def read_replies(spark: SparkSession, path: str, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """JSON lines with one reply each and what it belongs to (``keys``, as texts).

    A line that is no JSON keeps the keys written in it; without a ``page_id`` it has the name of its file.
    """
    schema = T.StructType([*[T.StructField(k, T.StringType()) for k in keys], *schemas.REPLY.fields, T.StructField("corrupt", T.StringType())])
    read = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)

    def written(key: str) -> Column:
        return F.nullif(F.regexp_extract("corrupt", rf'"{key}"\s*:\s*"([^"]*)"', 1), F.lit(""))
    return read.withColumns({k: F.coalesce(F.col(k), written(k), *([F.input_file_name()] if k == "page_id" else [])) for k in keys})


def load_detections(replies: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block of the successful replies, in recogniser order (``ord`` from 1)."""
    good = replies.filter(F.col("success") & F.col("corrupt").isNull())
    rows = good.select(*keys, F.posexplode("blocks").alias("_pos", "b"),
                       F.col("container.canvas_size.width").alias("canvas_w"),
                       F.col("container.canvas_size.height").alias("canvas_h"),
                       F.col("container.is_isolated").alias("isolated"))

    def at(point: int, axis: int) -> Column:
        # a box of fewer than three points is no box
        return F.when(F.size("b.box") >= 3, F.get(F.get("b.box", F.lit(point)), F.lit(axis)))
    return rows.select(
        *keys, (F.col("_pos") + 1).alias("ord"), F.col("b.text").alias("txt"), F.col("b.conf").alias("conf"),
        F.coalesce("b.color", F.lit("Unknown")).alias("color"),
        at(0, 0).alias("x0"), at(0, 1).alias("y0"), at(1, 0).alias("x1"), at(1, 1).alias("y1"),
        at(2, 0).alias("x2"), at(2, 1).alias("y2"), "canvas_w", "canvas_h", "isolated")


def error_rows(replies: DataFrame, keys: list[str]) -> DataFrame:
    """One warning per reply that gave no blocks; the job goes on without it."""
    code = F.when(F.col("corrupt").isNotNull(), "UNREADABLE_REPLY").when(~F.coalesce("success", F.lit(False)), "RECOGNISER_FAILED")
    return replies.withColumn("code", code).filter(F.col("code").isNotNull()).select(*keys, "code", "detail")


def load_rescans(replies: DataFrame, keys: list[str], text: str = "reply") -> DataFrame:
    """Rescan reply texts to one row per answered region."""
    parsed = replies.withColumn("_r", F.from_json(text, schemas.RESCAN_REPLY)).filter(F.col("_r.success"))
    return parsed.select(*keys, F.inline("_r.results")).withColumnsRenamed({"id": "region_id", "text": "txt"})
