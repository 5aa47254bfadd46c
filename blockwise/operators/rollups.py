"""Page and session summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def full_text(blocks: DataFrame, keys: list[str], separator: str, run: int = 1024) -> DataFrame:
    """Block texts of a page in order, joined by a separator.

    Long pages are joined in runs of consecutive blocks first, so the pieces are built in parallel.
    """
    separator = separator.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    pieces = (blocks.selectExpr(*keys, "ord", "txt", f"cast(floor(ord / {run}) as bigint) as run")
              .groupBy(*keys, "run")
              .agg(F.expr(f"listagg(txt, '{separator}') within group (order by ord)").alias("piece")))
    return pieces.groupBy(*keys).agg(F.expr(f"listagg(piece, '{separator}') within group (order by run)").alias("full_text"))


def session_text(pages: DataFrame) -> DataFrame:
    """"[IMG n] text" of every page of a session, in page order."""
    labelled = pages.selectExpr("session_id", "page_seq", "concat('[IMG ', page_seq, '] ', full_text) as piece")
    return labelled.groupBy("session_id").agg(F.expr("listagg(piece, ' | ') within group (order by page_seq)").alias("raw_text"))


def item_totals(items: DataFrame, qty: str = "quantity", unit: str = "unit_value") -> DataFrame:
    return items.withColumn("total_value", F.col(qty).cast("bigint") * F.col(unit))


def grand_total(items: DataFrame) -> DataFrame:
    return items.groupBy("session_id").agg(F.sum("total_value").alias("grand_total"), F.count("*").alias("n_items"))


def mean_confidence(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("page_id").agg(F.avg("conf").alias("mean_conf"))
