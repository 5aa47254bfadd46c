"""Row filters and page-region tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Minimum confidence per source and the halves of a page.
INVENTORY_MIN_CONF = 0.05
REPORT_MIN_CONF = 0.10
REPAIR_BELOW_CONF = 0.85
SIDES = [("attacker", 0.0, 0.5), ("defender", 0.5, 1.0)]


def confidence_gate(blocks: DataFrame, source: str = "source") -> DataFrame:
    """Keeps what each source accepts: everything, conf >= 0.05, or conf > 0.10."""
    kind, conf = F.col(source), F.col("conf")
    return blocks.filter(F.when(kind == "inventory", conf >= INVENTORY_MIN_CONF)
                         .when(kind == "report", conf > REPORT_MIN_CONF).otherwise(True))


def side_split(blocks: DataFrame, canvas_w: Column) -> DataFrame:
    """One row per side a block's top-left corner lies on; the middle line belongs to both."""
    x = F.col("x0") / F.when(canvas_w > 0, canvas_w)
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in SIDES])
    inside = F.filter(sides, lambda s: x.between(s["a"], s["b"]))
    return blocks.select("*", F.explode(F.transform(inside, lambda s: s["side"])).alias("side"))


def low_confidence_numbers(blocks: DataFrame, failing_pages: DataFrame) -> DataFrame:
    """Unsure number blocks of the pages whose arithmetic fails."""
    unsure = blocks.filter((F.col("block_type") == "Number") & (F.col("conf") < REPAIR_BELOW_CONF))
    return unsure.join(failing_pages.select("page_id"), "page_id", "left_semi")


def block_difference(blocks: DataFrame, claimed: DataFrame) -> DataFrame:
    """Blocks that are not among the claimed ones."""
    return blocks.join(claimed.select("page_id", "ord"), ["page_id", "ord"], "left_anti")
