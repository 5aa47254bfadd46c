"""Icons and numbers on a grid: candidates, line of sight, one-to-one matching, leftovers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwise.functions.geometry import distance
from blockwise.functions.numbers import digits_only_int
from blockwise.vocabulary import DEFAULT, Vocabulary

# Search limits in units of the page's median anchor height.
ALIGN = 2.0
RADIUS = 5.5
MAX_QUANTITY_TEXT = 9
# Cells are twice as high as the search reaches and as wide as it reaches to both sides: an anchor has one or two each way.
_WIDE, _HIGH, _ROUNDING = 2 * ALIGN, 2 * RADIUS, 1e-6


def value_color_lookup(blocks: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Anchors: blocks whose digits are a known unit value and whose colour that value allows."""
    entries: list[Column] = []
    for value, item_id, colors in vocabulary.grid_items:
        entries += [F.lit(value), F.struct(F.lit(item_id).alias("item_id"), F.array(*[F.lit(c) for c in colors]).alias("colors"))]
    known = F.element_at(F.create_map(*entries), F.col("unit_value"))
    return (blocks.withColumn("unit_value", digits_only_int(F.col("txt"))).withColumn("_k", known)
            .filter(F.array_contains("_k.colors", F.col("color")))
            .withColumn("item_id", F.col("_k.item_id")).drop("_k"))


def upper_median_height(anchors: DataFrame) -> DataFrame:
    """Median anchor height per page, the upper one for even counts."""
    return anchors.groupBy("page_id").agg(
        F.expr("percentile_disc(0.5) within group (order by y2 - y0 desc)").alias("m"))


def quantity_blocks(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Blocks that may be a quantity: a positive number, short text, not an anchor."""
    numbers = blocks.withColumn("qty", digits_only_int(F.col("txt"))).filter(
        (F.col("qty") > 0) & (F.length("txt") < MAX_QUANTITY_TEXT))
    return numbers.join(anchors.select("page_id", "ord"), ["page_id", "ord"], "left_anti")


def _scaled(blocks: DataFrame, scale: DataFrame) -> DataFrame:
    """Blocks with their page's median anchor height, which they may have already."""
    return blocks if "m" in blocks.columns else blocks.join(scale, "page_id")


def _cell(value: Column, size: Column) -> Column:
    return F.floor(value / F.when(size > 0, size)).cast("bigint")


def _reached(low: Column, high: Column, size: Column) -> Column:
    """Every cell that a stretch may touch, rounding included."""
    size = F.when(size > 0, size)
    return F.sequence(F.floor(low / size - _ROUNDING).cast("bigint"), F.floor(high / size + _ROUNDING).cast("bigint"))


def grid_candidates(anchors: DataFrame, quantities: DataFrame, scale: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Anchor and quantity pairs close enough to belong together.

    Both sides meet on cells about as large as the search window, so only neighbours are compared.  With ``limits``, an anchor's
    ``blocked_from``, a pair has to be in sight as well, and no cell below that height is searched.
    """
    m, blocked = F.col("m"), F.col("blocked_from")
    a = _scaled(anchors, scale).withColumnRenamed("ord", "anchor_ord")
    a = a.withColumn("blocked_from", F.lit(None).cast("double")) if limits is None else a.join(limits, ["page_id", "anchor_ord"], "left")
    lowest = F.least(F.col("cy") + m * RADIUS, blocked)
    a = (a.select("page_id", "anchor_ord", F.col("cx").alias("ax"), F.col("cy").alias("ay"), "m", "blocked_from",
                  _reached(F.col("cx") - m * ALIGN, F.col("cx") + m * ALIGN, m * _WIDE).alias("gx"),
                  _reached(F.col("cy"), lowest, m * _HIGH).alias("gy"))
         .withColumn("gx", F.explode("gx")).withColumn("gy", F.explode("gy")))
    q = (_scaled(quantities, scale)
         .select("page_id", F.col("ord").alias("qty_ord"), F.col("cx").alias("qx"), F.col("cy").alias("qy"), "qty",
                 _cell(F.col("cx"), m * _WIDE).alias("gx"), _cell(F.col("cy"), m * _HIGH).alias("gy")))
    gap = distance(F.col("ax"), F.col("ay"), F.col("qx"), F.col("qy"))
    return (a.join(q, ["page_id", "gx", "gy"]).withColumn("dist", gap)
            .filter((F.col("qy") > F.col("ay")) & (F.abs(F.col("qx") - F.col("ax")) <= m * ALIGN)
                    & (F.col("dist") < m * RADIUS) & (blocked.isNull() | (blocked >= F.col("qy"))))
            .select("page_id", "anchor_ord", "qty_ord", "qty", "ax", "ay", "qx", "qy", "m", "dist"))


def next_anchor_below(anchors: DataFrame, scale: DataFrame) -> DataFrame:
    """Per anchor the height at which the next anchor of its column starts to block the view."""
    m = F.col("m")
    placed = _scaled(anchors, scale).select(
        "page_id", "ord", "cx", "cy", "m",
        _cell(F.col("cx"), m * _WIDE).alias("gx"), _cell(F.col("cy"), m * _HIGH).alias("gy"))
    a = (placed.select("page_id", F.col("ord").alias("anchor_ord"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), "m",
                       _reached(F.col("cx") - m * ALIGN, F.col("cx") + m * ALIGN, m * _WIDE).alias("gx"),
                       _reached(F.col("cy"), F.col("cy") + m * RADIUS, m * _HIGH).alias("gy"))
         .withColumn("gx", F.explode("gx")).withColumn("gy", F.explode("gy")).drop("m"))
    # in a cell only the position counts, so stacked anchors are met once
    o = placed.select("page_id", "gx", "gy", "cx", "cy", "m").distinct()
    return (a.join(o, ["page_id", "gx", "gy"])
            .filter((F.col("cy") > F.col("ay")) & (F.abs(F.col("cx") - F.col("ax")) < m * ALIGN))
            .groupBy("page_id", "anchor_ord").agg(F.min("cy").alias("blocked_from")))


def line_of_sight(anchors: DataFrame, quantities: DataFrame, scale: DataFrame) -> DataFrame:
    """Candidate pairs without another anchor of the same column strictly between."""
    return grid_candidates(anchors, quantities, scale, next_anchor_below(anchors, scale))


def page_parts(pairs: DataFrame) -> DataFrame:
    """Adds ``column`` and ``part``: stretches of a page that no pair crosses, so that each can be matched on its own.

    A page is cut where no pair spans the border between two cells, first across, then each of the columns down.  Only the distinct
    cells of a page are put in order; its pairs stay spread.
    """
    def cut(df: DataFrame, keys: Sequence[str], low: Column, high: Column, name: str) -> DataFrame:
        df = df.withColumns({"_low": low, "_high": high})
        cells = (df.select(*keys, "_high", F.explode(F.sequence("_low", "_high")).alias("_cell"))
                 .groupBy(*keys, "_cell").agg(F.max(F.col("_cell") < F.col("_high")).alias("_on")))
        order = Window.partitionBy(*keys).orderBy("_cell")
        joined = F.lag("_on").over(order) & (F.lag("_cell").over(order) == F.col("_cell") - 1)
        numbered = cells.withColumn("_new", (~F.coalesce(joined, F.lit(False))).cast("int"))
        numbered = numbered.select(*keys, F.col("_cell").alias("_low"), F.sum("_new").over(order).alias(name))
        return df.join(numbered, [*keys, "_low"]).drop("_low", "_high")

    # cells instead of places: the pairs are dealt out several times
    m, ends = F.col("m"), {"ax", "ay", "qx", "qy", "m"}
    cells = {"_left": _cell(F.least("ax", "qx"), m * ALIGN), "_right": _cell(F.greatest("ax", "qx"), m * ALIGN),
             "_top": _cell(F.col("ay"), m * RADIUS), "_bottom": _cell(F.col("qy"), m * RADIUS)}
    placed = pairs.select(*[c for c in pairs.columns if c not in ends], *[c.alias(n) for n, c in cells.items()])
    across = cut(placed, ["page_id"], F.col("_left"), F.col("_right"), "column").drop("_left", "_right")
    return cut(across, ["page_id", "column"], F.col("_top"), F.col("_bottom"), "part").drop("_top", "_bottom")


def _take(keys: int) -> Callable:
    """Takes each pair whose ends are both free; a group's pairs come nearest first."""
    def run(batches):
        group, anchors, quantities = None, set(), set()
        for batch in batches:
            *key, a_ords, q_ords = (batch.column(i).to_pylist() for i in (*range(keys), batch.num_columns - 2, batch.num_columns - 1))
            taken = []
            for i, now in enumerate(zip(*key)):
                if now != group:
                    group, anchors, quantities = now, set(), set()
                a, q = a_ords[i], q_ords[i]
                if a not in anchors and q not in quantities:
                    anchors.add(a)
                    quantities.add(q)
                    taken.append(i)
            yield batch.take(taken)
    return run


def greedy_matching(pairs: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """One-to-one pairs taken in ascending (dist, anchor_ord, qty_ord) order within the groups that ``keys`` name.

    A group passes through a task as a sorted stream; what is held are the ends taken so far.
    """
    ordered = pairs.select(*keys, F.col("dist").cast("double").alias("dist"), F.col("anchor_ord").cast("int").alias("anchor_ord"),
                           F.col("qty_ord").cast("int").alias("qty_ord"))
    stream = ordered.repartition(*keys).sortWithinPartitions(*keys, "dist", "anchor_ord", "qty_ord")
    return stream.mapInArrow(_take(len(keys)), ordered.schema).select("page_id", "dist", "anchor_ord", "qty_ord")


def matched_items(anchors: DataFrame, quantities: DataFrame, matches: DataFrame) -> DataFrame:
    """Items of the matched pairs with their ``dist``; confidence is the mean of both blocks in percent, half-even."""
    a = anchors.select("page_id", F.col("ord").alias("anchor_ord"), "item_id", "unit_value", "color", F.col("conf").alias("a_conf"))
    q = quantities.select("page_id", F.col("ord").alias("qty_ord"), "qty", F.col("conf").alias("q_conf"))
    return (matches.join(a, ["page_id", "anchor_ord"]).join(q, ["page_id", "qty_ord"])
            .select("page_id", "anchor_ord", "item_id", "unit_value", F.col("qty").alias("quantity"),
                    pair_confidence(F.col("a_conf"), F.col("q_conf")).alias("confidence"), F.col("color"), "dist"))


def pair_confidence(a: Column, b: Column) -> Column:
    return F.bround((a + b) / 2 * 100, 2)


def orphan_anchors(anchors: DataFrame, matches: DataFrame) -> DataFrame:
    """Anchors nothing was matched to, marked as pending."""
    a = anchors.withColumnRenamed("ord", "anchor_ord")
    return (a.join(matches.select("page_id", "anchor_ord"), ["page_id", "anchor_ord"], "left_anti")
            .select("page_id", "anchor_ord", "item_id", "unit_value", F.lit(-1).alias("quantity"),
                    F.lit(0.0).alias("confidence"), F.concat("color", F.lit("_PENDING")).alias("color")))
