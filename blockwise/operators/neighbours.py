"""Nearest-block joins within a page.

Where the searching side is small by construction (the first label of each kind, the tag of a side), a page
join costs a few comparisons per block; its answer is folded into a per-source minimum on the map side.
Otherwise both sides meet on cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.functions.geometry import distance
from blockwise.operators.picks import first_by, top_k

# Reach of the neighbour searches, normalised.
METRIC_REACH = 0.45
NAME_REACH = 0.35
IDENTITY_REACH = 0.2
OFF_AXIS_WEIGHT = 10
COST_LIMIT = 1000


def direction_cost(dx: Column, dy: Column, direction: str) -> Column:
    """Distance along the direction plus ten times the deviation; NULL on the wrong side."""
    along, across, ahead = {
        "right": (F.abs(dx), F.abs(dy), dx > 0), "left": (F.abs(dx), F.abs(dy), dx < 0),
        "down": (F.abs(dy), F.abs(dx), dy > 0), "up": (F.abs(dy), F.abs(dx), dy < 0)}[direction]
    cost = across * OFF_AXIS_WEIGHT + along
    return F.when(ahead & (cost < COST_LIMIT), cost)


# Cells (across, up) around a source's own in which a block ahead of it can lie.
_AHEAD = {"right": ((0, 1), (-1, 0, 1)), "left": ((-1, 0), (-1, 0, 1)), "down": ((-1, 0, 1), (0, 1)), "up": ((-1, 0, 1), (-1, 0))}


def nearest_in_direction(sources: DataFrame, blocks: DataFrame, direction: str, reach: float | str = 0.3,
                         keys: Sequence[str] = ("page_id", "src_ord"), payload: Sequence[str] = ("ord", "txt")) -> DataFrame:
    """For each source (keys, nx, ny) the cheapest block ahead of it within ``reach`` on both axes.

    Both sides meet on cells as large as the reach, so a page is never paired with itself.  ``reach`` may name a
    column of the sources instead, so that a few sources of a page with several reaches share one page join.
    """
    where = [k for k in keys if k != "src_ord" and k in blocks.columns]
    targets = blocks.select(*where, F.col("nx").alias("tx"), F.col("ny").alias("ty"),
                            *[F.col(p).alias(f"t_{p}") for p in dict.fromkeys(["ord", *payload])])
    limit = F.col(reach) if isinstance(reach, str) else F.lit(reach)
    spots = sources.select(*keys, F.col("nx").alias("sx"), F.col("ny").alias("sy"), limit.alias("_reach"))
    on = list(where)
    if not isinstance(reach, str):
        def cell(c: str) -> Column:
            return F.floor(F.col(c) / reach).cast("bigint")
        across, up = (F.explode(F.array(*[cell(c) + step for step in steps])) for c, steps in zip(("sx", "sy"), _AHEAD[direction]))
        spots = spots.withColumn("gx", across).withColumn("gy", up)
        targets = targets.withColumns({"gx": cell("tx"), "gy": cell("ty")})
        on += ["gx", "gy"]
    dx, dy = F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")
    hits = (targets.join(spots, on).withColumn("cost", direction_cost(dx, dy, direction))
            .filter(F.col("cost").isNotNull() & (F.abs(dx) < F.col("_reach")) & (F.abs(dy) < F.col("_reach"))))
    found = first_by(hits, keys, [F.col("cost"), F.col("t_ord")], ["cost", *[f"t_{p}" for p in payload]])
    return found.select(*keys, "cost", *[F.col(f"t_{p}").alias(p) for p in payload])


def nearest_around(sources: DataFrame, blocks: DataFrame, reach: dict[str, float], keys: Sequence[str] = ("page_id", "src_ord"),
                   payload: Sequence[str] = ("ord", "txt")) -> DataFrame:
    """For each source and each ``direction`` with its reach the cheapest block ahead, in one meeting of both sides."""
    where, size = [k for k in keys if k != "src_ord" and k in blocks.columns], max(reach.values())

    def cell(c: str) -> Column:
        return F.floor(F.col(c) / size).cast("bigint")
    targets = blocks.select(*where, F.col("nx").alias("tx"), F.col("ny").alias("ty"), cell("nx").alias("gx"), cell("ny").alias("gy"),
                            *[F.col(p).alias(f"t_{p}") for p in dict.fromkeys(["ord", *payload])])
    spots = sources.select(*keys, F.col("nx").alias("sx"), F.col("ny").alias("sy"))
    for name, of in (("gx", "sx"), ("gy", "sy")):
        spots = spots.withColumn(name, F.explode(F.array(*[cell(of) + step for step in (-1, 0, 1)])))
    dx, dy = F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")
    ways = F.array(*[F.struct(F.lit(d).alias("direction"), F.when((F.abs(dx) < r) & (F.abs(dy) < r), direction_cost(dx, dy, d)).alias("cost"))
                     for d, r in reach.items()])
    hits = targets.join(spots, [*where, "gx", "gy"]).withColumn("_way", F.explode(F.filter(ways, lambda w: w["cost"].isNotNull()))).select("*", "_way.*")
    found = first_by(hits, [*keys, "direction"], [F.col("cost"), F.col("t_ord")], ["cost", *[f"t_{p}" for p in payload]])
    return found.select(*keys, "direction", "cost", *[F.col(f"t_{p}").alias(p) for p in payload])


def nearest_to_anchor(anchors: DataFrame, candidates: DataFrame, payload: Sequence[str] = ("ord", "value")) -> DataFrame:
    """For each page's one anchor (page_id, ax, ay) the closest candidate (page_id, ord, cx, cy, ...)."""
    pairs = candidates.join(anchors.select("page_id", "ax", "ay"), "page_id")
    gap = distance(F.col("cx"), F.col("cy"), F.col("ax"), F.col("ay"))
    return first_by(pairs.withColumn("distance", gap), ["page_id"], [F.col("distance"), F.col("ord")],
                    ["distance", *payload])


def topk_nearest(anchors: DataFrame, candidates: DataFrame, k: int = 3) -> DataFrame:
    """The k candidates closest to each page's anchor with their ``rank``."""
    pairs = candidates.join(anchors.select("page_id", "ax", "ay"), "page_id")
    gap = distance(F.col("cx"), F.col("cy"), F.col("ax"), F.col("ay"))
    return top_k(pairs.withColumn("distance", gap), ["page_id"], [F.col("distance"), F.col("ord")], k, F.col("ord"))


def right_neighbor_same_line(sources: DataFrame, candidates: DataFrame, line: float = 40.0) -> DataFrame:
    """For each page's one source (page_id, sx, sy) the closest candidate to its right, less than ``line`` px off."""
    pairs = candidates.join(sources.select("page_id", "sx", "sy"), "page_id")
    pairs = pairs.filter((F.col("cx") > F.col("sx")) & (F.abs(F.col("cy") - F.col("sy")) < line))
    return first_by(pairs.withColumn("dx", F.abs(F.col("cx") - F.col("sx"))), ["page_id"],
                    [F.col("dx"), F.col("ord")], ["ord", "txt"])


def proximity_veto(candidates: DataFrame, bars: DataFrame, dx: float = 450.0, dy: float = 30.0) -> DataFrame:
    """Candidates without a bar within dx and dy.

    Bars are reduced to their distinct positions and met by cell, so a page is never paired with itself.
    """
    def cell(c: Column, size: float) -> Column:
        return F.floor(c / size).cast("bigint")
    spots = bars.select("page_id", F.col("cx").alias("bx"), F.col("cy").alias("by")).distinct()
    spots = spots.withColumn("gx", cell(F.col("bx"), dx)).withColumn("gy", cell(F.col("by"), dy))
    for axis in ("gx", "gy"):
        spots = spots.withColumn(axis, F.explode(F.array(F.col(axis) - 1, F.col(axis), F.col(axis) + 1)))
    placed = candidates.withColumn("gx", cell(F.col("cx"), dx)).withColumn("gy", cell(F.col("cy"), dy))
    b = spots.alias("b")
    p = placed.alias("p")
    near = ((F.col("p.page_id") == F.col("b.page_id")) & (F.col("p.gx") == F.col("b.gx")) & (F.col("p.gy") == F.col("b.gy"))
            & (F.abs(F.col("by") - F.col("cy")) < dy) & (F.abs(F.col("bx") - F.col("cx")) < dx))
    return p.join(b, near, "left_anti").drop("gx", "gy")


def title_to_quantity(titles: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each title (page_id, item_id, t_ord, box) the topmost ownership line below it.

    A page has at most one title per known item, so the page join is bounded by the item table.
    """
    from blockwise.functions.numbers import OWNED
    t = titles.select("page_id", "item_id", F.col("ord").alias("title_ord"), F.col("x0").alias("tx0"),
                      F.col("x1").alias("tx1"), F.col("y2").alias("bottom"), (F.col("y2") - F.col("y0")).alias("th"))
    lines = blocks.filter(F.col("txt").rlike(OWNED)).select("page_id", "ord", "txt", "conf", "cx", "cy")
    pairs = lines.join(t, "page_id").filter(
        (F.col("ord") != F.col("title_ord"))
        & (F.col("cy") > F.col("bottom")) & (F.col("cy") < F.col("bottom") + F.col("th") * 4.5)
        & F.col("cx").between(F.col("tx0") - F.col("th") * 2, F.col("tx1") + F.col("th") * 2))
    return first_by(pairs, ["page_id", "item_id", "title_ord"], [F.col("cy"), F.col("ord")], ["ord", "txt", "conf"])
