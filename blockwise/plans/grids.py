"""Icon grids: items per page, merged over the pages of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.functions.geometry import with_geometry
from blockwise.operators import grid as G
from blockwise.operators.merges import ghost_reads, max_wins_conflicts, max_wins_merge, pending_log
from blockwise.operators.rescans import rescan_quantity_merge
from blockwise.operators.rollups import item_totals
from blockwise.session import FILE_ROWS, stage
from blockwise.vocabulary import DEFAULT, Vocabulary


class GridPage:
    """The steps of one grid extraction, shared by everything that needs them."""

    def __init__(self, blocks: DataFrame, vocabulary: Vocabulary = DEFAULT):
        prepared = with_geometry(blocks)
        found = G.value_color_lookup(prepared, vocabulary)
        self.scale = stage(G.upper_median_height(found))
        # joined to their page's scale once, where every step needs it
        self.placed = stage(found.join(self.scale, "page_id", "left"), FILE_ROWS)
        self.anchors = self.placed.drop("m")
        self.quantities = stage(G.quantity_blocks(prepared, self.anchors).select("page_id", "ord", "qty", "conf", "cx", "cy"), FILE_ROWS)

    def candidates(self) -> DataFrame:
        return G.grid_candidates(self.placed, self.quantities, self.scale)

    def visible(self) -> DataFrame:
        return G.line_of_sight(self.placed, self.quantities, self.scale)

    def matches(self) -> DataFrame:
        # written once: the cells of the pairs are counted before the pairs are dealt out
        return G.greedy_matching(G.page_parts(stage(self.visible().drop("qty"), FILE_ROWS)), ["page_id", "column", "part"])

    def items(self) -> DataFrame:
        """Matched items and pending orphans in page order (dist, anchor_ord)."""
        matches = stage(self.matches())
        matched = G.matched_items(self.anchors, self.quantities, matches)
        orphans = G.orphan_anchors(self.anchors, matches).withColumn("dist", F.lit(float("inf")))
        return matched.unionByName(orphans)


def page_items(blocks: DataFrame, rescans: DataFrame | None = None, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Items of every page, pending ones filled from their rescans."""
    items = GridPage(blocks, vocabulary).items()
    return items if rescans is None else rescan_quantity_merge(items, rescans)


def session_items(blocks: DataFrame, rescans: DataFrame | None = None,
                  vocabulary: Vocabulary = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, conflicts, warnings) per session.  ``blocks`` carries session_id and page_seq."""
    pages = blocks.select("page_id", "session_id", "page_seq").distinct()
    # three results share the page items, so they are written once
    items = stage(page_items(blocks, rescans, vocabulary).join(pages, "page_id"))
    kept, ghosts = ghost_reads(items)
    pending = pending_log(kept)
    read = kept.filter(F.col("quantity") != -1)
    keys, ties = ["session_id", "item_id"], ["dist", "anchor_ord"]
    ordered = read.withColumn("seq", F.struct("page_seq", *ties))
    won = max_wins_merge(ordered, keys, "quantity", "confidence", "seq", ["unit_value", "color"]).drop("seq")
    conflicts = max_wins_conflicts(read, keys, "quantity", "page_seq", ties)
    warnings = ghosts.select("session_id", "page_id", "item_id", "message").unionByName(
        pending.select("session_id", "page_id", "item_id", "message"))
    return item_totals(won), conflicts, warnings
