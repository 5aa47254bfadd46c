"""Titled item lists: items per page, merged over the pages of a session in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.functions import numbers
from blockwise.functions.geometry import with_geometry
from blockwise.functions.text import similarity
from blockwise.operators.grid import pair_confidence
from blockwise.operators.merges import first_value_divergence, first_value_wins
from blockwise.operators.neighbours import title_to_quantity
from blockwise.operators.ordered import ConflictFold
from blockwise.operators.picks import first_by, top_k
from blockwise.operators.rollups import grand_total, item_totals
from blockwise.vocabulary import DEFAULT, Vocabulary

# Title similarity, and how many top blocks may hold the bar.
TITLE_THRESHOLD = 0.85
BAR_BLOCKS = 10


def title_lookup(blocks: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """The surest block per page and known item title."""
    known = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(v).alias("unit_value"), F.lit(i).alias("item_id"))
                      for t, v, i in vocabulary.titled_items])
    hits = F.filter(known, lambda k: similarity(F.col("txt"), k["title"]) > TITLE_THRESHOLD)
    titled = blocks.select("*", F.inline(hits))
    return first_by(titled, ["page_id", "item_id"], [-F.col("conf"), F.col("ord")],
                    ["title", "unit_value", "ord", "conf", "x0", "y0", "x1", "y2"])


def page_items(blocks: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """page_id, item_id, unit_value, quantity, confidence for every title with a readable quantity."""
    titles = title_lookup(blocks, vocabulary)
    lines = title_to_quantity(titles, blocks).select("page_id", "item_id", F.col("txt").alias("line"), F.col("conf").alias("line_conf"))
    quantity = numbers.owned_quantity(F.col("line"))
    return (titles.join(lines, ["page_id", "item_id"])
            .select("page_id", "item_id", "title", "unit_value", quantity.alias("quantity"),
                    pair_confidence(F.col("conf"), F.col("line_conf")).alias("confidence"))
            .filter(F.col("quantity") > 0))


def page_bars(blocks: DataFrame) -> DataFrame:
    """The first readable bar among the ten topmost blocks of each page."""
    pages = ["session_id", "page_seq", "page_id"]
    top = top_k(blocks.select(*pages, "ord", "txt", "y0"), pages, [F.col("y0"), F.col("ord")], BAR_BLOCKS, F.col("ord"))
    current, maximum = numbers.bar_values(F.col("txt"))
    readable = top.select(*pages, "rank", current.alias("bar_current"), maximum.alias("bar_max")).filter(F.col("bar_max") > 0)
    return first_by(readable, pages, [F.col("rank")], ["bar_current", "bar_max"])


def session_items(blocks: DataFrame, vocabulary: Vocabulary = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(items, conflicts) per session after the ordered merge of its pages."""
    prepared = with_geometry(blocks)
    pages = blocks.select("page_id", "session_id", "page_seq").distinct()
    reads = page_items(prepared, vocabulary).join(pages, "page_id")
    fold = ConflictFold(reads, ["session_id", "item_id"], "page_seq", "quantity", "confidence")
    known = F.create_map(*[x for t, v, i in vocabulary.titled_items for x in (F.lit(i), F.struct(F.lit(t).alias("title"), F.lit(v).alias("unit_value")))])
    item = F.element_at(known, F.col("item_id"))
    won = fold.winners().select("session_id", "item_id", item["title"].alias("title"), item["unit_value"].alias("unit_value"),
                                F.col("qty").alias("quantity"), F.col("conf").alias("confidence"))
    return item_totals(won), fold.conflicts()


def session_summary(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """One row per session: grand total, number of items and the bar."""
    bars = page_bars(blocks)
    return grand_total(items).join(first_value_wins(bars).select("session_id", "bar_current", "bar_max"), "session_id", "full_outer")


def bar_warnings(blocks: DataFrame) -> DataFrame:
    return first_value_divergence(page_bars(blocks))
