"""Repeated reads of one thing: which one counts, and what is logged about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.operators.ordered import running_before
from blockwise.operators.picks import first_by

# Quantities up to this may well repeat on one page, and the wording of the warnings.
GHOST_ABOVE = 150
DIVERGENCE = "[AP Bar] Divergence detected in image %d. Previous: %d/%d, New: %d/%d. Kept previous value."
GHOST = "[Sanity Check] Discarded %s with value %d because it duplicates a higher confidence neighbor (Ghost Read)."
UNREAD = "[Ignored] Could not read quantity for %s (Color: %s)."


def max_wins_merge(reads: DataFrame, keys: Sequence[str], qty: str, conf: str, seq: str,
                   payload: Sequence[str] = ()) -> DataFrame:
    """The largest quantity per item; higher confidence, then the earlier read, on ties."""
    order = [-F.col(qty), -F.col(conf), F.col(seq)]
    return first_by(reads, keys, order, [qty, conf, seq, *payload])


def max_wins_conflicts(reads: DataFrame, keys: Sequence[str], qty: str, seq: str,
                       ties: Sequence[str] = (), width: int = 65536) -> DataFrame:
    """One row per read that differs from the largest quantity before it."""
    seen = running_before(reads, keys, seq, F.col(qty), "max", "previous_qty", width, ties)
    clashes = seen.filter(F.col("previous_qty") != F.col(qty))
    return clashes.select(*keys, seq, *ties, "previous_qty", F.col(qty).alias("new_qty"),
                          F.greatest("previous_qty", F.col(qty)).alias("chosen_qty"))


def first_value_wins(bars: DataFrame) -> DataFrame:
    """Per session the bar of the first page that has one (current, maximum)."""
    return first_by(bars.filter(F.col("bar_max") > 0), ["session_id"], [F.col("page_seq"), F.col("page_id")],
                    ["page_seq", "bar_current", "bar_max"])


def first_value_divergence(bars: DataFrame) -> DataFrame:
    """Later pages whose bar differs from the one kept, with the message that says so."""
    kept = first_value_wins(bars).select("session_id", F.col("bar_current").alias("kept_current"), F.col("bar_max").alias("kept_max"))
    both = bars.filter(F.col("bar_max") > 0).join(kept, "session_id")
    differs = (F.col("bar_max") != F.col("kept_max")) | (F.col("bar_current") != F.col("kept_current"))
    text = F.format_string(DIVERGENCE, "page_seq", "kept_current", "kept_max", "bar_current", "bar_max")
    return both.filter(differs).select("session_id", "page_seq", text.alias("message"))


def duplicate_value_count(items: DataFrame, above: int = 10) -> DataFrame:
    """Quantities above ``above`` that several items of a page share, with their number."""
    return (items.filter(F.col("quantity") > above).groupBy("page_id", "quantity")
            .agg(F.count("*").alias("n_items")).filter(F.col("n_items") > 1))


def ghost_reads(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): an item is dropped if a surer one of its page has the same large quantity."""
    top = (items.filter(F.col("quantity") > GHOST_ABOVE).groupBy("page_id", "quantity")
           .agg(F.max("confidence").alias("_top")))
    judged = items.join(top, ["page_id", "quantity"], "left")
    ghost = F.coalesce(F.col("_top") > F.col("confidence"), F.lit(False))
    text = F.format_string(GHOST, "item_id", "quantity")
    return (judged.filter(~ghost).drop("_top").select(*items.columns),
            judged.filter(ghost).drop("_top").select(*items.columns, text.alias("message")))


def pending_log(items: DataFrame) -> DataFrame:
    """Items whose quantity could not be read, with the message that says so."""
    text = F.format_string(UNREAD, "item_id", "color")
    return items.filter(F.col("quantity") == -1).select("*", text.alias("message"))
