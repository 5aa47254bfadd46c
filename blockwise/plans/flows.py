"""From recogniser replies to record envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.functions.geometry import rescaled
from blockwise.operators.filters import confidence_gate
from blockwise.operators.ordered import sequence_number
from blockwise.operators.rollups import full_text, grand_total, session_text
from blockwise.plans import grids, item_lists, profiles, reports
from blockwise.session import stage
from blockwise.sources.records import profile_envelopes, report_envelopes, session_envelopes, unite_warnings
from blockwise.sources.replies import error_rows, load_detections
from blockwise.vocabulary import DEFAULT, Vocabulary

CORNERS = ("x0", "y0", "x1", "y1", "x2", "y2")


def detections(replies: DataFrame, source: str, ratio: Column | float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """Detections of one source's replies: gated by confidence, with the recogniser's down-scaling undone."""
    rows = confidence_gate(load_detections(replies, keys or ["page_id"]).withColumn("source", F.lit(source)))
    scale = F.lit(float(ratio)) if isinstance(ratio, (int, float)) else ratio
    return rows.select(*[c for c in rows.columns if c not in (*CORNERS, "source")], *rescaled(scale, *CORNERS))


def profile_flow(replies: DataFrame, ratio: Column | float = 1.0, vocabulary: Vocabulary = DEFAULT, draft_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(envelopes, warnings) of profile replies, one envelope per page that was sent."""
    audited = profiles.audit_profiles(profiles.build_profiles(profiles.prepare(detections(replies, "profile", ratio), vocabulary), vocabulary, draft_id))
    incomplete = audited.filter(~F.col("complete")).select("page_id", F.lit("INCOMPLETE_PROFILE").alias("code"), F.lit(None).cast("string").alias("detail"))
    warnings = unite_warnings({"reply": error_rows(replies, ["page_id"]), "profile": incomplete}, "page_id")
    return profile_envelopes(replies.select("page_id").distinct(), audited, warnings), warnings


def report_flow(replies: DataFrame, entities: DataFrame, npcs: DataFrame, as_of_year: int, rescans: DataFrame | None = None,
                vocabulary: Vocabulary = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(envelopes, warnings) of report replies, one envelope per page that was sent."""
    blocks = stage(detections(replies, "report"))
    built, sides = reports.build_reports(blocks, entities, npcs, as_of_year, rescans, vocabulary)
    built = stage(built)
    warnings = unite_warnings({"reply": error_rows(replies, ["page_id"]), "report": reports.report_warnings(built),
                               "balance": reports.balance_audit_log(sides)}, "page_id")
    texts = full_text(blocks, ["page_id"], " | ")
    return report_envelopes(replies.select("page_id").distinct(), built, sides, texts, warnings.filter(F.col("source") != "balance")), warnings


PAGE = ["session_id", "page_id", "page_seq"]


def _paged(replies: DataFrame) -> DataFrame:
    """Replies with their session and their place in it, which is that of their ``arrival`` where no number was sent."""
    if "page_seq" in replies.columns:
        return replies.withColumns({k: F.col(k).cast("bigint") for k in ("session_id", "page_seq")})
    timed = replies.withColumns({k: F.col(k).cast("bigint") for k in ("session_id", "arrival")})
    return sequence_number(timed, ["session_id"], "arrival", "page_seq", ties=["page_id"]).withColumn("page_seq", F.col("page_seq").cast("bigint"))


def _text(c: str) -> Column:
    """A confidence without a needless fraction."""
    return F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")


# The wording of the warnings about items that pages of a session disagree on.
ITEM_CONFLICT = "[Item Conflict] '%s' diverged between images. Values: %d vs %d. System chose: %d (Conf: %s%% vs %s%%)."
GRID_CONFLICT = "[Conflict] %s: %d vs %d. Using %d."


def _failures(replies: DataFrame) -> DataFrame:
    return error_rows(replies, PAGE).withColumn("message", F.concat_ws(": ", "code", "detail"))


def list_flow(replies: DataFrame, ratio: Column | float = 1.0, vocabulary: Vocabulary = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(envelopes, warnings) of titled item lists, one envelope per session that was sent."""
    replies = stage(_paged(replies))
    blocks = stage(detections(replies, "inventory", ratio, PAGE))
    items, conflicts = item_lists.session_items(blocks, vocabulary)
    items = stage(items)
    title = F.element_at(F.create_map(*[F.lit(x) for t, _, i in vocabulary.titled_items for x in (i, t)]), F.col("item_id"))
    told = conflicts.select("session_id", F.col("seq").alias("page_seq"), F.format_string(
        ITEM_CONFLICT, title, "previous_qty", "new_qty", "chosen_qty", _text("new_conf"), _text("previous_conf")).alias("message"))
    warnings = unite_warnings({"reply": _failures(replies), "bar": item_lists.bar_warnings(blocks), "item": told}, "session_id", "page_seq")
    texts = session_text(full_text(blocks, ["session_id", "page_seq"], " | "))
    envelopes = session_envelopes(replies.select("session_id").distinct(), items, item_lists.session_summary(blocks, items), texts, warnings)
    return envelopes, warnings


def grid_flow(replies: DataFrame, ratio: Column | float = 1.0, rescans: DataFrame | None = None,
              vocabulary: Vocabulary = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(envelopes, warnings) of icon grids, one envelope per session that was sent."""
    replies = stage(_paged(replies))
    blocks = stage(detections(replies, "inventory", ratio, PAGE))
    items, conflicts, ignored = grids.session_items(blocks, rescans, vocabulary)
    items = stage(items)
    told = conflicts.select("session_id", "page_seq", F.format_string(GRID_CONFLICT, "item_id", "previous_qty", "new_qty", "chosen_qty").alias("message"))
    pages = blocks.select("page_id", "page_seq").distinct()
    warnings = unite_warnings({"reply": _failures(replies), "read": ignored.join(pages, "page_id"), "item": told}, "session_id", "page_seq")
    texts = session_text(full_text(blocks, ["session_id", "page_seq"], " | "))
    return session_envelopes(replies.select("session_id").distinct(), items, grand_total(items), texts, warnings), warnings
