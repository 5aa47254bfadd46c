"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable.
Turns after the last assistant turn give one more example without anything trainable, so that no turn is lost.

An example is a run of ``<turn ROLE>\\nTEXT</turn>\\n``.  In texts and roles, ``<turn`` and ``</turn`` get a backslash after
the ``<``, one more if there are some already, so a mark inside a text is never taken for one; in roles ``>`` is written
``\\g`` and a backslash doubled.  Both are undone when an example is read.

Native expressions only.  Turns are ordered by turn (null first), role and text, so ties and repeated rows have one order;
null roles and texts count as empty; a null conv_id is a conversation of its own; an empty table gives no examples; extra
columns are left out.  A conversation must fit into a row, as each of its examples must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
TARGET_ROLE = "assistant"


def _guarded(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)(/?turn)", r"<\\$1$2")


def _unguarded(x: Column) -> Column:
    return F.regexp_replace(x, r"<\\(\\*)(/?turn)", r"<$1$2")


def _role(x: Column) -> Column:
    return F.replace(F.replace(_guarded(x), F.lit("\\"), F.lit("\\\\")), F.lit(">"), F.lit("\\g"))


def _role_back(x: Column) -> Column:
    parts = F.transform(F.split(x, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\g"), F.lit(">")))
    return _unguarded(F.array_join(parts, "\\"))


def expand(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 1), target_turn (its place, null without one), formatted, loss_start
    and loss_end (code points of ``formatted``, from 0, end exclusive; both null without a target)."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rendered = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit("<turn "), _role(t.role), F.lit(">\n")).alias("head"), _guarded(t.text).alias("body"), t.role.alias("role")))
    whole = whole.select("conv_id", rendered.alias("turns"))
    answers = F.filter(F.transform("turns", lambda t, i: F.when(t.role == TARGET_ROLE, i + 1)), lambda i: i.isNotNull())
    n = F.size("turns")
    rest = F.when(F.coalesce(F.try_element_at("answers", F.lit(-1)), F.lit(0)) < n, F.array(n)).otherwise(F.array().cast("array<int>"))
    whole = whole.withColumn("answers", answers).withColumn("ends", F.concat("answers", rest))
    each = whole.select("conv_id", "turns", F.size("answers").alias("n_answers"), F.posexplode("ends").alias("place", "end"))
    text = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("end")), lambda t: F.concat(t.head, t.body, F.lit(END))), "")
    has_target = F.col("place") < F.col("n_answers")
    stop = F.char_length("formatted") - len(END)
    body = F.char_length(F.element_at("turns", F.col("end")).body)
    each = each.withColumn("formatted", text)
    return each.select("conv_id", (F.col("place") + 1).alias("example"), F.when(has_target, F.col("end")).alias("target_turn"), "formatted",
                       F.when(has_target, stop - body).alias("loss_start"), F.when(has_target, stop).alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of an example."""
    pieces = F.split(formatted, END, -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(
        _role_back(F.regexp_extract(p, r"(?s)^<turn ([^>]*)>\n", 1)).alias("role"),
        _unguarded(F.regexp_replace(p, r"(?s)^<turn [^>]*>\n", "")).alias("text")))


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, as it was; null without one."""
    return _unguarded(F.substring(formatted, start + 1, end - start))
