"""Rule cascades that give every block, page or pixel range its type.

Keyword rules are evaluated row by row from literal word lists: no distinct, no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.functions import numbers as N
from blockwise.functions.text import contains_any, first_matching_list, matches_any, similar_to_any
from blockwise.vocabulary import COLOR_ORDER, COLOR_RANGES, DEFAULT, METRIC_LISTS, PROFILE_UI_LISTS, Vocabulary

# Similarity a keyword match must exceed, per rule.
LABEL_THRESHOLD = 0.82
CIVILIZATION_THRESHOLD = 0.75
REPORT_THRESHOLD = 0.85


def profile_type(txt: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    t = F.trim(txt)
    return (F.when(similar_to_any(t, vocabulary.words(*PROFILE_UI_LISTS), LABEL_THRESHOLD), "UI")
            .when(t.rlike(N.BAR_STATUS), "BarStatus")
            .when(F.translate(t, "lI", "11").rlike(N.ID_DIGITS), "ID")
            .when(N.is_plain_number(t), "Number")
            .when(matches_any(t, vocabulary.words("civilizations"), CIVILIZATION_THRESHOLD), "Civilization")
            .when(F.startswith(t, F.lit("[")), "Tag")
            .when(t.rlike(N.CLOCK), "DateOrTime")
            .otherwise("Unknown"))


def classify_profile_blocks(blocks: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Adds ``block_type`` by the first profile rule that hits."""
    return blocks.withColumn("block_type", profile_type(F.col("txt"), vocabulary))


def report_type(txt: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    t = F.trim(txt)

    kinds = [*[block_type for _, block_type in METRIC_LISTS], "StatusResult"]
    lists = [*[vocabulary.words(name) for name, _ in METRIC_LISTS], vocabulary.words("victory", "defeat")]
    # the list rules come first, so they are decided together
    listed = F.get(F.array(*map(F.lit, kinds)), first_matching_list(F.nullif(t, F.lit("")), lists, REPORT_THRESHOLD) - 1)
    rest = (F.when(t.rlike(N.REPORT_TAG), "Tag")
            .when(N.is_pure_number(t), "Number")
            .when(t.rlike(N.REPORT_DATE) | t.rlike(N.REPORT_COORDINATES), "DateOrTime")
            .when(contains_any(t, vocabulary.words("global_blacklist", "ui_blacklist")), "UI")
            .otherwise("Unknown"))
    return F.coalesce(listed, rest)


def classify_report_blocks(blocks: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Adds ``block_type`` by the first report rule that hits."""
    return blocks.withColumn("block_type", report_type(F.col("txt"), vocabulary))


def is_npc_text(txt: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    return matches_any(txt, vocabulary.words("npc"), REPORT_THRESHOLD)


def page_type_detect(blocks: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """One row per page: Barbarian if any block names an NPC, else SingleBattle_PVP."""
    npc = blocks.groupBy("page_id").agg(F.bool_or(is_npc_text(F.col("txt"), vocabulary)).alias("npc"))
    return npc.select("page_id", F.when(F.col("npc"), "Barbarian").otherwise("SingleBattle_PVP").alias("page_type"))


def color_name(h: Column, s: Column, v: Column) -> Column:
    """Colour of a hue/saturation/value triple, NULL outside every range."""
    out = None
    for name, low, high in COLOR_RANGES:
        inside = h.between(low[0], high[0]) & s.between(low[1], high[1]) & v.between(low[2], high[2])
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def dominant_category(counts: DataFrame, key: str = "page_id", share: float = 0.05) -> DataFrame:
    """The colour with the largest count; Unknown below ``share`` of everything counted.

    One conditional sum per known colour, so a page's counts never meet before they are summed.
    """
    sums = counts.groupBy(key).agg(
        F.sum("cnt").alias("total"),
        *[F.coalesce(F.sum(F.when(F.col("color") == c, F.col("cnt"))), F.lit(0)).alias(c) for c in COLOR_ORDER])
    best = F.greatest(*COLOR_ORDER)
    name = F.when((best == 0) | (best < F.col("total") * share), "Unknown")
    for c in COLOR_ORDER:
        name = name.when(F.col(c) == best, c)
    return sums.select(key, name.alias("dominant"), best.alias("dominant_cnt"), "total")
