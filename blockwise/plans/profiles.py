"""Profile records: one row per page from its classified blocks.

Everything that depends on one block at a time is found in a single aggregate per page.  Fields that
need two blocks join the page's few anchors back to just the kind of block they can be read from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.functions import names, numbers
from blockwise.functions.geometry import distance, remapped, with_geometry
from blockwise.functions.text import first_matching_word, matches_any, similar_to_any
from blockwise.operators.classify import CIVILIZATION_THRESHOLD, LABEL_THRESHOLD, classify_profile_blocks
from blockwise.operators.neighbours import proximity_veto, right_neighbor_same_line, topk_nearest
from blockwise.operators.picks import first_by, first_struct
from blockwise.operators.rescans import accept_profile
from blockwise.session import stage
from blockwise.vocabulary import DEFAULT, Vocabulary

# The label list behind each anchor, and the limits of the field rules.
ANCHOR_LISTS = {"AllianceLabel": "alliance_labels", "PowerLabel": "power_labels",
                "KpLabel": "kill_points_labels", "CivLabel": "civilization_labels"}
MIN_STAT = 1000
SWAP_ABOVE = 1_500_000_000
UI_VETO_THRESHOLD = 0.8


def prepare(blocks: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Classified blocks with geometry in pixels, written once because every field reads them."""
    return stage(with_geometry(classify_profile_blocks(blocks, vocabulary)))


def anchor_lookup(blocks: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """anchors(page_id, anchor, ord, cx, cy, box): the first block per page that reads like each label."""
    hits = F.array(*[F.when(similar_to_any(F.col("txt"), vocabulary.words(words), LABEL_THRESHOLD), F.lit(name))
                     for name, words in ANCHOR_LISTS.items()])
    labelled = blocks.withColumn("anchor", F.explode(F.filter(hits, lambda a: a.isNotNull())))
    return first_by(labelled, ["page_id", "anchor"], [F.col("ord")], ["ord", "cx", "cy", "x0", "y0", "x1", "y2"])


def extract_id(blocks: DataFrame) -> DataFrame:
    """Id, its confidence and source per page: the first ID block, else a number that can be one."""
    agg = blocks.groupBy("page_id").agg(*_id_picks())
    return agg.select("page_id", *_id_columns()).filter(F.col("id_conf") > 0)


def _id_picks() -> list[Column]:
    value = numbers.player_id(F.col("txt"))
    fields = {"ord": F.col("ord"), "value": value, "cx": F.col("cx"), "cy": F.col("cy"), "txt": F.col("txt")}
    typed = first_struct(F.col("block_type") == "ID", [F.col("ord")], fields)
    plausible = (F.col("block_type").isin("Unknown", "Number") & (F.col("cy") < 600)
                 & (value > 1_000_000) & (value < 2_000_000_000))
    named_last = (~F.contains(F.upper("txt"), F.lit("ID"))).cast("int")
    return [typed.alias("_typed"), first_struct(plausible, [named_last, F.col("ord")], fields).alias("_guess")]


def _id_columns() -> list[Column]:
    pick = F.coalesce("_typed", "_guess")
    conf = F.when(F.col("_typed").isNotNull(), 95).when(F.col("_guess").isNotNull(), 70).otherwise(0)
    return [pick["value"].alias("id_value"), conf.alias("id_conf"), pick["ord"].alias("id_ord"),
            pick["cx"].alias("id_cx"), pick["cy"].alias("id_cy"), pick["txt"].alias("id_txt")]


def page_state(blocks: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """One row per page: label anchors, id, first tag and civilisation, in one aggregate."""
    spot = {"cx": F.col("cx"), "cy": F.col("cy"), "ord": F.col("ord")}
    labels = [first_struct(similar_to_any(F.col("txt"), vocabulary.words(words), LABEL_THRESHOLD), [F.col("ord")], spot).alias(name)
              for name, words in ANCHOR_LISTS.items()]
    said = {"ord": F.col("ord"), "txt": F.col("txt"), "cx": F.col("cx"), "cy": F.col("cy")}
    tag = first_struct(F.col("block_type") == "Tag", [F.col("ord")], said).alias("tag_block")
    civ = first_struct(F.col("block_type") == "Civilization", [F.col("ord")], said).alias("civ_block")
    return stage(blocks.groupBy("page_id").agg(*labels, *_id_picks(), tag, civ).select(
        "page_id", *ANCHOR_LISTS, *_id_columns(), "tag_block", "civ_block"))


def _numbers(blocks: DataFrame) -> DataFrame:
    return (blocks.filter(F.col("block_type") == "Number").withColumn("value", numbers.grouped_long(F.col("txt")))
            .filter(F.col("value") > MIN_STAT).select("page_id", "ord", "value", "cx", "cy"))


def _nearest_number(pairs: DataFrame, label: str, name: str) -> DataFrame:
    gap = distance(F.col("cx"), F.col("cy"), F.col(f"{label}.cx"), F.col(f"{label}.cy"))
    found = first_by(pairs.withColumn("gap", gap), ["page_id"], [F.col("gap"), F.col("ord")], ["value", "ord"])
    return found.select("page_id", F.col("value").alias(name), F.col("ord").alias(f"{name}_ord"))


def with_stats(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """Page state with power and kill points: the numbers over 1000 nearest to their labels.

    Kill points skip the block and the value that power took.
    """
    values = _numbers(blocks)
    with_id = values.join(state.select("page_id", "id_ord", "PowerLabel", "KpLabel"), "page_id")
    free = with_id.filter(F.col("id_ord").isNull() | (F.col("ord") != F.col("id_ord")))
    power = stage(_nearest_number(free.filter(F.col("PowerLabel").isNotNull()), "PowerLabel", "power"))
    taken = free.filter(F.col("KpLabel").isNotNull()).join(power, "page_id", "left")
    other = taken.filter(F.col("power").isNull() | ((F.col("value") != F.col("power")) & (F.col("ord") != F.col("power_ord"))))
    kills = _nearest_number(other, "KpLabel", "kill_points")
    zero = F.lit(0).cast("bigint")
    out = (state.join(power, "page_id", "left").join(kills, "page_id", "left")
           .withColumns({"power": F.coalesce("power", zero), "kill_points": F.coalesce("kill_points", zero)}))
    return stage(out)


CLAIMS = ["id_ord", "power_ord", "kill_points_ord"]


def _unclaimed(df: DataFrame, claims: list[str]) -> DataFrame:
    for c in claims:
        df = df.filter(F.col(c).isNull() | (F.col("ord") != F.col(c)))
    return df


def _valid_tag(parsed: Column) -> Column:
    return (F.length(parsed["tag"]) >= 2) & (parsed["tag"] != "--")


def alliance(blocks: DataFrame, state: DataFrame, claims: list[str]) -> DataFrame:
    """page_id, alliance_tag, alliance_name, alliance_conf, alliance_ord: bracketed tag first, then the label's surroundings."""
    unknown = blocks.filter(F.col("block_type") == "Unknown").select("page_id", "ord", "txt", "cx", "cy")
    tagged = state.withColumn("parsed", names.split_tag_and_name(F.col("tag_block.txt"))).filter(_valid_tag(F.col("parsed")))
    nameless = tagged.filter(F.col("parsed.name") == "").select(
        "page_id", F.col("tag_block.cx").alias("sx"), F.col("tag_block.cy").alias("sy"))
    beside = right_neighbor_same_line(nameless, unknown).select("page_id", names.clean_display_name(F.col("txt")).alias("beside"))
    direct = tagged.join(beside, "page_id", "left").select(
        "page_id", F.col("parsed.tag").alias("alliance_tag"), F.coalesce("beside", F.col("parsed.name")).alias("alliance_name"),
        F.lit(95).alias("alliance_conf"), F.col("tag_block.ord").alias("alliance_ord"))

    rest = state.join(tagged.select("page_id"), "page_id", "left_anti").filter(F.col("AllianceLabel").isNotNull())
    anchors = rest.select("page_id", F.col("AllianceLabel.cx").alias("ax"), F.col("AllianceLabel.cy").alias("ay"))
    pool = _unclaimed(unknown.join(rest.select("page_id", *claims), "page_id"), claims).drop(*claims)
    near = topk_nearest(anchors, pool, 3).withColumn("parsed", names.split_tag_and_name(F.col("txt")))
    is_label = F.contains(F.lower("txt"), F.lit("alianca")) | F.contains(F.lower("txt"), F.lit("alliance"))
    found = first_by(near.filter(~is_label & _valid_tag(F.col("parsed"))), ["page_id"], [F.col("rank")], ["parsed", "ord"])
    around = found.select("page_id", F.col("parsed.tag").alias("alliance_tag"), F.col("parsed.name").alias("alliance_name"),
                          F.lit(80).alias("alliance_conf"), F.col("ord").alias("alliance_ord"))
    return direct.unionByName(around)


def with_alliance(blocks: DataFrame, state: DataFrame) -> DataFrame:
    return stage(state.join(alliance(blocks, state, CLAIMS), "page_id", "left"))


def score_names(blocks: DataFrame, state: DataFrame, claims: list[str], vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Scored name candidates (page_id, ord, txt, score) with a positive score."""
    pool = blocks.filter(F.col("block_type").isin("Unknown", "Tag") & (F.length("txt") >= 3)).select("page_id", "ord", "txt", "cx", "cy")
    anchored = state.filter(F.col("id_conf") > 60).select("page_id", "id_cx", "id_cy", "id_txt", *[c for c in claims if c != "id_ord"], "id_ord")
    rows = _unclaimed(pool.join(anchored, "page_id"), claims)
    dy, dx = F.col("cy") - F.col("id_cy"), F.abs(F.col("cx") - F.col("id_cx"))
    rows = rows.filter((dy >= -20) & (dy <= 200)
                       & ~F.contains("txt", numbers.digits_only_int(F.col("id_txt")).cast("string"))
                       & ~matches_any(F.col("txt"), vocabulary.words("ui_keywords"), UI_VETO_THRESHOLD))
    bars = blocks.filter(F.col("block_type") == "BarStatus")
    rows = proximity_veto(rows, bars)
    score = (F.lit(100) - F.when(dx > 300, 50).otherwise(0)
             + F.when((dy > 0) & (dy < 120) & (dx < 150), 50).otherwise(0))
    return rows.select("page_id", "ord", "txt", score.alias("score"))


def best_name(scored: DataFrame) -> DataFrame:
    best = first_by(scored, ["page_id"], [-F.col("score"), F.col("ord")], ["txt", "score", "ord"])
    return best.select("page_id", names.clean_display_name(F.col("txt")).alias("name"),
                       F.col("score").alias("name_conf"), F.col("ord").alias("name_ord"))


RECORD = ["page_id", "id", "name", "alliance_tag", "alliance_name", "power", "kill_points", "civilization"]


def _records(blocks: DataFrame, vocabulary: Vocabulary, draft_id: int) -> DataFrame:
    """Unaudited profiles, and the fields that a page has an ``anchor`` to search by."""
    state = with_alliance(blocks, with_stats(blocks, page_state(blocks, vocabulary)))
    named = best_name(score_names(blocks, state, [*CLAIMS, "alliance_ord"], vocabulary))
    civ = F.coalesce(first_matching_word(F.col("civ_block.txt"), vocabulary.words("civilizations"), CIVILIZATION_THRESHOLD),
                     F.col("civ_block.txt"))
    has = {"Civilization": F.col("CivLabel").isNotNull(), "Power": F.col("PowerLabel").isNotNull(), "Name": F.col("id_conf") > 60}
    anchors = F.array_compact(F.array(*[F.when(there, F.lit(field)) for field, there in has.items()]))
    return state.join(named, "page_id", "left").select(
        "page_id",
        F.when(F.col("id_conf") > 60, F.col("id_value")).otherwise(F.lit(draft_id)).alias("id"),
        F.coalesce("name", F.lit("--")).alias("name"),
        F.coalesce("alliance_tag", F.lit("--")).alias("alliance_tag"),
        F.coalesce("alliance_name", F.lit("--")).alias("alliance_name"),
        "power", "kill_points", F.coalesce(civ, F.lit("--")).alias("civilization"), anchors.alias("anchors"))


def build_profiles(blocks: DataFrame, vocabulary: Vocabulary = DEFAULT, draft_id: int = 0) -> DataFrame:
    """Unaudited profiles from prepared blocks."""
    return _records(blocks, vocabulary, draft_id).select(*RECORD)


def audit_profiles(profiles: DataFrame) -> DataFrame:
    """Swaps implausible power with kill points, fills blanks, judges success and completeness; other columns stay."""
    swap = F.col("power") > SWAP_ABOVE
    power = F.when(swap, F.col("kill_points")).otherwise(F.col("power"))
    kills = F.when(swap, F.col("power")).otherwise(F.col("kill_points"))

    def filled(c: str) -> Column:
        return F.when(F.trim(F.col(c)) == "", F.lit("--")).otherwise(F.col(c)).alias(c)
    out = profiles.select("page_id", "id", filled("name"), filled("alliance_tag"), filled("alliance_name"),
                          power.alias("power"), kills.alias("kill_points"), "civilization", *[c for c in profiles.columns if c not in RECORD])
    return (out.withColumn("success", (F.col("id") > 0) & ((F.col("name") != "--") | (F.col("power") > 0)))
            .withColumn("complete", (F.col("id") > 0) & (F.col("power") > 0) & (F.col("name") != "--") & (F.col("civilization") != "--")))


# A page is read again at most twice, and a name shorter than this is searched for.
ROUNDS = 2
MIN_NAME = 3
#: In the order in which their blocks join a page's own.
SEARCHED = ["Civilization", "Power", "Name"]
#: Orders of rescanned blocks: beyond those of a page, by round, field and line.
_ROUND_ORD, _FIELD_ORD = 1_000_000, 10_000


# the label a field is searched by; a name is searched by the id
SEARCHED_BY = {"CivLabel": "Civilization", "PowerLabel": "Power", "KpLabel": "KillPoints", "AllianceLabel": "Alliance"}


def search_anchors(blocks: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """(page_id, ord, field, box): the block that each field's search regions are laid out from."""
    field = F.element_at(F.create_map(*[F.lit(x) for pair in SEARCHED_BY.items() for x in pair]), F.col("anchor"))
    corners = ["x0", "y0", "x1", "y2"]
    labels = anchor_lookup(blocks, vocabulary).select("page_id", "ord", field.alias("field"), *corners)
    ids = extract_id(blocks).filter(F.col("id_conf") > 60).select("page_id", F.col("id_ord").alias("ord"))
    return labels.unionByName(blocks.join(ids, ["page_id", "ord"]).select("page_id", "ord", F.lit("Name").alias("field"), *corners))


def search_requests(audited: DataFrame) -> DataFrame:
    """(page_id, field) of what an incomplete page lacks and has an anchor to search by."""
    lacks = {"Civilization": F.col("civilization") == "--", "Power": F.col("power") == 0,
             "Name": (F.col("id") > 0) & ((F.col("name") == "--") | (F.length("name") < MIN_NAME))}
    fields = F.filter("anchors", lambda a: F.array_contains(F.array(*[F.when(missing, F.lit(f)) for f, missing in lacks.items()]), a))
    return audited.filter(~F.col("complete")).select("page_id", F.explode(fields).alias("field"))


def search_answers(requests: DataFrame, rescans: DataFrame, round_: int) -> DataFrame:
    """Detections (page_id, ord, txt, conf, box) that a round adds: per request the first readable strategy, put on the page."""
    asked = rescans.filter(F.col("round") == round_).join(requests, ["page_id", "field"])
    read = accept_profile(asked, ["page_id", "field"], "line")
    place = F.array_position(F.array(*[F.lit(f) for f in SEARCHED]), F.col("field"))
    boxes = remapped(F.col("origin_x"), F.col("origin_y"), F.col("scale"))
    on_page = read.select("page_id", (F.lit(_ROUND_ORD) * round_ + place * _FIELD_ORD + F.col("line")).cast("int").alias("ord"), "txt", "conf", *boxes)
    return on_page.select("*", F.col("x2").alias("x1"), F.col("y0").alias("y1"))


def profiles_with_rescans(blocks: DataFrame, rescans: DataFrame, vocabulary: Vocabulary = DEFAULT, draft_id: int = 0) -> DataFrame:
    """Audited profiles; incomplete pages are extracted again, round by round, with the answers to what they lack.

    ``blocks`` are raw detections; ``rescans`` has page_id, round, field, shot, line, txt, conf, a box within the crop, and the
    crop's origin and scale.  A round looks only at the pages that the one before left incomplete and found something new for, so
    a page that is complete, or that a round adds nothing to, is done.  Pages hold fewer than a million blocks, crops fewer than
    ten thousand lines.
    """
    evidence = prepare(blocks, vocabulary)
    audited = stage(audit_profiles(_records(evidence, vocabulary, draft_id)))
    finished = []
    for round_ in range(1, ROUNDS + 1):
        # incomplete pages are few, and each round's are among those before
        answers = prepare(search_answers(search_requests(audited), rescans, round_), vocabulary)
        again = answers.select("page_id").distinct()
        finished.append(audited.join(again, "page_id", "left_anti"))
        common = [c for c in evidence.columns if c in answers.columns]
        evidence = stage(evidence.join(again, "page_id", "left_semi").select(*common).unionByName(answers.select(*common)))
        audited = stage(audit_profiles(_records(evidence, vocabulary, draft_id)))
    out = audited
    for done in reversed(finished):
        out = done.unionByName(out)
    return out.drop("anchors")


class FieldExtractors:
    """Named extractors run in order; blocks one of them claims are hidden from those after it.

    An extractor takes (blocks, anchors, results so far) and returns (page_id, value, confidence, src_ord).
    """

    def __init__(self) -> None:
        self._steps: list[tuple[str, Callable[[DataFrame, DataFrame, dict[str, DataFrame]], DataFrame], bool]] = []

    def register(self, name: str, extractor: Callable[[DataFrame, DataFrame, dict[str, DataFrame]], DataFrame],
                 claims: bool = True) -> "FieldExtractors":
        self._steps.append((name, extractor, claims))
        return self

    def run(self, blocks: DataFrame, anchors: DataFrame) -> DataFrame:
        """One row per page with a value and confidence column per field.

        What an extractor finds is written once: it is needed for the result and by all extractors after it, whose
        plans would otherwise repeat those before.
        """
        out, left, done = blocks.select("page_id").distinct(), blocks, {}
        for name, extractor, claims in self._steps:
            found = stage(extractor(left, anchors, done))
            done[name] = found
            out = out.join(found.select("page_id", F.col("value").alias(name), F.col("confidence").alias(f"{name}_conf")), "page_id", "left")
            if claims:
                taken = found.select("page_id", F.col("src_ord").alias("ord"))
                left = left.join(taken, ["page_id", "ord"], "left_anti")
        return out
