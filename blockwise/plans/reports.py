"""Battle reports: both sides, audit, warnings and score per page."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwise.functions import names, numbers
from blockwise.functions.geometry import in_region, with_geometry
from blockwise.functions.text import contains_any, similarity
from blockwise.operators.classify import classify_report_blocks, is_npc_text
from blockwise.operators.dictionary_match import entity_resolution_topk
from blockwise.operators.filters import SIDES, low_confidence_numbers, side_split
from blockwise.operators.neighbours import IDENTITY_REACH, METRIC_REACH, NAME_REACH, nearest_in_direction
from blockwise.operators.picks import first_by, first_struct
from blockwise.operators.rescans import repair_assignment
from blockwise.session import FILE_ROWS, stage
from blockwise.vocabulary import DEFAULT, METRIC_LISTS, Vocabulary

# Output column per metric label, zones of the page and default start of the metrics.
METRIC_COLUMNS = {"UnitsLabel": "total_units", "HealedLabel": "healed", "DeadLabel": "dead",
                  "SevereWoundedLabel": "severely_wounded", "SlightlyWoundedLabel": "slightly_wounded",
                  "RemainingLabel": "remaining", "KillPointsLabel": "kill_points", "WatchtowerLabel": "watchtower_damage"}
HEADER_BOTTOM = 0.4
LEVEL_ZONE = (0.05, 0.70)
NAME_ZONE = {"attacker": (0.22, 0.48), "defender": (0.55, 0.88)}
NAME_HEIGHT = (0.08, 0.28)
DEFAULT_START = 0.4
CASUALTY = ["dead", "severely_wounded", "slightly_wounded", "remaining", "watchtower_damage"]


def prepare(blocks: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Classified blocks with normalised geometry; needs canvas_w and canvas_h."""
    return stage(with_geometry(classify_report_blocks(blocks, vocabulary), F.col("canvas_w"), F.col("canvas_h")), FILE_ROWS)


def _region(min_x, max_x, min_y, max_y) -> Column:
    return in_region(min_x, max_x, min_y, max_y, F.col("canvas_w"), F.col("canvas_h"))


def by_page(rows: DataFrame) -> DataFrame:
    """Rows that a join by page shuffles and sorts: a few columns of a row per page look small enough to be broadcast by the size of
    their files, which says little of what they take on the driver."""
    return rows.hint("merge")


def page_state(blocks: DataFrame, as_of_year: int, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """One row per page with everything that depends on one block at a time."""
    txt, kind, by_ord = F.col("txt"), F.col("block_type"), [F.col("ord")]
    # what a block may be picked as: its condition, order and payload
    picks = {
        "start": ((kind == "StatusResult") | contains_any(txt, vocabulary.words("victory", "defeat")), by_ord, {"ny": F.col("ny")}),
        "npc_block": (contains_any(txt, vocabulary.words("npc")), by_ord, {"txt": F.trim(txt)}),
        "percent": (F.contains(txt, F.lit("%")) & (F.col("nx") > 0.5), by_ord, {"txt": txt}),
        "dated": (txt.rlike(numbers.PAGE_DATE), by_ord, {"ts": numbers.page_timestamp(txt, as_of_year)}),
        "placed": (txt.rlike(numbers.PAGE_COORDINATES), by_ord, {"xy": numbers.page_coordinates(txt)}),
    }
    for side, low, high in SIDES:
        bracket = (kind != "UI") & (F.contains(txt, F.lit("[")) | F.contains(txt, F.lit("]")))
        picks[f"{side}_tag"] = (bracket & _region(low, high, 0.0, HEADER_BOTTOM), [-F.col("conf"), F.col("ord")],
                                {"ord": F.col("ord"), "txt": txt, "nx": F.col("nx"), "ny": F.col("ny")})
        zone = (F.col("nx").between(*NAME_ZONE[side]) & (F.col("ny") > NAME_HEIGHT[0]) & (F.col("ny") < NAME_HEIGHT[1])
                & (kind == "Unknown"))
        picks[f"{side}_loose"] = (zone & names.is_player_name(txt, vocabulary), [F.col("ny"), F.col("ord")], {"txt": txt})
    # texts are aggregated by sorting, so only blocks that may be picked go there
    chosen = blocks.withColumns({f"_{name}": F.coalesce(hit, F.lit(False)) for name, (hit, _, _) in picks.items()}).filter(
        reduce(or_, [F.col(f"_{name}") for name in picks]))
    found = chosen.groupBy(F.col("page_id").alias("_page")).agg(*[
        first_struct(F.col(f"_{name}"), order, payload).alias(name) for name, (_, order, payload) in picks.items()])
    every = blocks.groupBy("page_id").agg(F.bool_or(is_npc_text(txt, vocabulary)).alias("npc"),
                                          F.avg("conf").alias("mean_conf"), F.bool_and("isolated").alias("isolated"))
    state = every.join(found, F.col("page_id").eqNullSafe(F.col("_page")), "left").drop("_page")
    return stage(state.withColumn("page_type", F.when(F.col("npc"), "Barbarian").otherwise("SingleBattle_PVP"))
            .withColumn("start_y", F.coalesce("start.ny", F.lit(DEFAULT_START)))
            .withColumn("report_ts", F.col("dated.ts"))
            .withColumn("coordinates", F.coalesce("placed.xy", F.lit("--"))))


def metric_labels(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """First label block per page, side and metric, below the outcome line."""
    labels = blocks.filter(F.col("block_type").isin([t for _, t in METRIC_LISTS]))
    placed = side_split(labels.join(by_page(state.select("page_id", "start_y")), "page_id"), F.col("canvas_w"))
    y = F.col("y0") / F.when(F.col("canvas_h") > 0, F.col("canvas_h"))
    return first_by(placed.filter(y.between(F.col("start_y"), F.lit(1.0))), ["page_id", "side", "block_type"],
                    [F.col("ord")], ["ord", "txt", "nx", "ny"])


def _neighbours(blocks: DataFrame, state: DataFrame, labels: DataFrame) -> DataFrame:
    """Right neighbours of the metric labels and of the header tags, in one search."""
    label_sources = labels.select("page_id", "side", F.col("block_type").alias("what"), F.col("ord").alias("src_ord"), "nx", "ny",
                                  F.lit(METRIC_REACH).alias("reach"))
    tags = state.select("page_id", F.inline(F.array(*[
        F.struct(F.lit(s).alias("side"), F.lit("tag").alias("what"), F.col(f"{s}_tag.ord").alias("src_ord"),
                 F.col(f"{s}_tag.nx").alias("nx"), F.col(f"{s}_tag.ny").alias("ny"), F.lit(NAME_REACH).alias("reach"))
        for s, _, _ in SIDES]))).filter(F.col("src_ord").isNotNull())
    return nearest_in_direction(label_sources.unionByName(tags), by_page(blocks), "right", "reach",
                                ["page_id", "side", "what", "src_ord"], ["txt"])


def label_values(labels: DataFrame, neighbours: DataFrame, vocabulary: Vocabulary = DEFAULT, fix_multi_group: bool = True) -> DataFrame:
    """page_id, side, block_type, value: the label's own number, or its right neighbour's if that is at most 1."""
    own = labels.select("page_id", "side", "block_type", numbers.suffixed_number(F.col("txt"), vocabulary, fix_multi_group).alias("own"))
    beside = neighbours.filter(F.col("what") != "tag").select(
        "page_id", "side", F.col("what").alias("block_type"),
        numbers.suffixed_number(F.col("txt"), vocabulary, fix_multi_group).alias("beside"))
    return own.join(beside, ["page_id", "side", "block_type"], "left").select(
        "page_id", "side", "block_type",
        F.when(F.col("own") <= 1, F.coalesce("beside", "own")).otherwise(F.col("own")).alias("value"))


def metric_pivot(values: DataFrame) -> DataFrame:
    """One row per page and side, one column per metric; absent metrics are 0."""
    zero = F.lit(0).cast("bigint")
    return values.groupBy("page_id", "side").agg(*[
        F.coalesce(F.max(F.when(F.col("block_type") == kind, F.col("value"))), zero).alias(column)
        for kind, column in METRIC_COLUMNS.items()])


def level_names(blocks: DataFrame) -> DataFrame:
    """page_id, side, ord, ny, raw_name for blocks with a level marker."""
    y = F.col("y0") / F.when(F.col("canvas_h") > 0, F.col("canvas_h"))
    marked = blocks.filter((F.col("block_type") != "UI") & names.is_level_text(F.col("txt")) & y.between(*LEVEL_ZONE))
    marked = marked.withColumn("rest", names.without_level(F.col("txt")))
    bare = marked.filter(F.col("rest") == "").select("page_id", F.col("ord").alias("src_ord"), "nx", "ny")
    beside = nearest_in_direction(bare, blocks, "right", NAME_REACH, payload=["txt", "block_type"])
    beside = beside.filter(F.col("block_type") == "Unknown").select("page_id", F.col("src_ord").alias("ord"), F.col("txt").alias("beside"))
    named = marked.join(beside, ["page_id", "ord"], "left").withColumn(
        "raw_name", names.without_leading_digits(F.when(F.col("rest") == "", F.coalesce("beside", F.lit(""))).otherwise(F.col("rest"))))
    return side_split(named.filter(F.trim("raw_name") != ""), F.col("canvas_w")).select("page_id", "side", "ord", "ny", "raw_name")


def distinct_topk(entries: DataFrame, k: int = 2) -> DataFrame:
    """The k topmost distinct entries per page and side, with their ``rank``.

    Copies of an entry collapse before ranking, so a side has at most as many rows as the dictionary.
    """
    once = first_by(entries, ["page_id", "side", "entry_id"], [F.col("ny"), F.col("ord")], ["ny", "ord"])
    w = Window.partitionBy("page_id", "side").orderBy("ny", "ord")
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def side_entities(blocks: DataFrame, state: DataFrame, entities: DataFrame, npcs: DataFrame) -> DataFrame:
    """page_id, side, primary_id, secondary_id from the dictionary that applies to the side."""
    raw = stage(level_names(blocks).join(by_page(state.select("page_id", "npc")), "page_id"))
    scope = F.when(F.col("npc") & (F.col("side") == "defender"), "npc").otherwise("player")
    columns = ["entry_id", "entry_ord", "label", "label_ord"]
    both = entities.select(F.lit("player").alias("scope"), *columns).unionByName(npcs.select(F.lit("npc").alias("scope"), *columns))
    top = distinct_topk(entity_resolution_topk(raw.withColumn("scope", scope), both, "raw_name", within=["scope"]))
    return top.groupBy("page_id", "side").agg(
        F.max(F.when(F.col("rank") == 1, F.col("entry_id"))).alias("primary_id"),
        F.max(F.when(F.col("rank") == 2, F.col("entry_id"))).alias("secondary_id"))


def build_battle_sides(blocks: DataFrame, state: DataFrame, entities: DataFrame, npcs: DataFrame,
                       vocabulary: Vocabulary = DEFAULT, fix_multi_group: bool = True) -> DataFrame:
    """One row per page and side."""
    labels = stage(metric_labels(blocks, state))
    neighbours = stage(_neighbours(blocks, state, labels))
    metrics = metric_pivot(label_values(labels, neighbours, vocabulary, fix_multi_group))
    beside = neighbours.filter(F.col("what") == "tag").select("page_id", "side", F.col("txt").alias("beside"))
    parties = side_entities(blocks, state, entities, npcs)
    canonical = entities.groupBy("entry_id").agg(F.first("canonical").alias("primary_name"))

    header = state.select("page_id", "npc", "npc_block", "percent", F.inline(F.array(*[
        F.struct(F.lit(s).alias("side"), F.col(f"{s}_tag.txt").alias("tag_txt"), F.col(f"{s}_loose.txt").alias("loose"))
        for s, _, _ in SIDES])))
    rows = (header.join(beside, ["page_id", "side"], "left").join(metrics, ["page_id", "side"], "left")
            .join(parties, ["page_id", "side"], "left").join(canonical, F.col("primary_id") == canonical["entry_id"], "left").drop("entry_id"))
    is_npc = F.col("npc") & (F.col("side") == "defender")
    # each step stands in a column of its own, so that what is costly is worked out once
    rows = rows.withColumns({"is_npc": is_npc, "parsed": names.split_tag_rigid(F.col("tag_txt"))})
    own = F.when(F.col("is_npc"), F.coalesce("npc_block.txt", F.lit("NPC_Entity")))
    own = (own.when(names.is_player_name(F.col("parsed.suffix"), vocabulary), names.clean_player_name(F.col("parsed.suffix")))
           .when(names.is_player_name(F.col("beside"), vocabulary), names.clean_player_name(F.col("beside")))
           .otherwise(F.coalesce(names.clean_player_name(F.col("loose")), F.lit("--"))))
    rows = rows.withColumn("own_name", own)
    rows = rows.withColumn("shown", F.when(F.trim("own_name") == "", F.lit("--")).otherwise(F.col("own_name")))
    own_hero = (F.col("side") == "attacker") & F.col("primary_name").isNotNull() & F.contains("shown", "primary_name")
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "page_id", "side", "is_npc",
        F.when(F.col("is_npc") | F.col("tag_txt").isNull(), F.lit("--")).otherwise(F.col("parsed.tag")).alias("alliance_tag"),
        F.when(own_hero, F.lit("--")).otherwise(F.col("shown")).alias("governor_name"), "primary_id", "secondary_id",
        *[F.coalesce(c, zero).alias(c) for c in METRIC_COLUMNS.values()],
        F.when(F.col("is_npc"), F.coalesce(numbers.damage_percent(F.col("percent.txt")), F.lit(0.0))).alias("damage_percent"),
        F.when(F.col("is_npc"), numbers.first_number_int(F.col("shown"))).alias("entity_level"))


# --- audit of a side, and of a page whose sides stand next to each other ---------------------------

def imbalance(prefix: str = "") -> Column:
    """total + healed minus everything the units became."""
    spent = sum((F.col(prefix + c) for c in CASUALTY), F.lit(0).cast("bigint"))
    return F.col(prefix + "total_units") + F.col(prefix + "healed") - spent


def is_balanced(prefix: str = "") -> Column:
    return (F.col(prefix + "total_units") > 0) & (F.abs(imbalance(prefix)) <= 1)


def casualty_rate(prefix: str = "") -> Column:
    total = F.col(prefix + "total_units")
    return F.when(total > 0, (F.col(prefix + "dead") + F.col(prefix + "severely_wounded")) / total).otherwise(F.lit(0.0))


def side_by_side(sides: DataFrame, columns: list[str]) -> DataFrame:
    """One row per page, attacker columns under a_ and defender columns under d_."""
    return sides.groupBy("page_id").agg(*[
        F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side[0]}_{c}") for side, _, _ in SIDES for c in columns])


def is_sound(npc: Column) -> Column:
    return is_balanced("a_") & (npc | is_balanced("d_"))


def balance_audit_log(sides: DataFrame) -> DataFrame:
    """A warning for every player side whose sums differ at all."""
    off = sides.filter(~F.col("is_npc") & (F.col("total_units") > 0) & (imbalance() != 0))
    text = F.format_string("[Math Mismatch] %s: Difference of %d units.", F.initcap("side"), F.abs(imbalance()))
    return off.select("page_id", "side", text.alias("message"))


def sanity_warnings(pages: DataFrame) -> DataFrame:
    """page_id, seq, code: the rules a page breaks, in rule order."""
    no_name = F.col("a_governor_name") == "--"
    unsound = ~F.col("sound")
    rules = [
        ("WARN_IMAGE_NOT_ISOLATED", ~F.col("isolated")),
        ("WARN_UNSUPPORTED_CHARACTERS", (F.col("a_alliance_tag") != "--") & no_name),
        ("WARN_DATA_MISSING_TOTAL_UNITS", unsound & (F.col("a_total_units") == 0)),
        ("WARN_MATH_MISMATCH", unsound & (F.col("a_total_units") != 0)),
        ("WARN_NAME_IDENTIFICATION_FAILED", no_name & (F.col("a_total_units") > 0)),
        ("WARN_DUPLICATE_NAMES", (similarity(F.col("a_governor_name"), F.col("d_governor_name")) > 0.80) & ~no_name),
        ("WARN_HEADER_READ_AS_NAME", F.contains("a_governor_name", "a_alliance_tag") & (F.col("a_alliance_tag") != "--")),
    ]
    listed = F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(i + 1).alias("seq"), F.lit(code).alias("code")))
                       for i, (code, hit) in enumerate(rules)])
    return pages.withColumn("warnings", F.filter(listed, lambda w: w.isNotNull()))


def fields_found() -> Column:
    return sum((F.when(c, 1).otherwise(0) for c in (
        F.col("a_governor_name") != "--", F.col("a_alliance_tag") != "--",
        F.col("a_primary_id").isNotNull(), F.col("d_governor_name") != "--")), F.lit(0))


def quality_score() -> Column:
    """0-100 from arithmetic, reading confidence, filled fields, isolation and penalties."""
    gap, total = F.abs(imbalance("a_")), F.col("a_total_units")
    near = F.when((gap > 0) & (total > 0), F.greatest(F.lit(0.0), (F.lit(1) - gap / total) * 25)).otherwise(F.lit(0.0))
    identity = F.exists("warnings", lambda w: w["code"].isin("WARN_DUPLICATE_NAMES", "WARN_HEADER_READ_AS_NAME"))
    raw = (F.when(F.col("sound"), F.lit(50.0)).otherwise(near)
           + F.coalesce("mean_conf", F.lit(0.0)) * 100 * 0.20
           + fields_found() * 5
           + F.when(F.col("isolated"), 10).otherwise(0)
           - F.when(F.col("a_governor_name") == "--", 20).otherwise(0)
           - F.when(identity, 40).otherwise(0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


PAGE_COLUMNS = ["governor_name", "alliance_tag", "primary_id", *METRIC_COLUMNS.values()]


def page_rows(state: DataFrame, sides: DataFrame) -> DataFrame:
    """Page facts joined to both sides, with soundness and warnings."""
    wide = side_by_side(sides, PAGE_COLUMNS)
    pages = state.select("page_id", "page_type", "npc", "isolated", "mean_conf", "report_ts", "coordinates").join(by_page(wide), "page_id")
    return sanity_warnings(pages.withColumn("sound", is_sound(F.col("npc"))))


def assemble_reports(state: DataFrame, sides: DataFrame) -> DataFrame:
    """One row per page: type, outcome, soundness, score and number of warnings."""
    pages = page_rows(state, sides).withColumn("overall_confidence", quality_score())
    wins = (F.col("d_remaining") == 0) & (F.col("a_remaining") > 0)
    return pages.select("page_id", "page_type", "report_ts", "coordinates", "isolated", "sound", wins.alias("attacker_wins"),
                        casualty_rate("a_").alias("attacker_casualty_rate"), casualty_rate("d_").alias("defender_casualty_rate"),
                        "overall_confidence", "warnings", "a_governor_name", "d_governor_name", "a_total_units", "d_total_units")


def report_warnings(reports: DataFrame) -> DataFrame:
    return reports.select("page_id", F.inline("warnings"))


def build_reports(blocks: DataFrame, entities: DataFrame, npcs: DataFrame, as_of_year: int,
                  rescans: DataFrame | None = None, vocabulary: Vocabulary = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(reports, battle_sides); with rescans, pages that do not add up are read again once.

    Each repair replaces a number by the surest rescan of its own region, so a second round over the same
    rescans cannot change anything and is not run.  Block types are not recomputed after a repair.
    """
    prepared = prepare(blocks, vocabulary)
    state = page_state(prepared, as_of_year, vocabulary)
    sides = stage(build_battle_sides(prepared, state, entities, npcs, vocabulary))
    if rescans is not None:
        failing = page_rows(state, sides).filter(~F.col("sound")).select("page_id")
        unsure = low_confidence_numbers(prepared, failing)
        fixes = stage(repair_assignment(unsure, rescans).filter("repaired").select(
            "page_id", "ord", F.col("txt").alias("_txt"), F.col("conf").alias("_conf")))
        touched = fixes.select("page_id").distinct()
        again = stage(prepared.join(touched, "page_id", "left_semi").join(fixes, ["page_id", "ord"], "left")
                 .withColumn("txt", F.coalesce("_txt", "txt")).withColumn("conf", F.coalesce("_conf", "conf")).drop("_txt", "_conf"))
        state2 = page_state(again, as_of_year, vocabulary)
        sides2 = build_battle_sides(again, state2, entities, npcs, vocabulary)
        state = state.join(touched, "page_id", "left_anti").unionByName(state2)
        sides = sides.join(touched, "page_id", "left_anti").unionByName(sides2)
    return assemble_reports(state, sides), sides


def identity_fallback(blocks: DataFrame) -> DataFrame:
    """page_id, side, name: on sides without a header tag, the block above the units label; "--" otherwise."""
    y = F.col("y0") / F.when(F.col("canvas_h") > 0, F.col("canvas_h"))
    header = side_split(blocks.filter(y.between(0.05, HEADER_BOTTOM) & F.col("block_type").isin("Tag", "UnitsLabel")), F.col("canvas_w"))
    picked = header.groupBy("page_id", "side").agg(
        F.bool_or(F.col("block_type") == "Tag").alias("tagged"),
        first_struct(F.col("block_type") == "UnitsLabel", [F.col("ord")],
                     {"ord": F.col("ord"), "nx": F.col("nx"), "ny": F.col("ny")}).alias("units"))
    sources = picked.filter(~F.col("tagged")).select("page_id", "side", F.col("units.ord").alias("src_ord"), F.col("units.nx").alias("nx"), F.col("units.ny").alias("ny"))
    above = nearest_in_direction(sources, blocks, "up", IDENTITY_REACH, ["page_id", "side", "src_ord"], ["txt"])
    pages = blocks.select("page_id").distinct().select("page_id", F.explode(F.array(*[F.lit(s) for s, _, _ in SIDES])).alias("side"))
    return pages.join(above.select("page_id", "side", F.col("txt").alias("name")), ["page_id", "side"], "left").fillna("--", ["name"])
