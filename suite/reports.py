"""Battle report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockwise.functions import names, numbers
from blockwise.operators.classify import classify_report_blocks, page_type_detect
from blockwise.operators.filters import low_confidence_numbers, side_split
from blockwise.operators.neighbours import nearest_around
from blockwise.operators.picks import first_by
from blockwise.operators.rollups import mean_confidence
from blockwise.plans import reports as R
from blockwise.vocabulary import METRIC_LISTS
from blockwise.functions.geometry import in_region
from blockwise.session import stage
from suite import fixtures as FX
from suite import sql as S

Q, SQL = {}, {}
REPORT = FX.sql("report", "duckdb")
YEAR = 2024


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f
    return add


def raw(spark, sf):
    return FX.blocks(spark, sf, "report").withColumns({"canvas_w": F.lit(1000), "canvas_h": F.lit(1000)})


def prepared(spark, sf):
    return R.prepare(raw(spark, sf))


def dictionaries(spark, sf):
    d = "(" + FX.DICTIONARY + ")"
    FX.load(spark, sf, "part").createOrReplaceTempView("part")
    return (spark.sql(S.ENTITIES.format(dict=d[1:-1])), spark.sql(S.NPCS.format(dict=d[1:-1])))


def sides_of(spark, sf):
    blocks = prepared(spark, sf)
    state = R.page_state(blocks, YEAR)
    return state, stage(R.build_battle_sides(blocks, state, *dictionaries(spark, sf)))


def pages_of(spark, sf):
    return R.page_rows(*sides_of(spark, sf))


@query("region_filter", f"with fx as (select *, case when page_id%70=0 then 0 else 1000 end cw from ({REPORT})) select page_id, ord from fx where cw > 0 and x0/1000e0 between 0.1e0 and 0.6e0 and y0/1000e0 between 0.05e0 and 0.5e0")
def _(spark, sf):
    canvas = F.when(F.col("page_id") % 70 == 0, 0).otherwise(1000)
    return FX.load(spark, sf, "report").filter(in_region(0.1, 0.6, 0.05, 0.5, canvas, canvas)).select("page_id", "ord")


@query("side_split", f"with fx as (select page_id, ord, x0 + case when ord=1 then 260 else 0 end x0 from ({REPORT})) select page_id, ord, side from fx cross join {S.SIDES} where x0/1000e0 between lo and hi")
def _(spark, sf):
    fx = FX.load(spark, sf, "report").withColumn("x0", F.col("x0") + F.when(F.col("ord") == 1, 260).otherwise(0))
    return side_split(fx, F.lit(1000)).select("page_id", "ord", "side")


@query("digit_predicates", rf"with fx as ({REPORT}) select page_id, ord, {S.pure_number('txt')} pure_number, regexp_matches(txt,'\d') any_digit, regexp_matches(txt,'^\d+$') digits_only from fx")
def _(spark, sf):
    t = F.col("txt")
    return FX.load(spark, sf, "report").select("page_id", "ord", numbers.is_pure_number(t).alias("pure_number"),
                                               numbers.has_digit(t).alias("any_digit"), numbers.is_digits(t).alias("digits_only"))


@query("classify_report_blocks", f"with {S.report_ctes()} select page_id, ord, txt, block_type from rtyped")
def _(spark, sf):
    return classify_report_blocks(FX.load(spark, sf, "report")).select("page_id", "ord", "txt", "block_type")


@query("page_type_detect", f"with {S.report_ctes()} select page_id, case when bool_or(npc_like) then 'Barbarian' else 'SingleBattle_PVP' end page_type from rtyped group by 1")
def _(spark, sf):
    return page_type_detect(FX.load(spark, sf, "report"))


_DIRS = [("right", 0.45), ("left", 0.3), ("down", 0.3), ("up", 0.2)]


@query("directional_neighbor", f"with {S.report_ctes()}, src as (select *, ord src_ord from rtyped where block_type in ('Tag','UnitsLabel','StatusResult'))"
       + " union all ".join(f" select '{d}' direction, page_id, src_ord, t_ord ord, t_txt txt from {S.neighbour(f'(select *, {r}e0 reach from src)', d, 'page_id, src_ord')}" for d, r in _DIRS))
def _(spark, sf):
    blocks = prepared(spark, sf)
    sources = blocks.filter(F.col("block_type").isin("Tag", "UnitsLabel", "StatusResult")).withColumn("src_ord", F.col("ord"))
    return nearest_around(sources, blocks, dict(_DIRS)).select("direction", "page_id", "src_ord", "ord", "txt")


@query("mean_confidence", f"with fx as ({REPORT}) select page_id, round(avg(conf), 6) mean_conf from fx group by 1")
def _(spark, sf):
    return mean_confidence(FX.load(spark, sf, "report")).select("page_id", F.round("mean_conf", 6).alias("mean_conf"))


@query("first_in_order", f"with {S.report_ctes()} select page_id, arg_min(ord, ord) ord, arg_min(txt, ord) txt from rtyped where block_type='Number' group by 1")
def _(spark, sf):
    blocks = classify_report_blocks(FX.load(spark, sf, "report"))
    return first_by(blocks.filter(F.col("block_type") == "Number"), ["page_id"], [F.col("ord")], ["ord", "txt"])


@query("best_bracket_block", f"with {S.report_chain()} select page_id, side, src_ord, tag_txt from tags")
def _(spark, sf):
    state = R.page_state(prepared(spark, sf), YEAR)
    both = F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_tag.ord").alias("src_ord"), F.col(f"{s}_tag.txt").alias("tag_txt")) for s in ("attacker", "defender")]))
    return state.select("page_id", both).filter(F.col("src_ord").isNotNull())


_RT, _RS = S.split_rigid("t")


@query("split_tag_rigid", f"with fx as (select page_id, ord, trim(case ord%3 when 0 then txt when 1 then replace(txt,'[','') else replace(txt,']','') end) t from ({REPORT})) select page_id, ord, {_RT} tag, {_RS} suffix from fx")
def _(spark, sf):
    text = F.expr("case ord%3 when 0 then txt when 1 then replace(txt,'[','') else replace(txt,']','') end")
    return FX.load(spark, sf, "report").select("page_id", "ord", names.split_tag_rigid(text).alias("p")).select("page_id", "ord", "p.tag", "p.suffix")


_NOISY = "case ord%5 when 0 then txt || 'K' when 1 then txt when 2 then txt || ',123' when 3 then 'Units ' || txt || ',500,250' else replace(txt,'1','l') || 'M' end"


@query("parse_suffixed_number", f"with fx as (select page_id, ord, {_NOISY} t from ({REPORT})), d as (select t, {S.suffixed_number('t')} val, {S.suffixed_number('t', False)} val_strict from (select distinct t from fx)) select page_id, ord, val, val_strict from fx join d using (t)")
def _(spark, sf):
    t = F.expr(_NOISY)
    return FX.load(spark, sf, "report").select("page_id", "ord", numbers.suffixed_number(t).alias("val"),
                                               numbers.suffixed_number(t, fix_multi_group=False).alias("val_strict"))


def _label_values(spark, sf):
    blocks = prepared(spark, sf)
    state = R.page_state(blocks, YEAR)
    labels = stage(R.metric_labels(blocks, state))
    return R.label_values(labels, R._neighbours(blocks, state, labels))


@query("label_value", f"with {S.report_chain()} select page_id, side, block_type, v val from vals")
def _(spark, sf):
    return _label_values(spark, sf).withColumnRenamed("value", "val")


@query("metric_pivot", f"with {S.report_chain()} select * from mets")
def _(spark, sf):
    return R.metric_pivot(_label_values(spark, sf))


@query("strip_level_prefix", f"with {S.report_chain()} select page_id, side, ord, raw_name from levs")
def _(spark, sf):
    return R.level_names(prepared(spark, sf)).select("page_id", "side", "ord", "raw_name")


@query("distinct_topk", f"with {S.report_chain()} select page_id, side, primary_id, secondary_id from party")
def _(spark, sf):
    blocks = prepared(spark, sf)
    return R.side_entities(blocks, R.page_state(blocks, YEAR), *dictionaries(spark, sf))


@query("player_name_rules", f"with {S.report_ctes()} select page_id, ord, nameable, {S.bare_name('txt')} cleaned from rtyped")
def _(spark, sf):
    t = F.col("txt")
    return FX.load(spark, sf, "report").select("page_id", "ord", names.is_player_name(t).alias("nameable"), names.clean_player_name(t).alias("cleaned"))


@query("npc_metrics", f"with {S.report_chain()} select page_id, governor_name, damage_percent, entity_level from bsides where is_npc")
def _(spark, sf):
    return sides_of(spark, sf)[1].filter("is_npc").select("page_id", "governor_name", "damage_percent", "entity_level")


_DATE = r"regexp_extract(dated, '(\d{2,4}[/-]\d{2}([/-]\d{2,4})?)', 1)"


@query("page_metadata", f"""with {S.report_chain()}, m as (select page_id, replace(case when length({_DATE}) <= 5 then '{YEAR}/' || {_DATE} else {_DATE} end, '-', '/') d, placed from pg)
  select page_id, try_strptime(d, '%Y/%m/%d') report_ts, coalesce('X:' || regexp_extract(placed, '(?i)X:?\\s*(\\d+)\\D*Y:?\\s*(\\d+)', 1) || ' Y:' || regexp_extract(placed, '(?i)X:?\\s*(\\d+)\\D*Y:?\\s*(\\d+)', 2), '--') coordinates from m""")
def _(spark, sf):
    return R.page_state(prepared(spark, sf), YEAR).select("page_id", "report_ts", "coordinates")


@query("build_battle_sides", f"with {S.report_chain()} select * from bsides")
def _(spark, sf):
    return sides_of(spark, sf)[1]


@query("balance_check", f"with {S.report_chain()} select page_id, sound, abs(a_gap) attacker_gap from rpages")
def _(spark, sf):
    return pages_of(spark, sf).select("page_id", "sound", F.abs(R.imbalance("a_")).alias("attacker_gap"))


@query("balance_audit_log", f"""with {S.report_chain()}, g as (select page_id, side, total_units+healed-(dead+severely_wounded+slightly_wounded+remaining+watchtower_damage) gap from bsides where not is_npc and total_units > 0)
  select page_id, side, '[Math Mismatch] ' || upper(side[1]) || side[2:] || ': Difference of ' || cast(abs(gap) as varchar) || ' units.' message from g where gap <> 0""")
def _(spark, sf):
    return R.balance_audit_log(sides_of(spark, sf)[1])


@query("casualty_and_outcome", f"with {S.report_chain()} select page_id, d_remaining = 0 and a_remaining > 0 attacker_wins, round(case when a_total_units > 0 then (a_dead+a_severely_wounded)/a_total_units::double else 0 end, 9) attacker_casualty_rate, round(case when d_total_units > 0 then (d_dead+d_severely_wounded)/d_total_units::double else 0 end, 9) defender_casualty_rate from rpages")
def _(spark, sf):
    r = R.assemble_reports(*sides_of(spark, sf))
    return r.select("page_id", "attacker_wins", F.round("attacker_casualty_rate", 9).alias("attacker_casualty_rate"), F.round("defender_casualty_rate", 9).alias("defender_casualty_rate"))


@query("sanity_rules", f"with {S.report_chain()} select page_id, seq, code from warn")
def _(spark, sf):
    return R.report_warnings(pages_of(spark, sf))


@query("fields_found", f"with {S.report_chain()} select page_id, fields_found from rpages")
def _(spark, sf):
    return pages_of(spark, sf).select("page_id", R.fields_found().alias("fields_found"))


@query("exists_flags", f"with {S.report_chain()} select page_id, any_hit any_warning, identity_hit identity_warning from rpages")
def _(spark, sf):
    pages = stage(pages_of(spark, sf).select("page_id", "warnings"))
    w = R.report_warnings(pages).groupBy("page_id").agg(F.bool_or(F.col("code").isin("WARN_DUPLICATE_NAMES", "WARN_HEADER_READ_AS_NAME")).alias("identity"))
    return pages.select("page_id").join(R.by_page(w), "page_id", "left").select(
        "page_id", F.col("identity").isNotNull().alias("any_warning"), F.coalesce("identity", F.lit(False)).alias("identity_warning"))


@query("quality_score", f"with {S.report_chain()} select page_id, round(score, 6) overall_confidence from scored")
def _(spark, sf):
    return R.assemble_reports(*sides_of(spark, sf)).select("page_id", F.round("overall_confidence", 6).alias("overall_confidence"))


# rescans of the report's own numbers: the sums come right for some of the pages that did not add up
def _rescan_sql():
    return f"""select page_id, ord, 1 shot, case when ord in (25,125) and page_id%40=0 then cast(cast(replace(txt,',','') as bigint)-7 as string) else replace(txt,',','') end txt,
      (60+ord%40)/100 conf from src where txt not like '%/%' and ord%2=1 and ord between 11 and 199"""


@query("low_confidence_numbers", f"with {S.report_chain()} select t.page_id, t.ord, t.txt from rtyped t join rpages p using (page_id) where not sound and block_type='Number' and conf < 0.85")
def _(spark, sf):
    blocks = prepared(spark, sf)
    state = R.page_state(blocks, YEAR)
    sides = R.build_battle_sides(blocks, state, *dictionaries(spark, sf))
    failing = R.page_rows(state, sides).filter(~F.col("sound")).select("page_id")
    return low_confidence_numbers(blocks, failing).select("page_id", "ord", "txt")


@query("identity_fallback", f"""with {S.report_ctes("select page_id, ord, txt, conf, x0, y0 - case when ord >= 10 and ord < 200 then 250 else 0 end y0, x2, y2 - case when ord >= 10 and ord < 200 then 250 else 0 end y2, isolated from (" + REPORT + ") where not (page_id%20=0 and txt like '[%')")},
  hd as (select t.*, side from rtyped t cross join {S.SIDES} where x0/1000e0 between lo and hi and y0/1000e0 between 0.05e0 and 0.4e0 and block_type in ('Tag','UnitsLabel')),
  un as (select page_id, side, arg_min(ord, ord) src_ord, arg_min(nx, ord) nx, arg_min(ny, ord) ny, 0.2e0 reach from hd where block_type='UnitsLabel'
         and not exists (select 1 from hd h where h.page_id=hd.page_id and h.side=hd.side and h.block_type='Tag') group by 1, 2)
  select p.page_id, p.side, coalesce(t_txt, '--') AS name from (select distinct page_id, side from rtyped cross join {S.SIDES}) p left join {S.neighbour('un', 'up', 'page_id, side')} n using (page_id, side)""")
def _(spark, sf):
    shift = F.when((F.col("ord") >= 10) & (F.col("ord") < 200), 250).otherwise(0)
    blocks = raw(spark, sf).withColumns({"y0": F.col("y0") - shift, "y2": F.col("y2") - shift})
    blocks = blocks.filter(~((F.col("page_id") % 20 == 0) & F.startswith("txt", F.lit("["))))
    return R.identity_fallback(R.prepare(blocks))


def _repaired_sql() -> str:
    """Two extractions with the repair between them: the second chain reads the repaired blocks."""
    again = S.report_chain("select * from fixed")
    return rf"""with src as ({REPORT}),
  bad as (select * from (with {S.report_chain()} select t.page_id, t.ord, t.conf from rtyped t join rpages p using (page_id) where not sound and block_type='Number' and conf < 0.85)),
  best as (select page_id, ord, txt, conf from ({_rescan_sql()}) where conf > 0.60 and regexp_matches(txt, '^\d+$') qualify row_number() over (partition by page_id, ord order by conf desc, shot) = 1),
  fixes as (select page_id, ord, best.txt, best.conf from bad join best using (page_id, ord) where best.conf > bad.conf),
  fixed as (select src.* replace (coalesce(f.txt, src.txt) as txt, coalesce(f.conf, src.conf) as conf) from src left join fixes f using (page_id, ord))
  select * from (with {again} select page_id, sound, round(score, 6) overall_confidence, a_total_units, d_total_units from scored)"""


@query("report_repair", _repaired_sql())
def _(spark, sf):
    blocks = raw(spark, sf)
    src = blocks
    src.createOrReplaceTempView("src")
    reports, _ = R.build_reports(blocks, *dictionaries(spark, sf), YEAR, rescans=spark.sql(_rescan_sql()))
    return reports.select("page_id", "sound", F.round("overall_confidence", 6).alias("overall_confidence"), "a_total_units", "d_total_units")
