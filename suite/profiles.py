"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockwise.functions import names, numbers
from blockwise.functions.geometry import remapped, rescaled, with_geometry
from blockwise.functions.text import first_matching_word, similarity
from blockwise.operators.classify import CIVILIZATION_THRESHOLD, classify_profile_blocks
from blockwise.operators.filters import block_difference, confidence_gate
from blockwise.operators.neighbours import nearest_to_anchor, proximity_veto, right_neighbor_same_line, topk_nearest
from blockwise.operators.picks import first_by
from blockwise.plans import profiles as P
from blockwise.vocabulary import DEFAULT
from suite import fixtures as FX
from suite import sql as S

Q, SQL = {}, {}
PROFILE = FX.sql("profile", "duckdb")


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f
    return add


def prepared(spark, sf):
    return P.prepare(FX.blocks(spark, sf, "profile"))


SOURCE = "case page_id%3 when 0 then 'profile' when 1 then 'inventory' else 'report' end"


@query("confidence_gate", f"""with fx as ({PROFILE}), s as (select page_id, ord, (cast(round(conf*100) as bigint)-50)/100 conf, {SOURCE} source from fx)
  select * from s where case source when 'inventory' then conf >= 0.05 when 'report' then conf > 0.10 else true end""")
def _(spark, sf):
    fx = FX.load(spark, sf, "profile")
    return confidence_gate(fx.select("page_id", "ord", ((F.round(F.col("conf") * 100).cast("bigint") - 50) / 100).alias("conf"), F.expr(SOURCE).alias("source")))


@query("geometry_columns", f"""with fx as (select *, case when page_id%4=0 then 0 else 1000 end canvas from ({PROFILE}))
  select page_id, ord, (x0+x2)/2 cx, (y0+y2)/2 cy, x2-x0 w, y2-y0 h,
    case when canvas > 0 then (x0+x2)/2/canvas else (x0+x2)/2 end nx, case when canvas > 0 then (y0+y2)/2/canvas else (y0+y2)/2 end ny from fx""")
def _(spark, sf):
    canvas = F.when(F.col("page_id") % 4 == 0, 0).otherwise(1000)
    return with_geometry(FX.load(spark, sf, "profile"), canvas, canvas).select("page_id", "ord", "cx", "cy", "w", "h", "nx", "ny")


RATIO = "case page_id%3 when 0 then 1e0 when 1 then 0.5e0 else 0.25e0 end"


@query("rescale_boxes", f"""with fx as (select *, {RATIO} r from ({PROFILE}))
  select page_id, ord, x0/r x0, y0/r y0, x2/r x2, y2/r y2 from fx""")
def _(spark, sf):
    return FX.load(spark, sf, "profile").select("page_id", "ord", *rescaled(F.expr(RATIO), "x0", "y0", "x2", "y2"))


@query("remap_crop_boxes", f"""with fx as (select *, page_id%50 ox, page_id%30 oy, case when page_id%2=0 then 2e0 else 0e0 end sc from ({PROFILE})),
  s as (select *, case when sc > 0 then sc else 1 end k from fx)
  select page_id, ord, ox+x0/k x0, oy+y0/k y0, ox+x2/k x2, oy+y2/k y2 from s""")
def _(spark, sf):
    fx = FX.load(spark, sf, "profile")
    scale = F.when(F.col("page_id") % 2 == 0, 2.0).otherwise(0.0)
    return fx.select("page_id", "ord", *remapped(F.col("page_id") % 50, F.col("page_id") % 30, scale))


@query("fuzzy_similarity", f"""with fx as ({PROFILE})
  select page_id, ord, round({S.sim('txt', "'Kill Points'")}, 9) to_label,
    round({S.sim('txt', "case when ord%2=0 then '' else 'Power' end")}, 9) to_other from fx""")
def _(spark, sf):
    other = F.when(F.col("ord") % 2 == 0, "").otherwise("Power")
    return FX.load(spark, sf, "profile").select(
        "page_id", "ord", F.round(similarity(F.col("txt"), F.lit("Kill Points")), 9).alias("to_label"),
        F.round(similarity(F.col("txt"), other), 9).alias("to_other"))


@query("classify_profile_blocks", f"with {S.profile_ctes()} select page_id, ord, txt, block_type from typed")
def _(spark, sf):
    return classify_profile_blocks(FX.load(spark, sf, "profile")).select("page_id", "ord", "txt", "block_type")


@query("canonicalize_first_match", f"with {S.profile_ctes()} select page_id, ord, {S.first_civ('txt')} civilization from typed where block_type='Civilization'")
def _(spark, sf):
    word = first_matching_word(F.col("txt"), DEFAULT.words("civilizations"), CIVILIZATION_THRESHOLD)
    civs = classify_profile_blocks(FX.load(spark, sf, "profile")).filter(F.col("block_type") == "Civilization")
    return civs.select("page_id", "ord", F.coalesce(word, F.col("txt")).alias("civilization"))


@query("anchor_lookup", f"with {S.profile_ctes()}, {S.anchor_cte()} select page_id, anchor, ord, cx, cy from anc")
def _(spark, sf):
    return P.anchor_lookup(with_geometry(FX.blocks(spark, sf, "profile"))).select("page_id", "anchor", "ord", "cx", "cy")


@query("nearest_to_anchor", f"""with {S.profile_ctes()}, {S.anchor_cte()},
  nums as (select page_id, ord, {S.grouped_long('txt')} v, cx, cy from typed where block_type='Number'),
  best as (select n.page_id, n.ord, v from nums n join anc a on a.page_id=n.page_id and anchor='PowerLabel' where v > 1000
           qualify row_number() over (partition by n.page_id order by {S.dist('n', 'a')}, n.ord)=1)
  select p.page_id, coalesce(v, 0) power, ord src_ord, case when v is null then 0 else 85 end confidence
  from (select distinct page_id from fx) p left join best using (page_id)""")
def power_of(spark, sf):
    """The flagship: power per page, 0 where no label or number was read."""
    blocks = prepared(spark, sf)
    state = P.page_state(blocks)
    anchors = state.filter(F.col("PowerLabel").isNotNull()).select("page_id", F.col("PowerLabel.cx").alias("ax"), F.col("PowerLabel.cy").alias("ay"))
    values = blocks.filter(F.col("block_type") == "Number").withColumn("value", numbers.grouped_long(F.col("txt"))).filter(F.col("value") > 1000)
    found = nearest_to_anchor(anchors, values.select("page_id", "ord", "value", "cx", "cy"))
    return state.select("page_id").join(found, "page_id", "left").select(
        "page_id", F.coalesce("value", F.lit(0)).alias("power"), F.col("ord").alias("src_ord"),
        F.when(F.col("value").isNull(), 0).otherwise(85).alias("confidence"))


def _label_anchor(blocks):
    a = P.anchor_lookup(blocks).filter(F.col("anchor") == "AllianceLabel")
    return a.select("page_id", F.col("cx").alias("ax"), F.col("cy").alias("ay"))


@query("topk_nearest_candidates", f"""with {S.profile_ctes()}, {S.anchor_cte()},
  near as (select u.page_id, u.ord, u.txt, row_number() over (partition by u.page_id order by {S.dist('u', 'a')}, u.ord) rank
    from typed u join anc a on a.page_id=u.page_id and anchor='AllianceLabel' where u.block_type='Unknown')
  select * from near where rank <= 3""")
def _(spark, sf):
    blocks = prepared(spark, sf)
    unknown = blocks.filter(F.col("block_type") == "Unknown").select("page_id", "ord", "txt", "cx", "cy")
    return topk_nearest(_label_anchor(blocks), unknown, 3).select("page_id", "ord", "txt", "rank")


@query("right_neighbor_same_line", f"""with {S.profile_ctes()},
  g as (select * from typed where block_type='Tag' qualify row_number() over (partition by page_id order by ord)=1)
  select g.page_id, u.ord, u.txt from g join typed u on u.page_id=g.page_id and u.block_type='Unknown' and u.cx > g.cx and abs(u.cy-g.cy) < 40
  qualify row_number() over (partition by g.page_id order by abs(u.cx-g.cx), u.ord)=1""")
def _(spark, sf):
    blocks = prepared(spark, sf)
    tags = first_by(blocks.filter(F.col("block_type") == "Tag"), ["page_id"], [F.col("ord")], ["cx", "cy"])
    unknown = blocks.filter(F.col("block_type") == "Unknown")
    return right_neighbor_same_line(tags.select("page_id", F.col("cx").alias("sx"), F.col("cy").alias("sy")), unknown)


@query("proximity_veto", f"""with {S.profile_ctes()}
  select page_id, ord from typed c where block_type in ('Unknown','Tag') and not exists (select 1 from typed b where b.page_id=c.page_id and b.block_type='BarStatus'
    and abs(b.cy-c.cy) < 30 and abs(b.cx-c.cx) < 450)""")
def _(spark, sf):
    blocks = prepared(spark, sf)
    return proximity_veto(blocks.filter(F.col("block_type").isin("Unknown", "Tag")), blocks.filter(F.col("block_type") == "BarStatus")).select("page_id", "ord")


@query("exclude_claimed", f"with {S.profile_chain()} select * from (select page_id, ord, txt from typed t where not exists (select 1 from ids i where i.page_id=t.page_id and i.ord=t.ord)"
       " and not exists (select 1 from pw i where i.page_id=t.page_id and i.ord=t.ord) and not exists (select 1 from kp i where i.page_id=t.page_id and i.ord=t.ord)"
       " and not exists (select 1 from al i where i.page_id=t.page_id and i.ord=t.ord))")
def _(spark, sf):
    blocks = prepared(spark, sf)
    state = P.with_alliance(blocks, P.with_stats(blocks, P.page_state(blocks)))
    claimed = state.select("page_id", F.explode(F.array("id_ord", "power_ord", "kill_points_ord", "alliance_ord")).alias("ord")).filter(F.col("ord").isNotNull())
    return block_difference(blocks, claimed).select("page_id", "ord", "txt")


@query("block_difference", f"with {S.profile_ctes()} select page_id, ord from typed where block_type <> 'Number'")
def _(spark, sf):
    blocks = classify_profile_blocks(FX.load(spark, sf, "profile"))
    return block_difference(blocks, blocks.filter(F.col("block_type") == "Number")).select("page_id", "ord")


_TAG, _NAME = S.split_tag("t")


@query("split_tag_and_name", f"with fx as (select page_id, ord, trim(txt) t from ({PROFILE})) select page_id, ord, {_TAG} tag, {_NAME} AS name from fx")
def _(spark, sf):
    fx = FX.load(spark, sf, "profile")
    return fx.select("page_id", "ord", names.split_tag_and_name(F.col("txt")).alias("p")).select("page_id", "ord", "p.tag", "p.name")


@query("extract_id", f"with {S.profile_ctes()}, {S.id_cte()} select page_id, v id, conf_ confidence, ord src_ord from ids")
def _(spark, sf):
    return P.extract_id(prepared(spark, sf)).select("page_id", F.col("id_value").alias("id"), F.col("id_conf").alias("confidence"), F.col("id_ord").alias("src_ord"))


@query("parse_grouped_long", f"with fx as (select page_id, ord, txt || case page_id%3 when 0 then 'K' when 1 then '.5M' else '' end txt from ({PROFILE})) select page_id, ord, {S.grouped_long('txt')} val from fx")
def _(spark, sf):
    text = F.concat("txt", F.expr("case page_id%3 when 0 then 'K' when 1 then '.5M' else '' end"))
    return FX.load(spark, sf, "profile").select("page_id", "ord", numbers.grouped_long(text).alias("val"))


@query("clean_display_name", f"with fx as ({PROFILE}) select page_id, ord, {S.clean_name('txt')} AS name from fx")
def _(spark, sf):
    return FX.load(spark, sf, "profile").select("page_id", "ord", names.clean_display_name(F.col("txt")).alias("name"))


def _scored(spark, sf):
    blocks = prepared(spark, sf)
    state = P.with_alliance(blocks, P.with_stats(blocks, P.page_state(blocks)))
    return P.score_names(blocks, state, [*P.CLAIMS, "alliance_ord"])


@query("name_scoring", f"with {S.profile_chain()} select page_id, ord, score from sc where score > 0")
def _(spark, sf):
    return _scored(spark, sf).select("page_id", "ord", "score")


@query("retry_argmax", f"with {S.profile_chain()} select page_id, nm AS name, score confidence, ord src_ord from bn")
def _(spark, sf):
    return P.best_name(_scored(spark, sf)).select("page_id", "name", F.col("name_conf").alias("confidence"), F.col("name_ord").alias("src_ord"))


COLS = "page_id, id, name, alliance_tag, alliance_name, power, kill_points, civilization"


@query("build_profiles", f"with {S.profile_chain()} select {COLS} from raw")
def _(spark, sf):
    return P.build_profiles(prepared(spark, sf))


@query("audit_profiles", f"with {S.profile_chain()} select {COLS}, success, complete from prof")
def _(spark, sf):
    return P.audit_profiles(P.build_profiles(prepared(spark, sf)))


HUNT = FX.sql("hunt", "duckdb")


def hunted(round_: int, prof: str, anc: str, ids: str) -> str:
    """acc{n}: what a round adds to the pages of audited profiles ``prof`` with their anchors and ids."""
    place = " ".join(f"when '{f}' then {i + 1}" for i, f in enumerate(P.SEARCHED))
    return f"""req{round_} as (select page_id, 'Civilization' field from {prof} where not complete and civilization = '--' and page_id in (select page_id from {anc} where anchor='CivLabel')
      union all select page_id, 'Power' from {prof} where not complete and power = 0 and page_id in (select page_id from {anc} where anchor='PowerLabel')
      union all select page_id, 'Name' from {prof} where not complete and id > 0 and (name = '--' or length(name) < 3) and page_id in (select page_id from {ids})),
    hit{round_} as (select page_id, field, min(shot) shot from (select page_id, field, shot from ({HUNT}) join req{round_} using (page_id, field) where round = {round_}
      group by 1, 2, 3 having length(trim(string_agg(txt, ' ' order by line))) >= 3) group by 1, 2),
    acc{round_} as (select page_id, {P._ROUND_ORD * round_} + {P._FIELD_ORD} * case field {place} end + line ord, txt, conf,
      origin_x+x0/2e0 x0, origin_y+y0/2e0 y0, origin_x+x2/2e0 x2, origin_y+y2/2e0 y2 from ({HUNT}) join hit{round_} using (page_id, field, shot) where round = {round_})"""


@query("evidence_union_reextract", f"""with {S.profile_chain()}, {hunted(1, 'prof', 'anc', 'ids')},
  src2 as (select * from (select page_id, ord, txt, conf, x0, y0, x2, y2 from ({PROFILE}) union all select * from acc1) where page_id in (select page_id from acc1)),
  {S.profile_chain("select * from src2", suffix="_b")}, {hunted(2, 'prof_b', 'anc_b', 'ids_b')},
  src3 as (select * from (select * from src2 union all select * from acc2) where page_id in (select page_id from acc2)),
  {S.profile_chain("select * from src3", suffix="_c")}
  select {COLS}, success, complete from prof where page_id not in (select page_id from acc1)
  union all select {COLS}, success, complete from prof_b where page_id not in (select page_id from acc2) union all select {COLS}, success, complete from prof_c""")
def _(spark, sf):
    return P.profiles_with_rescans(FX.blocks(spark, sf, "profile"), FX.load(spark, sf, "hunt"))


def _id_extractor(blocks, anchors, done):
    return P.extract_id(blocks).select("page_id", F.col("id_value").alias("value"), F.col("id_conf").alias("confidence"), F.col("id_ord").alias("src_ord"))


def _stat_extractor(label):
    def extract(blocks, anchors, done):
        spots = anchors.filter(F.col("anchor") == label).select("page_id", F.col("cx").alias("ax"), F.col("cy").alias("ay"))
        values = blocks.filter(F.col("block_type") == "Number").withColumn("value", numbers.grouped_long(F.col("txt"))).filter(F.col("value") > 1000)
        return nearest_to_anchor(spots, values).select("page_id", "value", F.lit(85).alias("confidence"), F.col("ord").alias("src_ord"))
    return extract


@query("field_extractor_registry", f"""with {S.profile_ctes()}, {S.anchor_cte()}, {S.id_cte()},
  nums as (select page_id, ord, {S.grouped_long('txt')} v, cx, cy from typed where block_type='Number' and {S.grouped_long('txt')} > 1000),
  pw as (select n.page_id, n.v, n.ord from nums n join anc a on a.page_id=n.page_id and anchor='PowerLabel' left join ids i on i.page_id=n.page_id
         where n.ord is distinct from i.ord qualify row_number() over (partition by n.page_id order by {S.dist('n', 'a')}, n.ord)=1),
  kp as (select n.page_id, n.v, n.ord from nums n join anc a on a.page_id=n.page_id and anchor='KpLabel' left join ids i on i.page_id=n.page_id left join pw p on p.page_id=n.page_id
         where n.ord is distinct from i.ord and n.ord is distinct from p.ord qualify row_number() over (partition by n.page_id order by {S.dist('n', 'a')}, n.ord)=1)
  select p.page_id, i.v id, i.conf_ id_conf, pw.v power, case when pw.v is not null then 85 end power_conf, kp.v kill_points, case when kp.v is not null then 85 end kill_points_conf
  from (select distinct page_id from fx) p left join ids i using (page_id) left join pw on pw.page_id=p.page_id left join kp on kp.page_id=p.page_id""")
def _(spark, sf):
    blocks = prepared(spark, sf)
    steps = (P.FieldExtractors().register("id", _id_extractor).register("power", _stat_extractor("PowerLabel"))
             .register("kill_points", _stat_extractor("KpLabel")))
    return steps.run(blocks, P.anchor_lookup(blocks))
