"""Sources, dictionaries, colours and text rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockwise.functions.text import normalize_accents
from blockwise.operators.classify import color_name, dominant_category
from blockwise.operators.dictionary_match import entity_resolution_topk, fuzzy_dictionary_join
from blockwise.operators.rollups import full_text, session_text
from blockwise.plans import flows
from blockwise.session import FILE_ROWS, new_folder
from blockwise.sources import dictionaries as D
from blockwise.sources import replies as R
from blockwise.streaming import session_merge
from blockwise.vocabulary import COLOR_ORDER, COLOR_RANGES, KEYWORDS, PROFILE_UI_LISTS
from suite import fixtures as FX
from suite import sql as S

Q, SQL = {}, {}
PROFILE, MENTIONS, DICT = (FX.sql(n, "duckdb") for n in ("profile", "mentions", "dictionary"))


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f
    return add


def _replies(spark, sf):
    """A reply text per profile page: every tenth failed, every thirteenth cut off."""
    fx = FX.load(spark, sf, "profile")
    d = [F.col(c).cast("double") for c in ("x0", "y0", "x2", "y2")]
    box = F.array(F.array(d[0], d[1]), F.array(d[2], d[1]), F.array(d[2], d[3]), F.array(d[0], d[3]))
    block = F.struct("ord", F.col("txt").alias("text"), box.alias("box"), "conf")
    pages = fx.groupBy("page_id").agg(F.array_sort(F.collect_list(block)).alias("b"))
    bare = F.transform("b", lambda x: F.struct(x["text"].alias("text"), x["box"].alias("box"), x["conf"].alias("conf")))
    ok = F.col("page_id") % 10 != 0
    text = F.to_json(F.struct(ok.alias("success"), F.when(ok, bare).alias("blocks"), F.when(~ok, F.lit("no image")).alias("detail")))
    cut = F.when(F.col("page_id") % 13 == 0, F.substr(text, F.lit(1), F.lit(30))).otherwise(text)
    return R.parsed_replies(pages.select("page_id", cut.alias("reply")))


@query("load_detections", f"with fx as ({PROFILE}) select page_id, ord, txt, conf, x0, y0, x2 x1, y0 y1, x2, y2, 'Unknown' color from fx where page_id%10 <> 0 and page_id%13 <> 0")
def _(spark, sf):
    return R.load_detections(_replies(spark, sf), ["page_id"]).drop("canvas_w", "canvas_h", "isolated")


@query("error_rows", f"with p as (select distinct page_id from ({PROFILE})) select page_id, case when page_id%13=0 then 'UNREADABLE_REPLY' else 'RECOGNISER_FAILED' end code from p where page_id%10=0 or page_id%13=0")
def _(spark, sf):
    return R.error_rows(_replies(spark, sf), ["page_id"]).select("page_id", "code")


_GOOD = f"select * from ({PROFILE}) where page_id%10 <> 0 and page_id%13 <> 0"


@query("profile_flow", f"""with {S.profile_chain(_GOOD)}, pages as (select distinct page_id from ({PROFILE})),
  j as (select page_id, prof.id, prof.name, prof.alliance_tag, prof.alliance_name, prof.power, prof.kill_points, prof.civilization, coalesce(success, false) success,
      case when success then 'Profile read' when prof.page_id is null then 'No detections' else 'No profile found' end message,
      case when page_id%13=0 then 'UNREADABLE_REPLY' when page_id%10=0 then 'RECOGNISER_FAILED' when not complete then 'INCOMPLETE_PROFILE' end warning
    from pages left join prof using (page_id))
  select page_id, success, message, id, name, alliance_tag, alliance_name, power, kill_points, civilization, warning from j""")
def _(spark, sf):
    # the replies, for images scaled down by half, as JSON files; then what their envelopes say
    fx = FX.load(spark, sf, "profile")
    d = [(F.col(c) * 0.5).cast("double") for c in ("x0", "y0", "x2", "y2")]
    box = F.array(F.array(d[0], d[1]), F.array(d[2], d[1]), F.array(d[2], d[3]), F.array(d[0], d[3]))
    pages = fx.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("txt").alias("text"), box.alias("box"), "conf"))).alias("b"))
    bare = F.transform("b", lambda x: F.struct(x["text"].alias("text"), x["box"].alias("box"), x["conf"].alias("conf")))
    ok = F.col("page_id") % 10 != 0
    text = F.to_json(F.struct(F.col("page_id").cast("string").alias("page_id"), ok.alias("success"), F.when(ok, bare).alias("blocks")))
    cut = F.when(F.col("page_id") % 13 == 0, F.concat(F.substring_index(text, ",", 1), F.lit(', "succ'))).otherwise(text)
    folder = new_folder(spark, "replies")
    pages.select(cut.alias("value")).write.text(folder)
    envelopes, _ = flows.profile_flow(R.read_replies(spark, folder), 0.5)
    schema = "success boolean, message string, data struct<id:bigint,name:string,alliance_tag:string,alliance_name:string,power:bigint,kill_points:bigint,civilization:string>, warnings array<string>"
    e = envelopes.select(F.col("page_id").cast("bigint").alias("page_id"), F.from_json("envelope", schema).alias("e"))
    return e.select("page_id", "e.success", "e.message", "e.data.*", F.get("e.warnings", F.lit(0)).alias("warning"))


def _sent(spark, view, keys, failed, cut, container=None, color=False):
    """The pages of a view as reply files: JSON lines, some of which failed or are cut off."""
    d = [F.col(c).cast("double") for c in ("x0", "y0", "x2", "y2")]
    box = F.array(F.array(d[0], d[1]), F.array(d[2], d[1]), F.array(d[2], d[3]), F.array(d[0], d[3]))
    fields = ["ord", F.col("txt").alias("text"), box.alias("box"), "conf", *(["color"] if color else [])]
    per_page = [F.array_sort(F.collect_list(F.struct(*fields))).alias("b"), *([container.alias("container")] if container is not None else [])]
    pages = view.groupBy(*keys).agg(*per_page)
    bare = F.transform("b", lambda x: F.struct(*[x[c].alias(c) for c in ("text", "box", "conf", *(["color"] if color else []))]))
    text = F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys], (~failed).alias("success"), F.when(~failed, bare).alias("blocks"),
                              F.when(failed, F.lit("no image")).alias("detail"), *(["container"] if container is not None else [])))
    folder = new_folder(spark, "replies")
    pages.select(F.when(cut, F.concat(F.substring_index(text, ',"success"', 1), F.lit(', "succ'))).otherwise(text).alias("value")).write.text(folder)
    return R.read_replies(spark, folder, keys)


def _envelopes(df, key, schema):
    return df.select(F.col(key).cast("bigint").alias(key), F.from_json("envelope", schema).alias("e"))


_REPORT = FX.sql("report", "duckdb")
_SENT = f"select * from ({_REPORT}) where page_id%90 <> 0 and page_id%130 <> 0"


@query("report_flow", f"""with {S.report_chain(_SENT)}, sent as (select page_id, string_agg(txt, ' | ' order by ord) raw_text from ({_REPORT}) group by 1),
  w as (select page_id, string_agg(code, ',' order by code) codes from (select page_id, code from warn union all select page_id, 'UNREADABLE_REPLY' from sent where page_id%130 = 0
    union all select page_id, 'RECOGNISER_FAILED' from sent where page_id%90 = 0 and page_id%130 <> 0) group by 1)
  select s.page_id, p.page_id is not null success, case when p.page_id is null then 'No detections' else 'Report processed' end message,
    case when p.page_id is null then md5('') else md5(raw_text) end text_md5, case when npc then 'Barbarian' when p.page_id is not null then 'SingleBattle_PVP' end page_type, sound,
    round(score, 6) overall_confidence, a_governor_name attacker, d_governor_name defender, a_total_units, d_dead, coalesce(codes, '') codes
  from sent s left join scored p using (page_id) left join w using (page_id)""")
def _(spark, sf):
    from suite import reports as SR
    container = F.struct(F.struct(F.lit(1000).alias("width"), F.lit(1000).alias("height")).alias("canvas_size"), F.bool_and("isolated").alias("is_isolated"))
    replies = _sent(spark, FX.load(spark, sf, "report"), ["page_id"], F.col("page_id") % 90 == 0, F.col("page_id") % 130 == 0, container)
    envelopes, _ = flows.report_flow(replies, *SR.dictionaries(spark, sf), SR.YEAR)
    side = "struct<governor_name:string,total_units:bigint,dead:bigint>"
    e = _envelopes(envelopes, "page_id", f"success boolean, message string, raw_text string, warnings array<string>, "
                   f"data struct<page_type:string,sound:boolean,overall_confidence:double,attacker:{side},defender:{side}>")
    return e.select("page_id", "e.success", "e.message", F.md5("e.raw_text").alias("text_md5"), "e.data.page_type", "e.data.sound",
                    F.round("e.data.overall_confidence", 6).alias("overall_confidence"), F.col("e.data.attacker.governor_name").alias("attacker"),
                    F.col("e.data.defender.governor_name").alias("defender"), F.col("e.data.attacker.total_units").alias("a_total_units"),
                    F.col("e.data.defender.dead").alias("d_dead"), F.array_join("e.warnings", ",").alias("codes"))


_ITEM = "struct<unit_value:int,item_id:string,quantity:bigint,confidence:double,total_value:bigint>"


def _session_columns(envelopes, more=""):
    e = _envelopes(envelopes, "session_id", f"success boolean, message string, raw_text string, warnings array<string>, data struct<grand_total:bigint{more},items:array<{_ITEM}>>")
    listed = F.array_join(F.transform("e.data.items", lambda x: F.concat_ws(":", x.item_id, x.quantity.cast("string"), x.total_value.cast("string"))), ",")
    return e.select("session_id", "e.success", "e.message", F.md5("e.raw_text").alias("text_md5"), "e.data.grand_total",
                    *[F.col(f"e.data.{c.split(':')[0]}") for c in more.split(",")[1:]], listed.alias("items"), F.md5(F.array_join("e.warnings", "\n")).alias("warnings_md5"))


# what every session query ends in: sent (session_id, page_seq, page_id), txt, msg (session_id, page_seq, source, message), tot
def _session_sql(view, good, more=""):
    return f"""sent as (select distinct session_id, page_seq, page_id from ({view})),
  txt as (select session_id, string_agg('[IMG ' || page_seq || '] ' || t, ' | ' order by page_seq) raw_text from (select session_id, page_seq, string_agg(txt, ' | ' order by ord) t from ({good}) group by 1, 2) group by 1)""", f"""
  select s.session_id, true success, case when n > 0 then n || ' item types identified' else 'No items identified' end message, md5(coalesce(raw_text, '')) text_md5, grand_total{more},
    coalesce(items, '') items, md5(coalesce(warned, '')) warnings_md5
  from (select distinct session_id from sent) s left join tot using (session_id) left join txt using (session_id){' left join fb using (session_id)' if more else ''}
    left join (select session_id, string_agg(message, chr(10) order by page_seq, source, message) warned from msg group by 1) m using (session_id)"""


def _list_sql():
    from suite import inventories as I
    titled = FX.sql("titled", "duckdb")
    good = f"select * from ({titled}) where page_id%17 <> 0 and page_id%23 <> 0"
    start, end = _session_sql(titled, good, ", bar_current, bar_max")
    number = "regexp_replace({}::varchar, '\\.0$', '')"
    return f"""with recursive {I.AP.replace(f"({titled})", f"({good})")}, {I.fold_ctes(I._READS)}, win as (select * from f qualify row_number() over (partition by session_id, item_id order by n desc) = 1),
  it as (select session_id, item_id, k.unit_value, qty, qty*k.unit_value total from win join {I._TITLES} using (item_id)),
  tot as (select session_id, count(*) n, sum(total)::bigint grand_total, string_agg(item_id || ':' || qty || ':' || total, ',' order by unit_value, item_id) items from it group by 1),
  fb as (select * from bar qualify row_number() over (partition by session_id order by page_seq) = 1), {start},
  msg as (select session_id, page_seq, 'reply' source, case when page_id%23=0 then 'UNREADABLE_REPLY' else 'RECOGNISER_FAILED: no image' end message from sent where page_id%17=0 or page_id%23=0
    union all select b.session_id, b.page_seq, 'bar', '[AP Bar] Divergence detected in image ' || b.page_seq || '. Previous: ' || w.bar_current || '/' || w.bar_max || ', New: ' || b.bar_current || '/' || b.bar_max || '. Kept previous value.'
      from bar b join fb w using (session_id) where b.bar_max <> w.bar_max or b.bar_current <> w.bar_current
    union all select session_id, nseq, 'item', '[Item Conflict] ''' || title || ''' diverged between images. Values: ' || pq || ' vs ' || nq || '. System chose: ' || qty || ' (Conf: ' || {number.format('nc')} || '% vs ' || {number.format('pc')} || '%).'
      from f join {I._TITLES} using (item_id) where pq <> nq) {end}"""


def _grid_sql():
    from suite import inventories as I
    grid = FX.sql("grid", "duckdb")
    good = f"select * from ({grid}) where page_id%170 <> 0 and page_id%230 <> 0"
    start, end = _session_sql(grid, good)
    return f"""with recursive {I.XP.replace(f"({grid})", f"({good})")}, {I.GHOST}, o as (select g.*, session_id, page_seq from gh g join {I._PAGES} using (page_id)), rd as (select * from o where not ghost and quantity <> -1),
  win as (select * from rd qualify row_number() over (partition by session_id, item_id order by quantity desc, confidence desc, page_seq, dist, anchor_ord) = 1),
  tot as (select session_id, count(*) n, sum(cast(quantity as bigint)*unit_value)::bigint grand_total,
    string_agg(item_id || ':' || quantity || ':' || cast(quantity as bigint)*unit_value, ',' order by unit_value, item_id) items from win group by 1),
  cf as (select *, max(quantity) over (partition by session_id, item_id order by page_seq, dist, anchor_ord rows between unbounded preceding and 1 preceding) pq from rd), {start},
  msg as (select session_id, page_seq, 'reply' source, case when page_id%230=0 then 'UNREADABLE_REPLY' else 'RECOGNISER_FAILED: no image' end message from sent where page_id%170=0 or page_id%230=0
    union all select session_id, page_seq, 'read', case when ghost then '[Sanity Check] Discarded ' || item_id || ' with value ' || quantity || ' because it duplicates a higher confidence neighbor (Ghost Read).'
      else '[Ignored] Could not read quantity for ' || item_id || ' (Color: ' || color || ').' end from o where ghost or quantity = -1
    union all select session_id, page_seq, 'item', '[Conflict] ' || item_id || ': ' || pq || ' vs ' || quantity || '. Using ' || greatest(pq, quantity) || '.' from cf where pq <> quantity) {end}"""


@query("list_flow", _list_sql())
def _(spark, sf):
    replies = _sent(spark, FX.load(spark, sf, "titled"), ["session_id", "page_id", "page_seq"], F.col("page_id") % 17 == 0, F.col("page_id") % 23 == 0)
    return _session_columns(flows.list_flow(replies)[0], ",bar_current:bigint,bar_max:bigint")


@query("grid_flow", _grid_sql())
def _(spark, sf):
    replies = _sent(spark, FX.load(spark, sf, "grid"), ["session_id", "page_id", "page_seq"], F.col("page_id") % 170 == 0, F.col("page_id") % 230 == 0, color=True)
    rescans = FX.load(spark, sf, "rescan").withColumn("page_id", F.col("page_id").cast("string"))
    return _session_columns(flows.grid_flow(replies, rescans=rescans)[0])


@query("load_dictionary", "with e as (select p_brand, min(p_partkey) entry_ord from part group by 1), l as (select p_brand, p_name, row_number() over (partition by p_brand order by p_name) - 1 label_ord from (select distinct p_brand, p_name from part)) "
       "select p_brand entry_id, entry_ord, p_brand canonical, cast(label_ord as int) label_ord, p_name label from e join l using (p_brand)")
def _(spark, sf):
    part = FX.load(spark, sf, "part")
    # one entry text per brand: its labels are the brand's part names
    entries = part.groupBy("p_brand").agg(F.min("p_partkey").alias("entry_ord"), F.array_sort(F.collect_set("p_name")).alias("labels"))
    text = F.to_json(F.struct(F.col("p_brand").alias("id"), F.col("p_brand").alias("canonicalName"), "labels"))
    from blockwise import schemas
    parsed = entries.select("entry_ord", F.from_json(text, schemas.DICTIONARY_ENTRY).alias("e")).select("entry_ord", "e.*")
    return D.load_dictionary(parsed).select("entry_id", "entry_ord", "canonical", "label_ord", "label")


_KW = "(values " + ", ".join(f"('{n}', {S.lit(w)}, {i})" for n, ws in KEYWORDS.items() for i, w in enumerate(ws)) + ") k(list, kw, kw_ord)"


@query("keyword_dimension", f"with fx as ({PROFILE}), n as (select lower(txt) t, count(*) c from fx group by 1) select list, kw, kw_ord, coalesce(c, 0) n_blocks from {_KW} left join n on t = lower(kw)")
def _(spark, sf):
    counts = FX.load(spark, sf, "profile").groupBy(F.lower("txt").alias("t")).agg(F.count("*").alias("c"))
    kw = D.keyword_dimension(spark)
    return kw.join(counts, F.lower("kw") == F.col("t"), "left").select("list", "kw", "kw_ord", F.coalesce("c", F.lit(0)).alias("n_blocks"))


_BASES = {n: sum(len(KEYWORDS[m]) for m in PROFILE_UI_LISTS[:i]) for i, n in enumerate(PROFILE_UI_LISTS)}


@query("keyword_union", f"with fx as ({PROFILE}), u as (select kw, kw_ord + case list " + " ".join(f"when '{n}' then {b}" for n, b in _BASES.items()) + f" end kw_ord from {_KW} where list in ({', '.join(repr(n) for n in PROFILE_UI_LISTS)})) "
       "select page_id, ord, min(kw_ord) first_kw from fx join u on lower(txt) = lower(kw) group by 1, 2")
def _(spark, sf):
    union = D.keyword_union(D.keyword_dimension(spark), list(PROFILE_UI_LISTS), {n: len(KEYWORDS[n]) for n in PROFILE_UI_LISTS})
    fx = FX.load(spark, sf, "profile")
    return fx.join(union, F.lower("txt") == F.lower("kw")).groupBy("page_id", "ord").agg(F.min("kw_ord").alias("first_kw"))


def _pairs(threshold, contains):
    more = " or contains(lower(mention), lower(label))" if contains else ""
    return f"select mention_id, mention, label from m cross join d where {S.sim('mention', 'label')} > {threshold}e0{more}"


@query("fuzzy_dictionary_join", f"with m as ({MENTIONS}), d as ({DICT}) select 'similar' kind, * from ({_pairs(0.82, False)}) union all select 'either', * from ({_pairs(0.75, True)})")
def _(spark, sf):
    m, d = FX.load(spark, sf, "mentions"), FX.load(spark, sf, "dictionary")
    cols = ["mention_id", "mention", "label"]
    strict = fuzzy_dictionary_join(m, d, 0.82).select(F.lit("similar").alias("kind"), *cols)
    loose = fuzzy_dictionary_join(m, d, 0.75, contains=True).select(F.lit("either").alias("kind"), *cols)
    return strict.unionByName(loose)


@query("entity_resolution_topk", f"with m as (select mention_id, mention raw_name from ({MENTIONS})), d as ({S.ENTITIES.format(dict=DICT)}) select m.mention_id, b.entry_id, b.label, round(b.score, 6) score from m join {S.entity_best('m', 'd')} b using (raw_name)")
def _(spark, sf):
    FX.load(spark, sf, "part").createOrReplaceTempView("part")
    d = spark.sql(S.ENTITIES.format(dict=FX.DICTIONARY))
    return entity_resolution_topk(FX.load(spark, sf, "mentions"), d).select("mention_id", "entry_id", "label", F.round("score", 6).alias("score"))


@query("normalize_accents", f"with m as (select mention_id, 'É' || mention || 'çÕ' t from ({MENTIONS})) select mention_id, lower(strip_accents(t)) plain from m")
def _(spark, sf):
    m = FX.load(spark, sf, "mentions")
    return m.select("mention_id", normalize_accents(F.concat(F.lit("É"), "mention", F.lit("çÕ"))).alias("plain"))


_COLOR = "case " + " ".join(f"when h between {a[0]} and {b[0]} and s between {a[1]} and {b[1]} and v between {a[2]} and {b[2]} then '{n}'" for n, a, b in COLOR_RANGES) + " end"


@query("classify_colors", f"select page_id, color, cast(sum(cnt) as bigint) cnt from (select page_id, cnt, coalesce({_COLOR}, 'None') color from ({FX.sql('pixels', 'duckdb')})) group by 1, 2")
def _(spark, sf):
    px = FX.load(spark, sf, "pixels").select("page_id", "cnt", F.coalesce(color_name(F.col("h"), F.col("s"), F.col("v")), F.lit("None")).alias("color"))
    return px.groupBy("page_id", "color").agg(F.sum("cnt").alias("cnt"))


@query("dominant_category", f"""with fx as ({FX.sql('votes', 'duckdb')}), t as (select page_id, cast(sum(cnt) as bigint) total from fx group by 1),
  b as (select page_id, color, cnt from fx where color <> 'None' qualify row_number() over (partition by page_id order by cnt desc, list_position({COLOR_ORDER}, color)) = 1)
  select page_id, case when cnt is null or cnt = 0 or cnt < total*0.05e0 then 'Unknown' else color end dominant, coalesce(cnt, 0) dominant_cnt, total from t left join b using (page_id)""")
def _(spark, sf):
    return dominant_category(FX.load(spark, sf, "votes"))


TEXT = FX.sql("text", "duckdb")


@query("full_text_rollup", f"with fx as ({TEXT}) select page_id, string_agg(txt, chr(10) order by ord) full_text from fx group by 1")
def _(spark, sf):
    return full_text(FX.load(spark, sf, "text"), ["page_id"], "\n")


@query("session_text_rollup", f"""with fx as ({FX.sql('titled', 'duckdb')}), p as (select session_id, page_seq, string_agg(txt, ' | ' order by ord) t from fx group by 1, 2)
  select session_id, string_agg('[IMG ' || page_seq || '] ' || t, ' | ' order by page_seq) raw_text from p group by 1""")
def _(spark, sf):
    return session_text(full_text(FX.load(spark, sf, "titled"), ["session_id", "page_seq"], " | "))


#: Files of a slice at most.
SLICE_FILES = 4


def _delivered(spark, sf):
    """The stream's output.  Reads are delivered in slices of three days; every seventh comes a slice late, every tenth once more a
    slice later, and after the last slice a heartbeat ends all sessions."""
    folder, day = new_folder(spark, "stream"), 86_400
    reads = FX.load(spark, sf, "reads").withColumn("slice", F.floor(F.unix_seconds("arrived") / (3 * day)))
    late, again = F.col("seq") % 7 == 0, F.col("seq") % 10 == 0
    times = F.concat(F.array(F.col("slice") + late.cast("int")), F.when(again, F.array(F.col("slice") + 1)).otherwise(F.array()))
    sent = reads.withColumn("slice", F.explode(times))
    sizes = sent.groupBy("slice").agg(F.count("*").alias("n"), F.max("arrived").alias("end")).collect()
    end = max(s.end for s in sizes if s.end is not None)
    for slice_, n in sorted((s.slice, s.n) for s in sizes if s.slice is not None):
        # the files do not multiply with the rows: each micro-batch reads and writes the states of all open items
        few = min(SLICE_FILES, -(-n // FILE_ROWS))
        sent.where(F.col("slice") == slice_).drop("slice").repartition(few).write.mode("append").parquet(f"{folder}/in")
    beat = spark.range(1).select(*[F.lit(None).cast(reads.schema[c].dataType).alias(c) for c in ("session_id", "item_id", "seq", "qty", "conf", "unit_value")],
                                 (F.lit(end) + F.expr("interval 60 days")).alias("arrived"))
    beat.write.mode("append").parquet(f"{folder}/in")
    session_merge.run(session_merge.read_stream(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint", "7 days").awaitTermination()
    return f"{folder}/out"


@query("stream_session_merge", f"with fx as ({FX.sql('reads', 'duckdb')}) select session_id, item_id, qty, conf, seq, unit_value from fx qualify row_number() over (partition by session_id, item_id order by qty desc, conf desc, seq) = 1")
def _(spark, sf):
    return session_merge.current(spark, _delivered(spark, sf))


@query("stream_conflict_log", f"""with fx as ({FX.sql('reads', 'duckdb')}), w as (select *, max(qty) over (partition by session_id, item_id order by arrived, seq rows between unbounded preceding and 1 preceding) previous_qty from fx)
  select session_id, item_id, seq, previous_qty, qty new_qty, greatest(previous_qty, qty) chosen_qty from w where previous_qty <> qty""")
def _(spark, sf):
    return session_merge.conflict_log(spark, _delivered(spark, sf))
