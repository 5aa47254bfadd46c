"""Item list and icon grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockwise.functions import numbers
from blockwise.functions.geometry import with_geometry
from blockwise.operators import grid as G
from blockwise.operators import merges as M
from blockwise.operators import rescans as RS
from blockwise.operators.ordered import ConflictFold, sequence_number
from blockwise.operators.picks import first_by
from blockwise.operators.rollups import grand_total, item_totals
from blockwise.plans import grids, item_lists
from blockwise.plans.profiles import SEARCHED_BY
from blockwise.sources.records import inventory_envelopes
from suite import fixtures as FX
from suite import sql as S
from suite.profiles import prepared as prepared_profile
from suite.profiles import P

Q, SQL = {}, {}
READS, GRID, RESCAN, TITLED = (FX.sql(n, "duckdb") for n in ("reads", "grid", "rescan", "titled"))


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f
    return add


# --- reads of one item in one session --------------------------------------------------------------

@query("page_sequence", "select user_id session_id, event_id page_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) page_seq from events")
def _(spark, sf):
    events = FX.load(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("page_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"))
    # buckets of one day of arrivals
    return sequence_number(events, ["session_id"], "arrival", "page_seq", 86_400_000_000, ["page_id"]).select("session_id", "page_id", "page_seq")


KEYS = ["session_id", "item_id"]


def _max_wins(spark, sf):
    reads = FX.load(spark, sf, "reads")
    return M.max_wins_merge(reads, KEYS, "qty", "conf", "seq", ["unit_value"])


@query("max_wins_merge", f"with fx as ({READS}) select session_id, item_id, qty, conf, seq, unit_value from fx qualify row_number() over (partition by session_id, item_id order by qty desc, conf desc, seq) = 1")
def _(spark, sf):
    return _max_wins(spark, sf)


@query("conflict_log", f"""with fx as ({READS}), w as (select *, max(qty) over (partition by session_id, item_id order by seq rows between unbounded preceding and 1 preceding) previous_qty from fx)
  select session_id, item_id, seq, previous_qty, qty new_qty, greatest(previous_qty, qty) chosen_qty from w where previous_qty <> qty""")
def _(spark, sf):
    return M.max_wins_conflicts(FX.load(spark, sf, "reads"), KEYS, "qty", "seq")


def fold_ctes(reads: str) -> str:
    """f: state after every read n; reads is a query (session_id, item_id, seq, qty, conf)."""
    wins = "case when r.qty <> f.qty then case when abs(r.conf-f.conf) <= 5 then r.qty > f.qty else r.conf > f.conf+5 end else r.conf > f.conf end"
    return f"""r as (select *, row_number() over (partition by session_id, item_id order by seq) n from ({reads})),
    f as (select session_id, item_id, n, seq, qty, conf, null::bigint pq, null::double pc, null::bigint nq, null::double nc, null::bigint nseq from r where n = 1
      union all select r.session_id, r.item_id, r.n, case when {wins} then r.seq else f.seq end, case when {wins} then r.qty else f.qty end,
        case when {wins} then r.conf else f.conf end, f.qty, f.conf, r.qty, r.conf, r.seq from f join r on r.session_id=f.session_id and r.item_id=f.item_id and r.n=f.n+1)"""


@query("ordered_conflict_fold", f"with recursive {fold_ctes('select session_id, item_id, seq, qty, conf from (' + READS + ')')} select session_id, item_id, seq, qty, conf from f qualify row_number() over (partition by session_id, item_id order by n desc) = 1")
def _(spark, sf):
    return ConflictFold(FX.load(spark, sf, "reads"), KEYS, "seq", "qty", "conf").winners()


@query("conflict_log_fold", f"with recursive {fold_ctes('select session_id, item_id, seq, qty, conf from (' + READS + ')')} select session_id, item_id, nseq seq, pq previous_qty, nq new_qty, pc previous_conf, nc new_conf, qty chosen_qty from f where pq <> nq")
def _(spark, sf):
    return ConflictFold(FX.load(spark, sf, "reads"), KEYS, "seq", "qty", "conf").conflicts()


_MERGED = f"mw as (select session_id, item_id, qty, conf, unit_value from ({READS}) qualify row_number() over (partition by session_id, item_id order by qty desc, conf desc, seq) = 1)"


@query("item_totals", f"with {_MERGED} select session_id, cast(sum(qty*unit_value) as bigint) grand_total, count(*) n_items from mw group by 1")
def _(spark, sf):
    return grand_total(item_totals(_max_wins(spark, sf), "qty"))


@query("result_ordering", f"with {_MERGED} select session_id, item_id, unit_value, qty from mw order by unit_value, session_id, item_id")
def _(spark, sf):
    return _max_wins(spark, sf).select("session_id", "item_id", "unit_value", "qty").orderBy("unit_value", "session_id", "item_id")


@query("write_records", f"""with {_MERGED}, s as (select session_id, count(*) n, sum(qty*unit_value) g,
    string_agg('{{"unit_value":' || unit_value || ',"item_id":"' || item_id || '","quantity":' || qty || ',"confidence":' || conf || ',"total_value":' || qty*unit_value || '}}', ',' order by unit_value, item_id) i from mw group by 1)
  select session_id, 'Analysis complete. ' || n || ' item types identified.' message,
    '{{"success":true,"message":"Analysis complete. ' || n || ' item types identified.","data":{{"grand_total":' || cast(g as bigint) || ',"items":[' || i || ']}}}}' envelope from s""")
def _(spark, sf):
    items = item_totals(_max_wins(spark, sf), "qty").select("session_id", F.col("unit_value").cast("int").alias("unit_value"), "item_id",
                                                          F.col("qty").alias("quantity"), F.col("conf").alias("confidence"), "total_value")
    return inventory_envelopes(items, grand_total(items), "Analysis complete. %d item types identified.", "Analysis complete, but no standard items were identified.")


# --- icon grids ------------------------------------------------------------------------------------

_ITEMS = "[" + ", ".join(f"{{'v': {v}, 'id': '{i}', 'c': {c}}}" for v, i, c in G.DEFAULT.grid_items) + "]"
GRID_CTES = f"""gfx as ({GRID}), gg as (select *, {S.GEO}, {S.digits_int('txt')} val from gfx),
  anch as (select g.*, k.id item_id, val unit_value from gg g join (select unnest({_ITEMS}, recursive := true)) k on k.v = g.val and list_contains(k.c, g.color)),
  scl as (select page_id, list_sort(list(y2-y0))[count(*)//2+1]::double m from anch group by 1),
  qtys as (select g.page_id, g.ord, g.cx, g.cy, g.conf, val qty from gg g where val > 0 and length(txt) < 9 and not exists (select 1 from anch a where a.page_id=g.page_id and a.ord=g.ord)),
  cand as (select a.page_id, a.ord anchor_ord, q.ord qty_ord, q.qty, a.cx ax, a.cy ay, q.cy qy, {S.dist('a', 'q')} dist from anch a join scl using (page_id) join qtys q on q.page_id=a.page_id
    where q.cy > a.cy and abs(q.cx-a.cx) <= m*2 and {S.dist('a', 'q')} < m*5.5e0),
  vis as (select c.* from cand c join scl using (page_id) where not exists (select 1 from anch o where o.page_id=c.page_id and o.ord <> c.anchor_ord and o.cy > c.ay and o.cy < c.qy and abs(o.cx-c.ax) < m*2))"""
GREEDY = """pr as (select page_id, dist, anchor_ord a, qty_ord q, row_number() over (partition by page_id order by dist, anchor_ord, qty_ord) n from vis),
  gr as (select distinct page_id, cast(0 as bigint) n, []::int[] ua, []::int[] uq, null::int a, null::int q, null::double dist from pr
    union all select g.page_id, p.n, case when not list_contains(ua, p.a) and not list_contains(uq, p.q) then list_append(ua, p.a) else ua end,
      case when not list_contains(ua, p.a) and not list_contains(uq, p.q) then list_append(uq, p.q) else uq end,
      case when not list_contains(ua, p.a) and not list_contains(uq, p.q) then p.a end, p.q, p.dist from gr g join pr p on p.page_id=g.page_id and p.n=g.n+1),
  mat as (select page_id, dist, a anchor_ord, q qty_ord from gr where a is not null)"""
ITEMS = """itm as (select m.page_id, m.anchor_ord, a.item_id, a.unit_value, q.qty quantity, round_even((a.conf+q.conf)/2*100, 2) confidence, a.color, m.dist
    from mat m join anch a on a.page_id=m.page_id and a.ord=m.anchor_ord join qtys q on q.page_id=m.page_id and q.ord=m.qty_ord
  union all select page_id, ord, item_id, unit_value, -1, 0, color || '_PENDING', 'infinity'::double from anch a where not exists (select 1 from mat m where m.page_id=a.page_id and m.anchor_ord=a.ord))"""
FILLED = f"""use as (select page_id, ord, {S.digits_int('txt')} q, round_even(conf*100, 2) c, conf from ({RESCAN})),
  bst as (select page_id, ord, q, c from use where q > 0 and conf > case when q < 10 then 0.15e0 else 0.40e0 end qualify row_number() over (partition by page_id, ord order by q desc, c desc) = 1),
  fil as (select i.page_id, anchor_ord, item_id, unit_value, case when quantity = -1 and q is not null then q else quantity end quantity,
    case when quantity = -1 and q is not null then c else confidence end confidence, case when quantity = -1 and q is not null then replace(color, '_PENDING', '') else color end color, dist
    from itm i left join bst b on b.page_id=i.page_id and b.ord=i.anchor_ord)"""
XP = f"{GRID_CTES}, {GREEDY}, {ITEMS}, {FILLED}"


def page(spark, sf):
    return grids.GridPage(FX.blocks(spark, sf, "grid"))


@query("value_color_lookup", f"with {GRID_CTES} select page_id, ord, item_id, unit_value, color from anch")
def _(spark, sf):
    return G.value_color_lookup(FX.load(spark, sf, "grid")).select("page_id", "ord", "item_id", "unit_value", "color")


@query("digits_only_int", f"with {GRID_CTES} select page_id, ord, val from gg")
def _(spark, sf):
    return FX.load(spark, sf, "grid").select("page_id", "ord", numbers.digits_only_int(F.col("txt")).alias("val"))


@query("upper_median", f"with {GRID_CTES} select page_id, m from scl")
def _(spark, sf):
    return G.upper_median_height(G.value_color_lookup(FX.load(spark, sf, "grid")))


@query("grid_candidates", f"with {GRID_CTES} select page_id, anchor_ord, qty_ord, qty, round(dist, 9) dist from cand")
def _(spark, sf):
    return page(spark, sf).candidates().select("page_id", "anchor_ord", "qty_ord", "qty", F.round("dist", 9).alias("dist"))


@query("line_of_sight_anti_join", f"with {GRID_CTES} select page_id, anchor_ord, qty_ord from vis")
def _(spark, sf):
    return page(spark, sf).visible().select("page_id", "anchor_ord", "qty_ord")


@query("greedy_matching", f"with recursive {GRID_CTES}, {GREEDY} select page_id, anchor_ord, qty_ord, round(dist, 9) dist from mat")
def _(spark, sf):
    return page(spark, sf).matches().select("page_id", "anchor_ord", "qty_ord", F.round("dist", 9).alias("dist"))


@query("orphan_anchors", f"with recursive {GRID_CTES}, {GREEDY}, {ITEMS} select page_id, anchor_ord, item_id, quantity, confidence, color from itm where quantity = -1")
def _(spark, sf):
    p = page(spark, sf)
    return G.orphan_anchors(p.anchors, p.matches()).select("page_id", "anchor_ord", "item_id", "quantity", "confidence", "color")


@query("rescan_quantity_merge", f"with recursive {XP} select page_id, anchor_ord, item_id, quantity, confidence, color from fil")
def _(spark, sf):
    return grids.page_items(FX.blocks(spark, sf, "grid"), FX.load(spark, sf, "rescan")).select("page_id", "anchor_ord", "item_id", "quantity", "confidence", "color")


@query("duplicate_value_count", f"with recursive {XP} select page_id, quantity, count(*) n_items from fil where quantity > 10 group by 1, 2 having count(*) > 1")
def _(spark, sf):
    return M.duplicate_value_count(grids.page_items(FX.blocks(spark, sf, "grid"), FX.load(spark, sf, "rescan")))


GHOST = "gh as (select *, coalesce(quantity > 150 and max(confidence) over (partition by page_id, quantity) > confidence, false) ghost from fil)"


@query("ghost_read_suppression", f"with recursive {XP}, {GHOST} select page_id, anchor_ord, item_id, quantity, '[Sanity Check] Discarded ' || item_id || ' with value ' || quantity || ' because it duplicates a higher confidence neighbor (Ghost Read).' message from gh where ghost")
def _(spark, sf):
    items = grids.page_items(FX.blocks(spark, sf, "grid"), FX.load(spark, sf, "rescan"))
    return M.ghost_reads(items)[1].select("page_id", "anchor_ord", "item_id", "quantity", "message")


@query("pending_log", f"with recursive {XP} select page_id, anchor_ord, '[Ignored] Could not read quantity for ' || item_id || ' (Color: ' || color || ').' message from fil where quantity = -1")
def _(spark, sf):
    items = grids.page_items(FX.blocks(spark, sf, "grid"), FX.load(spark, sf, "rescan"))
    return M.pending_log(items).select("page_id", "anchor_ord", "message")


_PAGES = "(select distinct page_id, session_id, page_seq from gfx)"


@query("build_xp_items", f"""with recursive {XP}, {GHOST} select session_id, item_id, unit_value, quantity, confidence, color, cast(quantity as bigint)*unit_value total_value
  from gh join {_PAGES} using (page_id) where not ghost and quantity <> -1
  qualify row_number() over (partition by session_id, item_id order by quantity desc, confidence desc, page_seq, dist, anchor_ord) = 1""")
def _(spark, sf):
    return grids.session_items(FX.blocks(spark, sf, "grid"), FX.load(spark, sf, "rescan"))[0]


@query("build_xp_conflicts", f"""with recursive {XP}, {GHOST}, o as (select g.*, session_id, page_seq from gh g join {_PAGES} using (page_id) where not ghost and quantity <> -1),
  w as (select *, max(quantity) over (partition by session_id, item_id order by page_seq, dist, anchor_ord rows between unbounded preceding and 1 preceding) previous_qty from o)
  select session_id, item_id, page_seq, anchor_ord, previous_qty, quantity new_qty, greatest(previous_qty, quantity) chosen_qty from w where previous_qty <> quantity""")
def _(spark, sf):
    return grids.session_items(FX.blocks(spark, sf, "grid"), FX.load(spark, sf, "rescan"))[1].drop("dist")


# --- rescans ---------------------------------------------------------------------------------------

@query("rescan_join", f"""with b as (select page_id, ord from ({GRID}) where color='Blue'), fx as ({RESCAN})
  select fx.page_id, fx.ord, region_id, shot, txt, conf from fx join b using (page_id, ord) where shot = 1""")
def _(spark, sf):
    rescans = FX.load(spark, sf, "rescan")
    wanted = FX.load(spark, sf, "grid").filter(F.col("color") == "Blue").select("page_id", "ord", (F.col("page_id") * 100 + F.col("ord")).alias("region_id"), F.lit(1).alias("shot"))
    return RS.rescan_join(wanted, rescans).select("page_id", "ord", "region_id", "shot", "txt", "conf")


@query("rescan_accept", rf"""with fx as ({RESCAN})
  select 'report' kind, page_id, ord, shot, txt, conf from fx where conf > 0.60 union all
  select 'titles', page_id, ord, shot, txt, conf from fx where conf > 0.75 and regexp_matches(txt, '\d') union all
  select 'profile', page_id, ord, shot, txt, conf from fx where length(trim(txt)) >= 3 qualify row_number() over (partition by page_id, ord order by shot) = 1""")
def _(spark, sf):
    r = FX.load(spark, sf, "rescan").select("page_id", "ord", "shot", "txt", "conf")
    out = None
    for kind, f in (("report", RS.accept_report), ("titles", RS.accept_titles), ("profile", RS.accept_profile)):
        part = f(r).select(F.lit(kind).alias("kind"), "page_id", "ord", "shot", "txt", "conf")
        out = part if out is None else out.unionByName(part)
    return out


@query("repair_assignment", rf"""with n as (select page_id, ord, txt, conf from ({GRID}) where conf < 0.85),
  b as (select page_id, ord, txt, conf from ({RESCAN}) where conf > 0.60 and regexp_matches(txt, '^\d+$') qualify row_number() over (partition by page_id, ord order by conf desc, shot) = 1)
  select n.page_id, n.ord, case when b.conf > n.conf then b.txt else n.txt end txt, case when b.conf > n.conf then b.conf else n.conf end conf, coalesce(b.conf > n.conf, false) repaired
  from n left join b using (page_id, ord)""")
def _(spark, sf):
    unsure = FX.load(spark, sf, "grid").filter(F.col("conf") < 0.85).select("page_id", "ord", "txt", "conf")
    return RS.repair_assignment(unsure, FX.load(spark, sf, "rescan"))


@query("repair_pool", rf"""with recursive n as (select page_id, ord, txt, conf, row_number() over (partition by page_id order by ord) i from ({GRID}) where conf < 0.85),
  b as (select page_id, txt, conf, row_number() over (partition by page_id order by conf desc, ord, shot) rank from ({RESCAN}) where conf > 0.60 and regexp_matches(txt, '^\d+$')),
  f as (select distinct page_id, 0::bigint i, 0::bigint used, null::int ord, null::varchar txt, null::double conf, false repaired from n
    union all select f.page_id, n.i, used + coalesce(b.conf > n.conf, false)::int, n.ord, case when b.conf > n.conf then b.txt else n.txt end,
      case when b.conf > n.conf then b.conf else n.conf end, coalesce(b.conf > n.conf, false)
    from f join n on n.page_id=f.page_id and n.i=f.i+1 left join b on b.page_id=f.page_id and b.rank=f.used+1)
  select page_id, ord, txt, conf, repaired from f where i > 0""")
def _(spark, sf):
    unsure = FX.load(spark, sf, "grid").filter(F.col("conf") < 0.85).select("page_id", "ord", "txt", "conf")
    return RS.repair_assignment(unsure, FX.load(spark, sf, "rescan"), pool=True)


@query("best_per_region", f"""with q as (select distinct page_id, ord, page_id*100+ord region_id from ({GRID})),
  l as (select region_id, shot line, txt, conf from ({RESCAN}) where conf > 0.5)
  select page_id, ord, q.region_id, coalesce(txt, '') txt, coalesce(conf, 0) conf from q left join
   (select * from l qualify row_number() over (partition by region_id order by conf desc, line) = 1) b using (region_id)""")
def _(spark, sf):
    requests = FX.load(spark, sf, "grid").select("page_id", "ord", (F.col("page_id") * 100 + F.col("ord")).alias("region_id"))
    lines = FX.load(spark, sf, "rescan").filter(F.col("conf") > 0.5).select("region_id", F.col("shot").alias("line"), "txt", "conf")
    return RS.best_per_region(requests, lines)


@query("clip_regions", f"""with fx as (select page_id, ord, x0-20 x, y0-10 y, cast(y2-y0 as int)*3 w, cast(y2-y0 as int) h from ({GRID})), c as (select page_id, ord, greatest(0,x) x, greatest(0,y) y, w, h from fx),
  d as (select page_id, ord, x, y, least(w, 90-x) w, least(h, 300-y) h from c), p as (select page_id, ord, greatest(0,x-25) x, greatest(0,y-25) y, least(90, x+w+25) xe, least(300, y+h+25) ye from fx)
  select 'batch' kind, * from d where w > 0 and h > 0 union all select 'profile', * from d where w > 10 and h > 10
  union all select 'padded', page_id, ord, x, y, xe-x, ye-y from p where xe-x > 0 and ye-y > 0""")
def _(spark, sf):
    regions = FX.load(spark, sf, "grid").select("page_id", "ord", (F.col("x0") - 20).alias("x"), (F.col("y0") - 10).alias("y"),
                                                ((F.col("y2") - F.col("y0")) * 3).cast("int").alias("w"), (F.col("y2") - F.col("y0")).cast("int").alias("h"))
    out = None
    for kind, size, pad in (("batch", 1, 0), ("profile", 11, 0), ("padded", 1, 25)):
        part = RS.clip_regions(regions, F.lit(90), F.lit(300), size, pad).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def _shots(names, geometry, src):
    return " union all ".join(f"select page_id, ord, {i + 1} shot, '{n}' strategy, {geometry} from {src}" for i, n in enumerate(names))


_PLAN_REPORT = _shots(RS.REPORT_STRATEGIES, "greatest(0, cast(trunc(x0) as int)-10) x, greatest(0, cast(trunc(y0) as int)-8) y, cast(x2-x0 as int)+25 w, cast(y2-y0 as int)+16 h", "n")
_PLAN_TITLES = _shots(RS.TITLE_STRATEGIES, "greatest(0, cast(x0 as int)-5), cast(y0 as int), cast(x2-x0 as int)+15, cast(y2-y0 as int)", "n")
_T = "cast(trunc({}) as int)"
_PLAN_GRID = " union all ".join([
    f"select page_id, ord, 1, 'WhiteIsolation', {_T.format('(x0+x2)/2e0 - floor(trunc(m*10)/2)')}, {_T.format('y2-m*0.2e0')}, {_T.format('m*10')}, {_T.format('m*4.5e0')} from o",
    f"select page_id, ord, 2, 'WhiteIsolation', {_T.format('(x0+x2)/2e0')}, {_T.format('y2-m*0.2e0')}, {_T.format('m*6')}, {_T.format('m*4.5e0')} from o"])


@query("rescan_plan", f"""with recursive {GRID_CTES}, {GREEDY}, n as (select * from gfx where conf < 0.6),
  o0 as (select a.* from anch a where not exists (select 1 from mat m where m.page_id=a.page_id and m.anchor_ord=a.ord)),
  om as (select page_id, list_sort(list(y2-y0))[count(*)//2+1]::double m from o0 group by 1), o as (select o0.*, m from o0 join om using (page_id))
  select 'report' kind, * from ({_PLAN_REPORT}) union all select 'titles', * from ({_PLAN_TITLES}) union all select 'grid', * from ({_PLAN_GRID})""")
def _(spark, sf):
    unsure = FX.load(spark, sf, "grid").filter(F.col("conf") < 0.6)
    p = page(spark, sf)
    orphans = p.anchors.join(p.matches().select("page_id", F.col("anchor_ord").alias("ord")), ["page_id", "ord"], "left_anti")
    out = None
    for kind, plan in (("report", RS.plan_report(unsure)), ("titles", RS.plan_titles(unsure)), ("grid", RS.plan_grid(orphans))):
        part = plan.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


_W, _H = "(a.x2-a.x0)", "(a.y2-a.y0)"
_PROFILE_SHOTS = [("Civilization", 1, "1_Civ_Inverted_Binary", "x0-20", "y0-15", f"{_W}+800"), ("Civilization", 2, "2_Civ_Normal_Sharpen", "x0-20", "y0-15", f"{_W}+800"),
                  ("Power", 1, "1_Stat_Below_Binary", "x0-20", f"y0+{_H}*0.5e0", f"{_W}+300"), ("Power", 2, "2_Stat_Wide_Contrast", "x0-50", "y0-10", f"{_W}+400"),
                  ("KillPoints", 1, "1_Stat_Below_Binary", "x0-20", f"y0+{_H}*0.5e0", f"{_W}+300"), ("KillPoints", 2, "2_Stat_Wide_Contrast", "x0-50", "y0-10", f"{_W}+400"),
                  ("Alliance", 1, "1_Alliance_Panorama", "x0-50", f"y0+{_H}*0.5e0", f"{_W}+500"), ("Name", 1, "1_Name_Panorama", "x0-150", f"y0+{_H}", f"{_W}+500")]
_FIELD_OF = {**{v: k for k, v in SEARCHED_BY.items()}, "Name": "ID"}


@query("rescan_plan_profile", f"""with {S.profile_ctes()}, {S.anchor_cte()}, {S.id_cte()},
  every as (select * from anc union all select page_id, 'ID', t.ord, t.cx, t.cy, x0, y0, x2, y2 from ids i join typed t using (page_id) where t.ord = i.ord) """ + " union all ".join(
    f"select page_id, ord, '{f}' field, {s} shot, '{n}' strategy, cast(trunc({x}) as int) x, cast(trunc({y}) as int) y, cast({w} as int) w, 300 h from every a where anchor='{_FIELD_OF[f]}'"
    for f, s, n, x, y, w in _PROFILE_SHOTS))
def _(spark, sf):
    return RS.plan_profile(P.search_anchors(prepared_profile(spark, sf)))


# --- titled item lists -----------------------------------------------------------------------------

_TITLES = "(values " + ", ".join(f"('{t}', {v}, '{i}')" for t, v, i in G.DEFAULT.titled_items) + ") k(title, unit_value, item_id)"
OWNED = r"(?i)(?:Own|Owned|Possui|Possuído).*?(\d[\d.,]*)"
_OWN = S.int0(f"replace(replace(regexp_extract(txt, '{OWNED}', 1), '.', ''), ',', '')")
_BAR = r"(\d[\d,.]*)\s*/\s*(\d[\d,.]*)"
_CUR, _MAX = (S.int0(f"replace(replace(regexp_extract(txt, '{_BAR}', {g}), '.', ''), ',', '')") for g in (1, 2))
AP = f"""tfx as (select *, {S.GEO} from ({TITLED})),
  tit as (select t.*, k.title, k.unit_value, k.item_id from tfx t join {_TITLES} on {S.sim('t.txt', 'k.title')} > 0.85e0 qualify row_number() over (partition by page_id, item_id order by conf desc, ord) = 1),
  lin as (select t.page_id, t.item_id, t.title, t.unit_value, t.ord title_ord, t.conf t_conf, n.ord, n.txt, n.conf, n.cy from tit t join tfx n on n.page_id=t.page_id and n.ord <> t.ord
    where n.cy > t.y2 and n.cy < t.y2+(t.y2-t.y0)*4.5e0 and n.cx >= t.x0-(t.y2-t.y0)*2 and n.cx <= t.x2+(t.y2-t.y0)*2 and regexp_matches(n.txt, '{OWNED}')
    qualify row_number() over (partition by t.page_id, t.item_id order by n.cy, n.ord) = 1),
  pit as (select page_id, item_id, title, unit_value, {_OWN} quantity, round_even((t_conf+conf)/2*100, 2) confidence from lin where {_OWN} > 0),
  top10 as (select *, row_number() over (partition by page_id order by y0, ord) rk from tfx qualify row_number() over (partition by page_id order by y0, ord) <= 10),
  bar as (select session_id, page_seq, page_id, {_CUR} bar_current, {_MAX} bar_max from top10 where {_MAX} > 0 qualify row_number() over (partition by page_id order by rk) = 1)"""
_READS = "select session_id, item_id, page_seq seq, cast(quantity as bigint) qty, confidence conf from pit join (select distinct page_id, session_id, page_seq from tfx) using (page_id)"


def titled(spark, sf):
    return FX.blocks(spark, sf, "titled")


@query("title_lookup", f"with {AP} select page_id, item_id, ord, conf from tit")
def _(spark, sf):
    return item_lists.title_lookup(titled(spark, sf)).select("page_id", "item_id", "ord", "conf")


@query("title_to_quantity", f"with {AP} select page_id, item_id, title_ord, ord, txt from lin")
def _(spark, sf):
    from blockwise.operators.neighbours import title_to_quantity
    b = with_geometry(titled(spark, sf))
    return title_to_quantity(item_lists.title_lookup(b), b).select("page_id", "item_id", "title_ord", "ord", "txt")


@query("pair_confidence", f"with {AP} select page_id, item_id, quantity, confidence from pit")
def _(spark, sf):
    return item_lists.page_items(with_geometry(titled(spark, sf))).select("page_id", "item_id", "quantity", "confidence")


@query("parse_owned_quantity", f"with fx as ({TITLED}) select page_id, ord, {_OWN} quantity from fx")
def _(spark, sf):
    return titled(spark, sf).select("page_id", "ord", numbers.owned_quantity(F.col("txt")).alias("quantity"))


@query("parse_bar", f"with fx as ({TITLED}) select page_id, ord, {_CUR} bar_current, {_MAX} bar_max from fx")
def _(spark, sf):
    current, maximum = numbers.bar_values(F.col("txt"))
    return titled(spark, sf).select("page_id", "ord", current.alias("bar_current"), maximum.alias("bar_max"))


@query("topn_by_position", f"with {AP} select session_id, page_seq, page_id, bar_current, bar_max from bar")
def _(spark, sf):
    return item_lists.page_bars(titled(spark, sf))


@query("first_value_wins", f"with {AP} select session_id, page_seq, bar_current, bar_max from bar qualify row_number() over (partition by session_id order by page_seq) = 1")
def _(spark, sf):
    return M.first_value_wins(item_lists.page_bars(titled(spark, sf)))


@query("first_value_divergence", f"""with {AP}, w as (select * from bar qualify row_number() over (partition by session_id order by page_seq) = 1)
  select session_id, b.page_seq, '[AP Bar] Divergence detected in image ' || b.page_seq || '. Previous: ' || w.bar_current || '/' || w.bar_max || ', New: ' || b.bar_current || '/' || b.bar_max || '. Kept previous value.' message
  from bar b join w using (session_id) where b.bar_max <> w.bar_max or b.bar_current <> w.bar_current""")
def _(spark, sf):
    return item_lists.bar_warnings(titled(spark, sf))


@query("build_ap_items", f"""with recursive {AP}, {fold_ctes(_READS)}, w as (select * from f qualify row_number() over (partition by session_id, item_id order by n desc) = 1)
  select session_id, item_id, k.title, k.unit_value, qty quantity, conf confidence, qty*k.unit_value total_value from w join {_TITLES} using (item_id)""")
def _(spark, sf):
    return item_lists.session_items(titled(spark, sf))[0]


@query("build_ap_summary", f"""with recursive {AP}, {fold_ctes(_READS)}, w as (select * from f qualify row_number() over (partition by session_id, item_id order by n desc) = 1),
  g as (select session_id, cast(sum(qty*k.unit_value) as bigint) grand_total, count(*) n_items from w join {_TITLES} using (item_id) group by 1),
  b as (select session_id, bar_current, bar_max from bar qualify row_number() over (partition by session_id order by page_seq) = 1)
  select * from g full join b using (session_id)""")
def _(spark, sf):
    blocks = titled(spark, sf)
    return item_lists.session_summary(blocks, item_lists.session_items(blocks)[0])
