"""DuckDB expressions the checking SQL is put together from."""

from __future__ import annotations

from blockwise.vocabulary import KEYWORDS, METRIC_LISTS, METRIC_STRIP_ORDER, PROFILE_UI_LISTS
from suite.fixtures import sql as fixture


def lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def words(*names: str) -> str:
    return "[" + ", ".join(lit(w) for n in names for w in KEYWORDS[n]) + "]"


def sim(a: str, b: str) -> str:
    return (f"(case when length({a})=0 or length({b})=0 then 0e0 else 1e0 - levenshtein(lower({a}), lower({b}))::double"
            f" / greatest(length(lower({a})), length(lower({b}))) end)")


def any_sim(t: str, t_min: float, *names: str) -> str:
    return f"(len(list_filter({words(*names)}, lambda w: {sim(t, 'w')} > {t_min}e0)) > 0)"


def any_contains(t: str, *names: str) -> str:
    return f"(len(list_filter({words(*names)}, lambda w: contains(lower({t}), lower(w)))) > 0)"


def any_match(t: str, t_min: float, *names: str) -> str:
    return f"(len(list_filter({words(*names)}, lambda w: contains(lower({t}), lower(w)) or {sim(t, 'w')} > {t_min}e0)) > 0)"


def int0(t: str, kind: str = "int") -> str:
    return f"coalesce(try_cast({t} as {kind}), 0::{kind})"


def digits(t: str) -> str:
    return f"regexp_replace({t}, '[^0-9]', '', 'g')"


def digits_int(t: str) -> str:
    return int0(digits(t))


PURE_NUMBER = r"regexp_matches(replace(replace(replace(replace(trim({t}),'.',''),',',''),' ',''),'+',''), '^\d+[KM]?$')"


def pure_number(t: str) -> str:
    return PURE_NUMBER.replace("{t}", t)


def player_id(t: str) -> str:
    return int0(rf"regexp_extract(regexp_replace({t}, '(ID|1D|lD|Id|id)\s*[:).]?\s*', '', 'g'), '\d{{7,10}}')")


def grouped_long(t: str) -> str:
    return int0(rf"regexp_extract(replace(replace(replace(replace({t},'.',''),',',''),'K','000'),'M','000000'), '\d+')", "bigint")


def metric_text(t: str) -> str:
    labels = ", ".join(lit(w.upper()) for n in METRIC_STRIP_ORDER for w in KEYWORDS[n])
    bare = f"list_reduce([upper({t}), {labels}], lambda a, x: replace(a, x, ''))"
    return f"trim(replace(replace(replace(replace(replace({bare},'|',' '),'I','1'),'L','1'),'O','0'),'+',''))"


def suffixed_number(t: str, fix: bool = True) -> str:
    """Scalar subquery over one text."""
    p = r"(\d+[.,]?\d*)\s*([KM]?)"
    g = r"^[^0-9]*(\d{1,3}(?:[.,]\d{3}){2,})\s*([KM]?)"
    fixed = "g <> ''" if fix else "false"
    return rf"""(case when trim({t}) = '' or contains({t}, '%') then 0::bigint else (
      select coalesce(cast(round_even(try_cast(n as double) * case sfx when 'K' then 1000 when 'M' then 1000000 else 1 end, 0) as bigint), 0) from (
        select case when {fixed} then replace(replace(g,'.',''),',','') when s = '' and regexp_matches(num, '\.\d{{3}}$') then replace(num,'.','') else rtrim(num,'.') end n,
               case when {fixed} then gs else s end sfx from (
          select replace(regexp_extract(c, '{p}', 1), ',', '.') num, regexp_extract(c, '{p}', 2) s,
                 regexp_extract(c, '{g}', 1) g, regexp_extract(c, '{g}', 2) gs from (select {metric_text(t)} c)))) end)"""


def clean_name(t: str) -> str:
    return rf"trim(regexp_replace({t}, '[^\w\s\-\[\]]', '', 'g'))"


def clean_tag(t: str) -> str:
    return rf"""trim(regexp_replace({t}, '[^a-zA-Z0-9\-_."'':!@#$%&*+=<>?]', '', 'g'))"""


def split_tag(t: str) -> tuple[str, str]:
    """(tag, name) of a trimmed text column."""
    body, sp = f"substr({t},2)", f"strpos(substr({t},2),' ')"
    first = clean_tag(f"split_part({t},' ',1)")
    near = f"{sp} between 2 and 6"
    loose = f"strpos({t},' ')>0 and length({first}) between 2 and 5"
    tag = (f"case when strpos({t},']')>1 then {clean_tag(f'''replace(substr({t},1,strpos({t},']')-1),'[','')''')}"
           f" when starts_with({t},'[') then {clean_tag(f'''case when {near} then substr({body},1,{sp}-1) else substr({body},1,4) end''')}"
           f" when {loose} then {first} else '--' end")
    name = (f"case when strpos({t},']')>1 then {clean_name(f'''substr({t},strpos({t},']')+1)''')}"
            f" when starts_with({t},'[') then {clean_name(f'''case when {near} then substr({body},{sp}+1) else substr({body},5) end''')}"
            f" when {loose} then {clean_name(f'''substr({t},strpos({t},' ')+1)''')} else {clean_name(t)} end")
    return tag, name


def split_rigid(t: str) -> tuple[str, str]:
    """(tag, suffix) of a trimmed text column."""
    both, tail = r"^\[([^\]]{2,6})\](.*)", r"^(.{3,5})\](.*)"
    bare = f"trim(replace(replace({t},'[',''),']',''))"
    half = f"starts_with({t},'[') and length({t})>=5"
    tag = (f"case when regexp_matches({t},'{both}') then regexp_extract({t},'{both}',1) when regexp_matches({t},'{tail}') then regexp_extract({t},'{tail}',1)"
           f" when {half} then substr({t},2,4) else substr({bare},1,5) end")
    suffix = (f"case when regexp_matches({t},'{both}') then regexp_extract({t},'{both}',2) when regexp_matches({t},'{tail}') then regexp_extract({t},'{tail}',2)"
              f" when {half} then substr({t},6) else '' end")
    return tag, suffix


def player_name(t: str) -> str:
    return rf"""coalesce(trim({t}) <> '' and length({t}) >= 2 and not regexp_matches({t}, '\d{{4}}/\d{{2}}/\d{{2}}') and not regexp_matches({t}, '\d{{2}}:\d{{2}}')
      and not regexp_matches({t}, '(?i)X:?\s*\d+.*Y:?\s*\d+') and not {any_contains(t, 'pve_terms', 'ui_blacklist')}, false)"""


def bare_name(t: str) -> str:
    return f"trim(replace(replace({t},'[',''),']',''))"


def profile_type(t: str) -> str:
    t = f"trim({t})"
    return rf"""case when {any_sim(t, 0.82, *PROFILE_UI_LISTS)} then 'UI'
      when regexp_matches({t}, '\d+[.,]?\d*\s*/\s*\d+') then 'BarStatus'
      when regexp_matches(replace(replace({t},'l','1'),'I','1'), '\d{{7,12}}') then 'ID'
      when try_cast({digits(t)} as bigint) is not null and not regexp_matches({t}, '\p{{L}}') then 'Number'
      when {any_match(t, 0.75, 'civilizations')} then 'Civilization'
      when starts_with({t}, '[') then 'Tag'
      when regexp_matches({t}, 'UTC|\d{{1,2}}:\d{{2}}') then 'DateOrTime' else 'Unknown' end"""


def report_type(t: str) -> str:
    t = f"trim({t})"
    metrics = "\n".join(f"when {any_match(t, 0.85, n)} then '{k}'" for n, k in METRIC_LISTS)
    return rf"""case when {t} = '' then 'Unknown' {metrics}
      when {any_match(t, 0.85, 'victory', 'defeat')} then 'StatusResult'
      when regexp_matches({t}, '^\[.+|\[.*\]') then 'Tag'
      when {pure_number(t)} then 'Number'
      when regexp_matches({t}, '\d{{2}}:\d{{2}}|UTC|\d{{2}}/\d{{2}}') or regexp_matches({t}, '(?i)X:?\s*\d+.*Y:?\s*\d+') then 'DateOrTime'
      when {any_contains(t, 'global_blacklist', 'ui_blacklist')} then 'UI' else 'Unknown' end"""


GEO = "(x0+x2)/2e0 cx, (y0+y2)/2e0 cy"
NGEO = "(x0+x2)/2e0 cx, (y0+y2)/2e0 cy, (x0+x2)/2e0/1000 nx, (y0+y2)/2e0/1000 ny"


def profile_ctes(source: str | None = None) -> str:
    """fx, typed: profile blocks with type and centre."""
    return f"""fx as ({source or fixture('profile', 'duckdb')}),
    kinds as (select txt, {profile_type('txt')} block_type from (select distinct txt from fx)),
    typed as (select fx.*, block_type, {GEO} from fx join kinds using (txt))"""


def anchor_cte(source: str = "typed") -> str:
    lists = {"AllianceLabel": "alliance_labels", "PowerLabel": "power_labels", "KpLabel": "kill_points_labels", "CivLabel": "civilization_labels"}
    parts = " union all ".join(
        f"select page_id, '{a}' anchor, min(ord) ord from {source} where {any_sim('txt', 0.82, w)} group by 1" for a, w in lists.items())
    return f"anc as (select a.page_id, anchor, a.ord, t.cx, t.cy, t.x0, t.y0, t.x2, t.y2 from ({parts}) a join {source} t using (page_id, ord))"


def id_cte(source: str = "typed") -> str:
    pid = player_id("txt")
    return f"""ids as (select page_id, ord, {pid} v, cx, cy, txt, conf_ from (
        select *, 95 conf_, 0 pri, 0 nm from {source} where block_type='ID'
        union all select *, 70, 1, case when contains(upper(txt),'ID') then 0 else 1 end from {source}
          where block_type in ('Unknown','Number') and cy < 600 and {pid} > 1000000 and {pid} < 2000000000)
      qualify row_number() over (partition by page_id order by pri, nm, ord) = 1)"""


def dist(a: str, b: str) -> str:
    return f"sqrt(({a}.cx-{b}.cx)*({a}.cx-{b}.cx)+({a}.cy-{b}.cy)*({a}.cy-{b}.cy))"


def first_civ(t: str) -> str:
    return f"coalesce(list_filter({words('civilizations')}, lambda w: contains(lower({t}), lower(w)) or {sim(t, 'w')} > 0.75e0)[1], {t})"


def profile_chain(source: str | None = None, suffix: str = "") -> str:
    """CTEs up to prof{suffix}: audited profiles of a block source."""
    tag, name = split_tag("t")
    chain = f"""{profile_ctes(source)}, {anchor_cte()}, {id_cte()},
    nums as (select page_id, ord, {grouped_long('txt')} v, cx, cy from typed where block_type='Number' and {grouped_long('txt')} > 1000),
    pw as (select n.page_id, n.v, n.ord from nums n join anc a on a.page_id=n.page_id and anchor='PowerLabel' left join ids i on i.page_id=n.page_id
           where n.ord is distinct from i.ord qualify row_number() over (partition by n.page_id order by {dist('n', 'a')}, n.ord)=1),
    kp as (select n.page_id, n.v, n.ord from nums n join anc a on a.page_id=n.page_id and anchor='KpLabel' left join ids i on i.page_id=n.page_id
             left join pw p on p.page_id=n.page_id where n.ord is distinct from i.ord and n.ord is distinct from p.ord and n.v <> coalesce(p.v,0)
           qualify row_number() over (partition by n.page_id order by {dist('n', 'a')}, n.ord)=1),
    tg as (select page_id, ord, cx, cy, {tag} tag, {name} nm from (select *, trim(txt) t from typed where block_type='Tag' qualify row_number() over (partition by page_id order by ord)=1)),
    tg1 as (select * from tg where length(tag) >= 2 and tag <> '--'),
    nb as (select g.page_id, {clean_name('u.txt')} beside from tg1 g join typed u on u.page_id=g.page_id and u.block_type='Unknown' and u.cx > g.cx and abs(u.cy-g.cy) < 40
           where g.nm = '' qualify row_number() over (partition by g.page_id order by abs(u.cx-g.cx), u.ord)=1),
    near as (select u.page_id, u.ord, trim(u.txt) t, row_number() over (partition by u.page_id order by {dist('u', 'a')}, u.ord) rk
             from typed u join anc a on a.page_id=u.page_id and anchor='AllianceLabel' left join ids i on i.page_id=u.page_id left join pw on pw.page_id=u.page_id left join kp on kp.page_id=u.page_id
             where u.block_type='Unknown' and u.ord is distinct from i.ord and u.ord is distinct from pw.ord and u.ord is distinct from kp.ord and u.page_id not in (select page_id from tg1)),
    near1 as (select page_id, ord, rk, {tag} tag, {name} nm from near where rk <= 3 and not contains(lower(t),'alianca') and not contains(lower(t),'alliance')),
    al as (select g.page_id, tag, coalesce(beside, nm) nm, 95 conf_, ord from tg1 g left join nb using (page_id)
           union all select page_id, tag, nm, 80, ord from near1 where length(tag) >= 2 and tag <> '--' qualify row_number() over (partition by page_id order by rk)=1),
    sc as (select c.page_id, c.ord, c.txt, 100 - case when abs(c.cx-i.cx) > 300 then 50 else 0 end
             + case when c.cy-i.cy > 0 and c.cy-i.cy < 120 and abs(c.cx-i.cx) < 150 then 50 else 0 end score
           from typed c join ids i on i.page_id=c.page_id left join pw on pw.page_id=c.page_id left join kp on kp.page_id=c.page_id left join al on al.page_id=c.page_id
           where c.block_type in ('Unknown','Tag') and length(c.txt) >= 3 and c.ord is distinct from i.ord and c.ord is distinct from pw.ord and c.ord is distinct from kp.ord and c.ord is distinct from al.ord
             and c.cy-i.cy >= -20 and c.cy-i.cy <= 200 and not contains(c.txt, cast({digits_int('i.txt')} as varchar)) and not {any_match('c.txt', 0.8, 'ui_keywords')}
             and not exists (select 1 from typed b where b.page_id=c.page_id and b.block_type='BarStatus' and abs(b.cy-c.cy) < 30 and abs(b.cx-c.cx) < 450)),
    bn as (select page_id, ord, score, {clean_name('txt')} nm from sc where score > 0 qualify row_number() over (partition by page_id order by score desc, ord)=1),
    cv as (select page_id, ord, {first_civ('txt')} civ from typed where block_type='Civilization' qualify row_number() over (partition by page_id order by ord)=1),
    raw as (select p.page_id, coalesce(i.v, 0) id, coalesce(bn.nm,'--') name, coalesce(al.tag,'--') alliance_tag, coalesce(al.nm,'--') alliance_name,
              coalesce(pw.v,0) power, coalesce(kp.v,0) kill_points, coalesce(civ,'--') civilization
            from (select distinct page_id from fx) p left join ids i using (page_id) left join bn on bn.page_id=p.page_id left join al on al.page_id=p.page_id
              left join pw on pw.page_id=p.page_id left join kp on kp.page_id=p.page_id left join cv on cv.page_id=p.page_id),
    aud as (select page_id, id, case when trim(name)='' then '--' else name end name, case when trim(alliance_tag)='' then '--' else alliance_tag end alliance_tag,
              case when trim(alliance_name)='' then '--' else alliance_name end alliance_name,
              case when power > 1500000000 then kill_points else power end power, case when power > 1500000000 then power else kill_points end kill_points, civilization from raw),
    prof as (select *, id > 0 and (name <> '--' or power > 0) success, id > 0 and power > 0 and name <> '--' and civilization <> '--' complete from aud)"""
    if suffix:
        for n in ("fx", "kinds", "typed", "anc", "ids", "nums", "pw", "kp", "tg", "tg1", "nb", "near", "near1", "al", "sc", "bn", "cv", "raw", "aud", "prof"):
            import re
            chain = re.sub(rf"(?<![\w.'])\b{n}\b(?![\w'(])", n + suffix, chain)
    return chain


SIDES = "(values ('attacker',0e0,0.5e0),('defender',0.5e0,1e0)) v(side,lo,hi)"


def tokens(t: str) -> str:
    return rf"array_to_string(list_sort(string_split_regex(trim({t}), '\s+')), ' ')"


def norm(t: str) -> str:
    return f"strip_accents(lower({t}))"


def report_ctes(source: str | None = None) -> str:
    """rfx, rkinds, rtyped: report blocks with type, flags and normalised centre."""
    return f"""rfx as ({source or fixture('report', 'duckdb')}),
    rkinds as (select txt, {report_type('txt')} block_type, {any_match('txt', 0.85, 'npc')} npc_like, {any_contains('txt', 'npc')} npc_word,
      {any_contains('txt', 'victory', 'defeat')} outcome_word, {player_name('txt')} nameable, {suffixed_number('txt')} num from (select distinct txt from rfx)),
    rtyped as (select rfx.*, block_type, npc_like, npc_word, outcome_word, nameable, num, {NGEO} from rfx join rkinds using (txt))"""


def neighbour(src: str, direction: str, keys: str, where: str = "true") -> str:
    """Nearest block ahead of each source (keys, nx, ny, reach) as t.*; the source's keys come along."""
    dx, dy = "(t.nx-s.nx)", "(t.ny-s.ny)"
    ahead, cost = {"right": (f"{dx} > 0", f"abs({dy})*10+abs({dx})"), "left": (f"{dx} < 0", f"abs({dy})*10+abs({dx})"),
                   "down": (f"{dy} > 0", f"abs({dx})*10+abs({dy})"), "up": (f"{dy} < 0", f"abs({dx})*10+abs({dy})")}[direction]
    part = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""(select {part}, t.ord t_ord, t.txt t_txt, t.block_type t_type, t.nameable t_nameable, t.num t_num from {src} s join rtyped t on t.page_id=s.page_id
      where {ahead} and {cost} < 1000 and abs({dx}) < s.reach and abs({dy}) < s.reach and {where}
      qualify row_number() over (partition by {part} order by {cost}, t.ord) = 1)"""


def entity_best(src: str, dictionary: str) -> str:
    """raw_name -> entry_id from a dictionary CTE (entry_id, entry_ord, label, label_ord)."""
    a, b = norm("m.raw_name"), norm("d.label")
    score = f"100e0*greatest({sim(a, b)}, {sim(tokens(a), tokens(b))})"
    return f"""(select raw_name, entry_id, {norm('label')} label, score from (select m.raw_name, d.*, {score} score from (select distinct raw_name from {src}) m cross join {dictionary} d)
      where score >= 83 qualify row_number() over (partition by raw_name order by score desc, entry_ord, label_ord) = 1)"""


ENTITIES = "select 'E' || cast(label_ord as string) entry_id, label_ord entry_ord, label, 0 label_ord, label canonical from ({dict})"
NPCS = ("select 'N' || cast(label_ord as string) entry_id, label_ord entry_ord, label, 0 label_ord, label canonical from ({dict})"
        " union all select 'NB', cast(-1 as bigint), 'Barbarian', 0, 'Barbarian'")


def report_chain(source: str | None = None) -> str:
    """CTEs up to bsides (long) and rpages (one row per page)."""
    d = fixture("dictionary", "duckdb")
    tag, suffix = split_rigid("trim(tag_txt)")
    metrics = {"UnitsLabel": "total_units", "HealedLabel": "healed", "DeadLabel": "dead", "SevereWoundedLabel": "severely_wounded",
               "SlightlyWoundedLabel": "slightly_wounded", "RemainingLabel": "remaining", "KillPointsLabel": "kill_points", "WatchtowerLabel": "watchtower_damage"}
    kinds = ", ".join(f"'{k}'" for k in metrics)
    pivot = ", ".join(f"coalesce(max(v) filter (where block_type='{k}'), 0) {c}" for k, c in metrics.items())
    mcols = ", ".join(f"coalesce(m.{c}, 0) {c}" for c in metrics.values())
    both = ", ".join(f"max({c}) filter (where side='{s}') {s[0]}_{c}" for s in ("attacker", "defender") for c in ("governor_name", "alliance_tag", "primary_id", *metrics.values()))

    def gap(p):
        return f"({p}total_units+{p}healed-({p}dead+{p}severely_wounded+{p}slightly_wounded+{p}remaining+{p}watchtower_damage))"
    ok_a, ok_d = (f"({p}total_units > 0 and abs({gap(p)}) <= 1)" for p in ("a_", "d_"))
    return rf"""{report_ctes(source)}, ents as ({ENTITIES.format(dict=d)}), npcd as ({NPCS.format(dict=d)}),
    pg as (select page_id, bool_or(npc_like) npc, coalesce(arg_min(ny, ord) filter (where block_type='StatusResult' or outcome_word), 0.4e0) start_y,
      arg_min(trim(txt), ord) filter (where npc_word) npc_txt, arg_min(txt, ord) filter (where contains(txt,'%') and nx > 0.5) pct,
      arg_min(txt, ord) filter (where regexp_matches(txt, '(\d{{2,4}}[/-]\d{{2}}([/-]\d{{2,4}})?)')) dated,
      arg_min(txt, ord) filter (where regexp_matches(txt, '(?i)X:?\s*(\d+)\D*Y:?\s*(\d+)')) placed,
      avg(conf) mean_conf, bool_and(isolated) isolated from rtyped group by 1),
    tags as (select page_id, side, ord src_ord, txt tag_txt, nx, ny, 0.35e0 reach from rtyped cross join {SIDES}
      where block_type <> 'UI' and (contains(txt,'[') or contains(txt,']')) and x0/1000e0 between lo and hi and y0/1000e0 between 0 and 0.4e0
      qualify row_number() over (partition by page_id, side order by conf desc, ord) = 1),
    loose as (select page_id, side, txt from rtyped cross join (values ('attacker',0.22e0,0.48e0),('defender',0.55e0,0.88e0)) v(side,lo,hi)
      where block_type='Unknown' and nameable and nx between lo and hi and ny > 0.08e0 and ny < 0.28e0 qualify row_number() over (partition by page_id, side order by ny, ord) = 1),
    labs as (select t.page_id, side, block_type, ord src_ord, txt, num, nx, ny, 0.45e0 reach from rtyped t join pg using (page_id) cross join {SIDES}
      where block_type in ({kinds}) and x0/1000e0 between lo and hi and y0/1000e0 between start_y and 1
      qualify row_number() over (partition by t.page_id, side, block_type order by ord) = 1),
    vals as (select l.page_id, l.side, l.block_type, case when l.num <= 1 then coalesce(t_num, l.num) else l.num end v
      from labs l left join {neighbour('labs', 'right', 'page_id, side, block_type')} n using (page_id, side, block_type)),
    mets as (select page_id, side, {pivot} from vals group by 1, 2),
    lev as (select page_id, ord, ny, nx, x0, txt, trim(regexp_replace(txt, '(?i)([LN]V\.?|Nível)\s*\d+', '', 'g')) rest, ord src_ord, 0.35e0 reach from rtyped
      where block_type <> 'UI' and regexp_matches(txt, '(?i)[LN]V\.?\s*\d+') and y0/1000e0 between 0.05e0 and 0.70e0),
    levb as (select * from lev where rest = ''),
    levn as (select l.page_id, l.ord, l.ny, l.x0, trim(regexp_replace(case when rest = '' then coalesce(case when t_type='Unknown' then t_txt end, '') else rest end, '^\d+\s*', '')) raw_name
      from lev l left join {neighbour('levb', 'right', 'page_id, src_ord')} n on n.page_id=l.page_id and n.src_ord=l.ord),
    levs as (select l.page_id, side, ord, ny, raw_name, npc and side='defender' npcside from levn l join pg using (page_id) cross join {SIDES} where x0/1000e0 between lo and hi and trim(raw_name) <> ''),
    found as (select l.*, e.entry_id from (select * from levs where not npcside) l join {entity_best('levs', 'ents')} e using (raw_name)
      union all select l.*, e.entry_id from (select * from levs where npcside) l join {entity_best('levs', 'npcd')} e using (raw_name)),
    once as (select page_id, side, entry_id, ny, ord from found qualify row_number() over (partition by page_id, side, entry_id order by ny, ord) = 1),
    ranked as (select *, row_number() over (partition by page_id, side order by ny, ord) rank from once),
    party as (select page_id, side, max(entry_id) filter (where rank=1) primary_id, max(entry_id) filter (where rank=2) secondary_id from ranked where rank <= 2 group by 1, 2),
    head as (select page_id, npc, npc_txt, pct, side from pg cross join {SIDES}),
    cut as (select page_id, side, tag_txt, {tag} tag, {suffix} suffix from tags),
    named0 as (select h.*, c.tag_txt, c.tag, p.primary_id, p.secondary_id, {mcols}, h.npc and h.side='defender' is_npc, e.canonical,
        case when {player_name('c.suffix')} then {bare_name('c.suffix')} when n.t_nameable then {bare_name('n.t_txt')} else coalesce({bare_name('lo.txt')}, '--') end own_name
      from head h left join cut c using (page_id, side) left join {neighbour('tags', 'right', 'page_id, side')} n using (page_id, side) left join loose lo using (page_id, side)
        left join mets m using (page_id, side) left join party p using (page_id, side) left join ents e on e.entry_id = p.primary_id),
    named as (select *, case when trim(nm) = '' then '--' else nm end nm2 from (select *, case when is_npc then coalesce(npc_txt, 'NPC_Entity') else own_name end nm from named0)),
    bsides as (select page_id, side, is_npc, case when is_npc or tag_txt is null then '--' else tag end alliance_tag,
        case when side='attacker' and canonical is not null and contains(nm2, canonical) then '--' else nm2 end governor_name, primary_id, secondary_id,
        {", ".join(metrics.values())},
        case when is_npc then coalesce(try_cast(replace(regexp_extract(pct, '(\d+[,.]\d+)', 1), ',', '.') as double), 0) end damage_percent,
        case when is_npc then {int0("regexp_extract(nm2, '" + chr(92) + "d+')")} end entity_level from named),
    wide as (select page_id, {both} from bsides group by 1),
    rpages0 as (select pg.*, w.* exclude (page_id), {ok_a} and (npc or {ok_d}) sound, {gap('a_')} a_gap from pg join wide w using (page_id)),
    warn as (select page_id, seq, code from (
      select page_id, 1 seq, 'WARN_IMAGE_NOT_ISOLATED' code, not isolated hit from rpages0
      union all select page_id, 2, 'WARN_UNSUPPORTED_CHARACTERS', a_alliance_tag <> '--' and a_governor_name = '--' from rpages0
      union all select page_id, 3, 'WARN_DATA_MISSING_TOTAL_UNITS', not sound and a_total_units = 0 from rpages0
      union all select page_id, 4, 'WARN_MATH_MISMATCH', not sound and a_total_units <> 0 from rpages0
      union all select page_id, 5, 'WARN_NAME_IDENTIFICATION_FAILED', a_governor_name = '--' and a_total_units > 0 from rpages0
      union all select page_id, 6, 'WARN_DUPLICATE_NAMES', {sim('a_governor_name', 'd_governor_name')} > 0.80e0 and a_governor_name <> '--' from rpages0
      union all select page_id, 7, 'WARN_HEADER_READ_AS_NAME', contains(a_governor_name, a_alliance_tag) and a_alliance_tag <> '--' from rpages0) where hit),
    rpages as (select p.*, (case when a_governor_name <> '--' then 1 else 0 end + case when a_alliance_tag <> '--' then 1 else 0 end
        + case when a_primary_id is not null then 1 else 0 end + case when d_governor_name <> '--' then 1 else 0 end) fields_found,
        exists (select 1 from warn w where w.page_id=p.page_id and seq >= 6) identity_hit,
        exists (select 1 from warn w where w.page_id=p.page_id) any_hit from rpages0 p),
    scored as (select *, greatest(0e0, least(100e0, case when sound then 50e0 when abs(a_gap) > 0 and a_total_units > 0 then greatest(0e0, (1 - abs(a_gap)/a_total_units::double)*25) else 0e0 end
        + coalesce(mean_conf,0)*100*0.20e0 + fields_found*5 + case when isolated then 10 else 0 end - case when a_governor_name='--' then 20 else 0 end - case when identity_hit then 40 else 0 end)) score from rpages)"""
