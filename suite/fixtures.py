"""Detection tables derived from the whole of the given tables.

Each view is one SQL text; only the small constant relations differ between the engines, where
Spark expands an inline array instead of joining.  Coordinates and confidences come from integer
arithmetic so that both engines give the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockwise.session import FILE_ROWS, cleared, stage

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

METRICS = [(1, "Units"), (2, "Healed"), (3, "Dead"), (4, "Severely Wounded"), (5, "Slightly Wounded"),
           (6, "Watchtower Damage"), (7, "Remaining"), (8, "Kill Points")]
TITLES = [(1, "Emergency Action Point Recovery", 50), (2, "Basic Action Point Recovery", 100),
          (3, "Intermediate Action Point Recovery", 500), (4, "Advanced Action Point Recovery", 1000)]


def _rows(dialect: str, alias: str, columns: list[str], rows: list[tuple]) -> str:
    """A constant relation joined to every row of what stands before it."""
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)
    if dialect == "spark":
        structs = ", ".join("struct(" + ", ".join(f"{lit(v)} as {c}" for v, c in zip(r, columns)) + ")" for r in rows)
        return f"lateral view inline(array({structs})) {alias} as {', '.join(columns)}"
    values = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"cross join (values {values}) {alias}({', '.join(columns)})"


# one page per customer
PROFILE = """
with b as (select c_custkey k, replace(c_name, 'Customer#000', 'Cust ') c_name, n_name, n_nationkey nk,
             substr(c_mktsegment,1,1) || cast(length(c_mktsegment)%10 as string) || right(c_mktsegment,1) s, abs(cast(round(c_acctbal*1000) as bigint)) p
           from customer join nation on c_nationkey = n_nationkey),
t as (select k, 1 ord, case when k%5=0 then '(1D: ' else 'ID: ' end || cast(10000000+k as string) txt, 400 x, 100 y from b
 union all select k, 2, case when k%7=0 then 'AB' || cast(k%10 as string) || ' ' || n_name
        when k%7=1 then '[' || s || cast(k%10 as string) || ']'
        else '[' || s || cast(k%10 as string) || ']' || n_name end, 400, 140+(k%3)*10 from b
 union all select k, 3, case when k%4=0 then 'P0wer' when k%4=1 then 'Poder' else 'Power' end, 400, 300 from b
 union all select k, 4, cast(p+2000 as string), 420, 330+k%7 from b
 union all select k, 5, case when k%6=0 then 'Kil1 Points' else 'Kill Points' end, 700, 300 from b
 union all select k, 6, cast(p*3+5000 as string), 720, 330 from b
 union all select k, 7, case when nk%3=0 then 'gChina' when nk%3=1 then 'Germany' else n_name end, 900, 300 from b
 union all select k, 8, cast(k%900 as string) || '/1000', 100, case when k%11=0 then 150+k%90 else 20 end from b
 union all select k, 9, c_name, 430, 150+k%90 from b
 union all select k, 10, case when k%2=0 then 'Alliance' else 'Allianz' end, 560, 140 from b
 union all select k, 11, 'Civilization', 880, 270 from b)
select k page_id, ord, txt, (50+(k*37+ord*11)%50)/100 conf, x x0, y y0, x+80 x2, y+20 y2 from t
"""

# one page per ten orders; the figures come from all of them, and the names from all parts, dealt out in turn
REPORT = """
with o as (select cast(floor(o_orderkey/10) as bigint)*10 k, cast(floor(o_orderkey/10) as bigint) j,
             cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) price from orders group by 1, 2),
s as (select k, j, side, 1000+(price+j*(7+side))%9000 tot, (j+side)%30 heal, j%50 tow from o {SIDES}),
c as (select *, cast(floor(tot/10) as bigint) dead, cast(floor(tot/5) as bigint) sev, cast(floor(tot/4) as bigint) sli from s),
m as (select k, j, side, m, lab, case m when 1 then tot when 2 then heal when 3 then dead when 4 then sev when 5 then sli when 6 then tow
        when 7 then tot+heal-dead-sev-sli-tow + case when j%4=0 then 7 when j%4=1 then 1 else 0 end else tot*2 end v
      from c {METRICS}),
t as (select k, j, 10+side*100+m*2 ord, lab txt, 100+side*500 x, 400+m*50 y from m
 union all select k, j, 11+side*100+m*2, case when v >= 1000 then cast(cast(floor(v/1000) as bigint) as string) || ',' || lpad(cast(v%1000 as string),3,'0')
        else cast(v as string) end, 300+side*500, 400+m*50+(k%3) from m
 union all select k, j, 1+side, case when j%9=4 and side=0 then 'Wolf Player' || cast(j%97 as string) when j%5=3 then '[T' || cast(j%90+10 as string) || ']'
        else '[T' || cast(j%90+10 as string) || ']Player' || cast(j*(side+3)%1000 as string) end, 240+side*350, 120 from s
 union all select k, j, 3, case when j%2=0 then 'Victory' else 'Defeat' end, 450, 300 from o
 union all select k, j, 4, '2024/0' || cast(j%9+1 as string) || '/1' || cast(j%10 as string), 100, 50 from o
 union all select k, j, 5, 'X: ' || cast(j%1200 as string) || ' Y: ' || cast((j*3)%1200 as string), 300, 50 from o
 union all select k, j, 6+side, case when j%6=5 then 'Lv. ' || cast(j%60+1 as string) else 'Lv. ' || cast(j%60+1 as string) || ' ' || p_name end, 150+side*500, 200
        from s join part on p_partkey = (j*2+side)%(select count(*) from part)
 union all select k, j, 8, case when j%7=0 then 'Lv. ' || cast(j%40 as string) || ' Barbarian' else 'Rival' end, 620, 150 from o
 union all select k, j, 9, '-' || cast(j%90 as string) || ',' || cast(j%10 as string) || '%', 700, 250 from o
 union all select k, j, 200+side, p_name, 250+side*500, 201 from s join part on p_partkey = (j*2+side)%(select count(*) from part)
 union all select k, j, 202, 'Sort by Category', 20, 960 from o)
select k page_id, ord, txt, (50+(j*37+ord*11)%50)/100 conf, x x0, y y0, x+90 x2, y+20 y2, j%3 <> 0 isolated from t
"""

# repeated reads of one item in one session, ordered
READS = """
select user_id session_id, event_type item_id, event_id seq, cast(floor(value) as bigint) qty,
       cast((event_id*37)%50+50 as double) conf, 1+user_id%7 unit_value, cast(ts as timestamp) arrived from events
"""

_GRID_SOURCE = """
g as (select l_orderkey-l_orderkey%10 k, row_number() over (partition by l_orderkey-l_orderkey%10
             order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag) r,
           l_partkey p, cast(l_quantity as int) q, l_returnflag f from lineitem)
"""

# a page per ten orders: icons (even r) and numbers (odd r) in three columns
GRID = f"""
with {_GRID_SOURCE}
select k page_id, cast(r as int) ord,
       case when r%2=0 then cast(case p%4 when 0 then 100 when 1 then 500 when 2 then 1000 else 5000 end as string)
            when p%6=0 then '1092' when p%13=0 then 'n/a' else cast(q as string) end txt,
       case f when 'A' then 'Blue' when 'N' then 'Purple' else 'Gold' end color,
       (50+(k*37+r*11)%50)/100 conf, (r%3)*30 x0, cast(floor(r/3) as int)*30+(r%2)*25 y0, (r%3)*30+24 x2,
       cast(floor(r/3) as int)*30+(r%2)*25+16+p%9 y2,
       cast(floor(k/50) as bigint) session_id, cast((k%50)/10 as int)+1 page_seq from g
"""

# two rescans per grid block
RESCAN = f"""
with {_GRID_SOURCE}
select k page_id, cast(r as int) ord, shot, k*100+r region_id, case when shot=1 then 'wide' else 'right' end strategy,
       case when p%11=0 then 'l0' when p%7=0 then cast(200+q as string) else cast(q+(shot*(p%3)) as string) end txt,
       ((p*13+shot*29)%100)/100 conf
from g {{SHOTS}}
"""

# crops of profile pages, at twice the size: what each strategy read, by round and field
HUNTS = [(1, "Civilization", 1, 1), (1, "Civilization", 2, 1), (2, "Civilization", 1, 1), (1, "Name", 1, 1), (1, "Name", 1, 2),
         (2, "Name", 1, 1), (1, "Power", 1, 1), (2, "Power", 2, 1)]
HUNT = """
select c_custkey page_id, round, field, shot, line,
       case when field='Civilization' then case when round=2 then 'gChina' when shot=1 then 'Ch' when c_custkey%3=0 then 'Germany' when c_custkey%3=1 then 'Nothing here' else ' . ' end
            when field='Name' then case when line=2 then 'x' when c_custkey%5=0 then ' ' else 'Late Player ' || cast(c_custkey%1000+round as string) end
            else cast(5000+c_custkey*round as string) end txt,
       (60+(c_custkey*7+round*3)%40)/100 conf, case field when 'Civilization' then 80 when 'Name' then 360 else 40 end x0, case field when 'Civilization' then 120 else 20*line end y0,
       case field when 'Civilization' then 240 when 'Name' then 520 else 200 end x2, case field when 'Civilization' then 160 else 20*line+40 end y2,
       case field when 'Civilization' then 860 when 'Name' then 250 else 400 end origin_x, case field when 'Civilization' then 250 when 'Name' then 120 else 320 end origin_y, 2 scale
from customer {HUNTS}
"""

VOTES = """
select l_orderkey page_id, case l_partkey%6 when 0 then 'Red' when 1 then 'Gold' when 2 then 'Green' when 3 then 'Blue' when 4 then 'Purple' else 'None' end color,
       cast(sum(cast(l_quantity as int)) as bigint) cnt from lineitem group by 1, 2
"""

# noisy mentions of part names; the dictionary is the distinct names in order of first key
MENTIONS = """
select p_partkey mention_id, case when p_partkey%3=0 then replace(p_name,'o','0') when p_partkey%3=1 then upper(p_name)
       else substr(p_name,2,length(p_name)) || ' x' end mention from part
"""
DICTIONARY = "select p_name label, min(p_partkey) label_ord from part group by p_name"

# item lists: a page per customer, five pages per session, four titled items and a bar
TITLED = """
with c as (select c_custkey k, c_custkey%300 sess, cast(floor(c_custkey/300) as bigint)+1 seq from customer),
i as (select k, sess, seq, i, title, unit_value from c {TITLES}),
t as (select k, sess, seq, 1 ord, cast(sess%900+(k%4)*(seq%2) as string) || ' / 1,000' txt, 300 x, 10 y, 100 w from c
 union all select k, sess, seq, i*2, case when (k+i)%5=0 then replace(title,'e','c') else title end, 100, 100+i*120, 300 from i
 union all select k, sess, seq, i*2+1, case when (k+i)%7=0 then 'Total ' else 'Owned: ' end || case when (k*i)%3=0 then '1,' || lpad(cast((sess*7+seq)%1000 as string),3,'0')
        else cast((sess*i+seq*(k%2))%900 as string) end, 120, 150+i*120+(k%3)*25, 200 from i)
select sess session_id, seq page_seq, k page_id, ord, txt, (50+(k*37+ord*11)%50)/100 conf, x x0, y y0, x+w x2, y+20 y2 from t
"""

PIXELS = """
select l_orderkey page_id, cast(l_partkey%180 as int) h, cast((l_partkey*7+l_suppkey*3)%256 as int) s,
       cast((l_partkey*11+l_linenumber*17)%256 as int) v, cast(l_quantity as int) cnt from lineitem
"""

TEXT_SPARK = r"""
select doc_id page_id, cast(pos as int) ord, col txt from (select doc_id, posexplode(split(text, '\\n')) from documents)
"""
TEXT_DUCK = """
select doc_id page_id, cast(unnest(range(len(a))) as int) ord, unnest(a) txt from (select doc_id, string_split(text, chr(10)) a from documents)
"""

VIEWS = {"profile": PROFILE, "report": REPORT, "reads": READS, "grid": GRID, "rescan": RESCAN, "hunt": HUNT, "votes": VOTES,
         "mentions": MENTIONS, "dictionary": DICTIONARY, "titled": TITLED, "pixels": PIXELS}


def sql(name: str, dialect: str) -> str:
    """The text of a view for "spark" or "duckdb"."""
    if name == "text":
        return TEXT_SPARK if dialect == "spark" else TEXT_DUCK
    text = VIEWS[name]
    for mark, args in (("{SIDES}", ("v", ["side"], [(0,), (1,)])),
                       ("{METRICS}", ("l", ["m", "lab"], METRICS)),
                       ("{TITLES}", ("w", ["i", "title", "unit_value"], TITLES)),
                       ("{HUNTS}", ("v", ["round", "field", "shot", "line"], HUNTS)),
                       ("{SHOTS}", ("v", ["shot"], [(1,), (2,)]))):
        text = text.replace(mark, _rows(dialect, *args))
    return text


#: What several views read and is costly: written once, as views do themselves.
SHARED = {"grid_source": _GRID_SOURCE}

_STAGED: dict[tuple[str, int, str, str], DataFrame] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, or a derived view that is written once per session and read back as a table."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = (spark.sparkContext.applicationId, cleared(spark), sf_dir, name)
    if key not in _STAGED:
        text = f"with {SHARED[name]} select * from g" if name in SHARED else sql(name, "spark")
        for shared, source in SHARED.items():
            if name != shared and source in text:
                load(spark, sf_dir, shared).createOrReplaceTempView(shared)
                text = text.replace(source, f"g as (select * from {shared})")
        for table in TABLES:
            if table in text:
                spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        _STAGED[key] = stage(spark.sql(text), FILE_ROWS)
    return _STAGED[key]


def blocks(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view with the top-right corner every detection has (these boxes are upright)."""
    from pyspark.sql import functions as F
    df = load(spark, sf_dir, name)
    return df.select("*", F.col("x2").alias("x1"), F.col("y0").alias("y1"))
