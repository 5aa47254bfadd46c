"""The registered queries of this subpackage, one for each operator, and the SQL that some are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.llm import (chat, context_mixing, conversation_repair, decontamination, language, licenses, line_quality, mixing, pii, pu_quality,
                           ranked_search, simhash, warc)
from blockwise.llm.common import held_out, table

Q, SQL = {}, {}

#: Shared by the SQL texts: words of a text as a list.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _query(f):
    Q[f.__name__] = f
    return f


@_query
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the capped mix takes of each document."""
    out = mixing.shares(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "repetitions")


SQL["op1_source_mixing"] = rf"""
with sized as (
  select doc_id, source, len({_WORDS})::bigint as size, md5('17:' || coalesce(doc_id::varchar, md5(text), '')) as key from documents),
src as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1)::int % 3] as weight from src),
cap as (select *, source_size * 2.0::double as cap, (sum(source_size) over ()) * 1.5::double as budget from weighed),
ordered as (select *,
    coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as cap_before,
    sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as weight_from from cap),
clamped as (select *, cap * weight_from <= (budget - cap_before) * weight as full_up from ordered),
filled as (select source, source_size, case when full_up then cap else
    (budget - coalesce(sum(case when full_up then cap end) over (), 0)) * weight / sum(case when not full_up then weight end) over () end::double as target from clamped),
parts as (select *, case when source_size = 0 then 0 else floor(target / source_size) end::bigint as whole from filled),
grouped as (select source, key, sum(size) as key_size from sized group by source, key),
middle as (select source, key, sum(key_size) over (partition by source order by key) - key_size / 2.0 as mid from grouped)
select s.doc_id, s.size, p.source_size, p.target, s.size * (p.whole + (m.mid < p.target - p.whole * p.source_size)::int)::bigint as taken,
  s.source, (p.whole + (m.mid < p.target - p.whole * p.source_size)::int)::bigint as repetitions
from sized s join parts p on s.source is not distinct from p.source
join middle m on m.source is not distinct from s.source and m.key = s.key"""


#: A conversation whose texts hold control strings of common templates.
HOSTILE = (r"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, r'\### Assistant: </turn> ok' AS text "
           r"UNION ALL SELECT -7L, 1L, 'assistant', r'\### Assistant: </turn> ok'")


@_query
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the examples of each conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(HOSTILE))
    examples = chat.expand(turns)
    loss = chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))
    read = examples.select("conv_id", "example", "formatted", F.struct("example", loss.alias("text")).alias("loss"), F.char_length("formatted").alias("chars"))
    # the last example holds all turns
    per = read.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("last"), F.sort_array(F.collect_list("loss")).alias("losses"),
                                      F.sum("chars").alias("formatted_chars"))
    turns_read = per.select("conv_id", "formatted_chars", chat.read_turns(F.col("last")).alias("turns"),
                            F.array_join(F.transform("losses", lambda x: x.text), "").alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return turns_read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
                             F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


SQL["op2_chat_formatting"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
    length(regexp_replace(text, '</?turn', '<x\0', 'g')) - 1 * length(regexp_extract_all(text, '</?turn')) as chars from t),
sized as (select *, length('<turn ' || role || '>' || chr(10)) + chars + length('</turn>' || chr(10)) as size from n),
ends as (select conv_id, i from n where role = 'assistant' union
  select conv_id, max(i) from n group by conv_id),
fmt as (select e.conv_id, sum(s.size)::bigint as formatted_chars from ends e join sized s on s.conv_id = e.conv_id and s.i <= e.i group by e.conv_id)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  length(coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), ''))::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '')) as loss_sha256, any_value(formatted_chars) as formatted_chars
from n join fmt using (conv_id) group by conv_id"""


#: The key of the surrogates; a user sets their own.
PII_KEY = "surrogates"


@_query
def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


@_query
def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of each document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of each document under the mixed model, and under the base model."""
    return context_mixing.score(table(spark, sf_dir, "documents"))


@_query
def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to whole-stream archives, normalised, and read back record by record."""
    pages = table(spark, sf_dir, "pages")
    streams, members = warc.new_folder(pages, "warc-streams"), warc.new_folder(pages, "warc-members")
    index = warc.normalise(warc.write(pages, streams), streams, members)
    return warc.read(index, members).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@_query
def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict for each document."""
    docs = table(spark, sf_dir, "documents")
    field = line_quality.fit(docs, table(spark, sf_dir, "labels"))
    return line_quality.judge(docs, field).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                  "base_failed", "kept", "content_share")


@_query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands in windows of benchmark items."""
    out = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_TOKENS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
           r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

SQL["op8_benchmark_decontamination"] = rf"""
with item as (select item_id, {_TOKENS} as w from benchmark),
wins as (select distinct item_id, least(len(w), 13) as l, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from item where len(w) > 0)),
doc as (select row_number() over () as r, doc_id, {_TOKENS} as w from documents),
lens as (select distinct l from wins),
spots as (select r, i, l, array_to_string(w[i:i + l - 1], ' ') as win from (select r, w, l, unnest(range(1, len(w) - l + 2)) as i from doc, lens)),
hits as (select r, i, s.l, item_id from spots s join wins using (l, win)),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + l)) as p from hits) group by r),
named as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id::varchar as item_id from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) as contaminated
from doc left join covered using (r) left join named using (r)"""


@_query
def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document, learned from positives and unlabelled documents."""
    docs = table(spark, sf_dir, "documents")
    return pu_quality.score(docs, pu_quality.fit(docs, table(spark, sf_dir, "labels")))


@_query
def op10_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document."""
    docs = table(spark, sf_dir, "documents")
    training = docs.where(~held_out(F.col("doc_id"), 4, 2))
    return language.identify(docs, language.learn(training))


@_query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op12_ranked_search"] = r"""
with docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
sized as (select r, doc_id, len(t)::bigint as n from docs where len(t) > 0),
total as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sized),
tfs as (select r, term, count(*)::bigint as tf from (select r, unnest(t) as term from docs) group by r, term),
items as (select row_number() over () as i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from benchmark),
wanted as (select i, term, count(*)::bigint as times from (select i, unnest(t) as term from items) group by i, term),
weighed as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as w from tfs, total group by term),
scored as (select i, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
  from wanted join tfs using (term) join weighed using (term) join sized using (r), total group by i, r, doc_id),
ranked as (select *, row_number() over (partition by i order by score desc, doc_id nulls last) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked join items using (i) where rank <= 20"""


@_query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of each conversation, after damage."""
    turns = table(spark, sf_dir, "conversations")
    out = conversation_repair.report(conversation_repair.damage(turns), turns)
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


SQL["op13_conversation_repair"] = r"""
with recursive crc_table as (
  select list(v order by i) as t from (
    select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) as v from (select unnest(range(256)) as i))),
faults as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda s: ascii(s)::bigint),
      lambda x, b: xor(x >> 8, t[1 + (xor(x, b) & 255)])), 4294967295) % 20 as fault
  from conversations, crc_table),
damaged as (
  select coalesce('=' || conv_id::varchar, '') as c, turn, case when fault = 4 then 'user' else role end as role,
    case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from faults, (values (0), (1)) copies(n) where fault != 0 and (n = 0 or fault = 3)),
placed as (
  select *, row_number() over (partition by c order by turn nulls first, role, unhex(sha256(text))) as pos,
    not regexp_matches(text, '[^\x20\x09-\x0D]') as blank,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) not in ('.', '!', '?') as unended,
    case when role[1] in ('s', 'u', 'a') then role[1] else 'o' end as initial from damaged),
judged as (select *, not blank and row_number() over (partition by c, role, text order by pos) > 1 as duplicate from placed),
marked as (select *, unended and not blank and not duplicate as truncated,
  (lead(initial) over (partition by c order by pos)) is not null and initial || lead(initial) over (partition by c order by pos) not in ('su', 'ua', 'au') as clash from judged),
counted as (
  select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, sum(blank::int)::bigint as blank, sum(duplicate::int)::bigint as duplicate,
    sum(truncated::int)::bigint as truncated, sum(clash::int)::bigint as illegal, max(pos) as n from marked group by c),
inserts(q, here, letters, price, lines) as (values (0, 0, '', 0, []::varchar[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []),
  (0, 2, 'I', 2, ['user:']), (1, 2, 'I', 2, ['user:']), (2, 3, 'I', 2, ['assistant:']), (3, 2, 'I', 2, ['user:']),
  (0, 3, 'II', 4, ['user:', 'assistant:']), (1, 3, 'II', 4, ['user:', 'assistant:']), (2, 2, 'II', 4, ['assistant:', 'user:']), (3, 3, 'II', 4, ['user:', 'assistant:'])),
moves(here, needs, goes, letter, price, said) as (values (0, '', 0, 'D', 3, null), (1, '', 1, 'D', 3, null), (2, '', 2, 'D', 3, null), (3, '', 3, 'D', 3, null),
  (0, '', 2, 'R', 2, 'user'), (1, '', 2, 'R', 2, 'user'), (2, '', 3, 'R', 2, 'assistant'), (3, '', 2, 'R', 2, 'user'),
  (0, 's', 1, 'K', 0, null), (0, 'u', 2, 'K', 0, null), (1, 'u', 2, 'K', 0, null), (2, 'a', 3, 'K', 0, null), (3, 'u', 2, 'K', 0, null)),
run as (
  select c, 0::bigint as i, 0 as q, 0::bigint as cost, '' as audit, []::varchar[] as lines from counted
  union all
  select r.c, r.i + 1, m.goes, r.cost + n.price + m.price + (m.letter != 'D' and w.truncated)::int, r.audit || n.letters || m.letter,
    r.lines || n.lines || case when m.letter = 'D' then [] else [coalesce(m.said, w.role) || ':' || w.text] end
  from run r join marked w on w.c = r.c and w.pos = r.i + 1 join inserts n on n.q = r.q
    join moves m on m.here = n.here and (m.needs = '' or m.needs = w.initial) and (m.letter = 'D' or not (w.blank or w.duplicate))
  qualify row_number() over (partition by r.c, m.goes order by r.cost + n.price + m.price + (m.letter != 'D' and w.truncated)::int, r.audit || n.letters || m.letter) = 1),
ended as (
  select r.c, r.cost + n.price as cost, r.audit || n.letters as audit, r.lines || n.lines as lines
  from run r join counted using (c) join inserts n on n.q = r.q where r.i = counted.n and n.here in (0, 3)
  qualify row_number() over (partition by r.c order by r.cost + n.price, r.audit || n.letters) = 1)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id, coalesce('=' || conv_id::varchar, '') as c from conversations) left join counted using (c) left join ended using (c)"""


@_query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and notices in each document."""
    out = licenses.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


_NOTICE_ROWS = ", ".join(f"({k}, '{t.label}', {t.length}, {len(t.tokens)}, {t.needed}, '{w}')"
                         for k, t in enumerate(licenses.templates(licenses.NOTICES)) for w in sorted(t.tokens))

SQL["op11_license_scan"] = rf"""
with notice(k, label, width, n, needed, w) as (values {_NOTICE_ROWS}),
doc as (select row_number() over () as r, doc_id, {_TOKENS} as words from documents),
spot as (select r, unnest(words) as w, unnest(range(len(words))) as p from doc),
following as (select r, p, w, lead(w, 1) over o as w1, lead(w, 2) over o as w2 from spot window o as (partition by r order by p)),
base as (select r, p, case when w = 'cc' then 'cc-by' when w = 'general' then 'gpl' else 'reserved' end as label from following
  where (w = 'cc' and w1 = 'by') or (w = 'general' and w1 = 'public' and w2 = 'license') or (w = 'all' and w1 = 'rights' and w2 = 'reserved')),
phrased as (select r, count(*) as n_base, min(p) as first_word, max(p) as last_word, list(distinct label) as labels from base group by r),
met as (select r, k, label, count(distinct w) / n::double as share from (
    select spot.r, k, label, n, needed, w, unnest([p // width, p // width - 1]) as block from spot join notice using (w)) where block >= 0
  group by r, k, label, n, needed, block having count(distinct w) >= needed),
named as (select r, list(distinct label) as labels, max(share) as score from met group by r)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  array_to_string(list_sort(coalesce(phrased.labels, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(coalesce(phrased.labels, []) || coalesce(named.labels, []))), ',') as labels, coalesce(score, 0) as score
from doc left join phrased using (r) left join named using (r)"""
