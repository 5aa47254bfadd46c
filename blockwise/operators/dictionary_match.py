"""Fuzzy joins against dictionaries of any size.

Candidates come from equality of keys, never from comparing every text with every label, and every pair that shares no key is
provably too far.  A pair whose longer string has M letters may need k(M) edits:

* Up to ``SHORT`` letters, both strings keep a common subsequence of M - k letters, so each is keyed by all its subsequences of
  that length: whole words but for k letters.
* Beyond, the longer string is cut into k + 1 segments, of which the shorter has one unchanged, at most k places off.  Where the
  segments of a label stay long enough one more is cut, two are unchanged, and the one that most labels share is left out as a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwise.functions.text import edit_budget, entity_score, normalize_accents, similarity, sorted_tokens

_EPS = 1e-9
#: Letters of the longer string up to which subsequences are the keys.
SHORT = 7
#: Letters that a segment keeps where one more is cut than needed.
SPARE = 4
#: Letters of the keys that containment is searched by.
GRAM = 4
_KEYS = "array<struct<side:int,len:int,part:int,seg:string>>"


# The keys are SQL text: an expression of this size is sent to the JVM at once instead of node by node.

def _edits(longest: str, threshold: float, strict: bool) -> str:
    """Edits that a pair whose longer string has so many letters may need."""
    most = f"floor({longest} * {1.0 - threshold!r}D + {_EPS!r}D)"
    return f"cast({f'if(1D - {most} / {longest} > {threshold!r}D, {most}, {most} - 1)' if strict else most} as int)"


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _key(side: int, length: str, part: str, seg: str) -> str:
    return f"named_struct('side', {side}, 'len', {length}, 'part', {part}, 'seg', {seg})"


def _short_keys(text: str, threshold: float, strict: bool) -> str:
    """array<struct<side, len, part, seg>> for the pairs whose longer string has ``len`` letters, up to ``SHORT``."""
    budget = {m: edit_budget(m, m, threshold, strict) for m in range(1, SHORT + 1)}
    if not strict:
        budget = {m: max(k, int(m * (1.0 - threshold) + _EPS)) for m, k in budget.items()}
    longest = ", ".join(f"named_struct('len', {m}, 'kept', {m - k})" for m, k in budget.items())
    out = f"""flatten(transform(filter(array({longest}), x -> length({text}) between x.kept and x.len),
      x -> transform(levels[length({text}) - x.kept], seg -> {_key(2, 'x.len', '0', 'seg')})))"""
    # one letter less at each level
    less = "array_distinct(flatten(transform(element_at(levels, -1), s -> transform(sequence(1, length(s)), i -> concat(substring(s, 1, i - 1), substring(s, i + 1))))))"
    levels = f"array(array({text}))"
    for _ in range(max(budget.values())):
        levels = _let(levels, "levels", f"concat(levels, array({less}))")
    return f"if(length({text}) <= {SHORT}, {_let(levels, 'levels', out)}, cast(array() as {_KEYS}))"


def _parts(longest: str, k: str, spare: bool) -> str:
    """Segments that a string is cut into."""
    return f"if(floor({longest} / ({k} + 2)) >= {SPARE}, {k} + 2, {k} + 1)" if spare else f"({k} + 1)"


def _plan(longest: str, threshold: float, strict: bool, spare: bool, body: str) -> str:
    """``body`` over x: the length, edits and segments of a pair's longer string."""
    edits = f"named_struct('len', {longest}, 'k', {_edits(longest, threshold, strict)})"
    return _let(_let(edits, "y", f"named_struct('len', y.len, 'k', y.k, 'parts', {_parts('y.len', 'y.k', spare)})"), "x", body)


_EDGES = "named_struct('b', cast(floor(i * x.len / x.parts) as int), 'w', cast(floor((i + 1) * x.len / x.parts) as int) - cast(floor(i * x.len / x.parts) as int))"


def _segment_keys(text: str, threshold: float, strict: bool, spare: bool) -> str:
    """Keys of a pair's longer string, its segments; none if no string of the other side (``others`` are their sizes) can fit."""
    seg = _let(_EDGES, "e", f"substring({text}, e.b + 1, e.w)")
    cut = f"""if(exists(others, n -> n between x.len - x.k and x.len - {int(not spare)}),
      transform(sequence(0, x.parts - 1), i -> {_key(int(spare), 'x.len', 'i', seg)}), array())"""
    return f"if(length({text}) > {SHORT}, {_plan(f'length({text})', threshold, strict, spare, cut)}, cast(array() as {_KEYS}))"


def _place_keys(text: str, threshold: float, strict: bool, spare: bool) -> str:
    """Keys of the shorter string: what stands where a segment of a longer one, of any size among ``others``, may have come to."""
    first, last = "greatest(0, e.b - z.lost - z.slack)", f"least(length({text}) - e.w, e.b + z.slack)"
    places = _let(_EDGES, "e", f"if({last} >= {first}, transform(sequence({first}, {last}), p -> substring({text}, p + 1, e.w)), array())")
    # a segment met at two places is rare; telling structs apart costs more than a repeated key
    each = f"flatten(transform(sequence(0, x.parts - 1), i -> transform({places}, seg -> {_key(int(spare), 'x.len', 'i', 'seg')})))"
    shift = f"named_struct('lost', x.len - length({text}), 'slack', cast(floor((x.k - x.len + length({text})) / 2) as int))"
    fitting = f"filter(others, n -> n > {SHORT} and n >= length({text}) + {int(not spare)} and length({text}) >= n - {_edits('n', threshold, strict)})"
    return f"flatten(transform({fitting}, n -> {_plan('n', threshold, strict, spare, _let(shift, 'z', each))}))"


def _rare_keys(cut: DataFrame, by: Sequence[str]) -> DataFrame:
    """The segments of labels without the one of each that most labels have, where one may be missing."""
    key = [*by, "len", "part", "seg"]
    met = cut.groupBy(*key).agg(F.count("*").alias("_met"))
    most = F.max(F.struct("_met", -F.col("part"))).over(Window.partitionBy(*by, "label"))
    ranked = cut.join(met, key).withColumn("_most", most)
    return ranked.where(~F.col("spare") | (F.col("_most") != F.struct("_met", -F.col("part")))).select(*by, "label", "side", "len", "part", "seg")


def _similar_pairs(texts: DataFrame, labels: DataFrame, threshold: float, within: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """(*within, text, label) pairs that share a key; both sides hold distinct lower-case values."""
    by = list(within)
    texts, labels = (df.select(*by, c).where(F.length(c) > 0) for df, c in ((texts, "text"), (labels, "label")))
    # the sizes that occur: a long text that no label fits has no keys
    sizes = [df.groupBy(*by).agg(F.collect_set(F.length(c)).alias("others")) for df, c in ((labels, "label"), (texts, "text"))]
    texts, labels = (df.join(n, by) if by else df.join(F.broadcast(n)) for df, n in zip((texts, labels), sizes))
    how = (threshold, strict)
    left = F.expr(f"concat({_short_keys('text', *how)}, {_place_keys('text', *how, True)}, {_segment_keys('text', *how, False)})")
    right = F.expr(f"concat({_short_keys('label', *how)}, {_place_keys('label', *how, False)})")
    spare = F.expr(_let(_edits("length(label)", *how), "k", f"{_parts('length(label)', 'k', True)} > k + 1"))
    cut = _rare_keys(labels.select(*by, "label", spare.alias("spare"), F.inline(F.expr(_segment_keys("label", *how, True)))), by)
    keyed = labels.select(*by, "label", F.inline(right)).unionByName(cut)
    return texts.select(*by, "text", F.inline(left)).join(keyed, [*by, "side", "len", "part", "seg"]).select(*by, "text", "label").distinct()


def _containing_pairs(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label) pairs where the label occurs in the text, met by the label's piece that the fewest texts have."""
    def pieces(t: Column, sizes: Column) -> Column:
        def of_size(q: Column) -> Column:
            grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - q + 1), lambda p: F.substr(t, p, q)))
            return F.transform(grams, lambda gram: F.struct(q.alias("q"), gram.alias("gram")))
        return F.flatten(F.transform(sizes, of_size))
    some = labels.filter(F.length("label") > 0)
    # texts give pieces only of the sizes that a label needs
    sizes = some.select(F.least(F.lit(GRAM), F.length("label")).alias("q")).distinct()
    sized = texts.filter(F.length("text") > 0).join(F.broadcast(sizes.agg(F.array_sort(F.collect_list("q")).alias("sizes"))))
    fit = F.filter("sizes", lambda q: q <= F.length("text"))
    left = sized.select("text", F.inline(pieces(F.col("text"), fit)))
    met = left.groupBy("q", "gram").agg(F.count("*").alias("n"))
    own = some.select("label", F.inline(pieces(F.col("label"), F.array(F.least(F.lit(GRAM), F.length("label"))))))
    # a piece that no text has rules the label out
    rare = (own.join(met, ["q", "gram"], "left").groupBy("label", "q")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("b")).select("label", "q", "b.gram"))
    pairs = left.join(rare, ["q", "gram"]).select("text", "label")
    return pairs.filter(F.contains("text", "label")).distinct()


def fuzzy_dictionary_join(mentions: DataFrame, dictionary: DataFrame, threshold: float,
                          contains: bool = False, text: str = "mention", label: str = "label") -> DataFrame:
    """Mentions joined to every label they resemble (similarity above the threshold) or, on request, contain.

    Works on the distinct texts and joins the answers back, so copies of a text cost nothing.
    """
    texts = mentions.select(F.lower(text).alias("text")).distinct()
    labels = dictionary.select(F.lower(label).alias("label")).distinct()
    pairs = _similar_pairs(texts, labels, threshold).filter(similarity(F.col("text"), F.col("label")) > threshold)
    if contains:
        pairs = pairs.unionByName(_containing_pairs(texts, labels)).distinct()
    pairs = pairs.select(F.col("text").alias("_text"), F.col("label").alias("_label"))
    return (mentions.join(pairs, F.lower(F.col(text)) == F.col("_text"))
            .join(dictionary, F.lower(dictionary[label]) == F.col("_label")).drop("_text", "_label"))


def entity_resolution_topk(mentions: DataFrame, dictionary: DataFrame, text: str = "mention",
                           accept: float = 83.0, within: Sequence[str] = ()) -> DataFrame:
    """Mentions with their best entity: the highest score of at least ``accept``, dictionary order on ties.

    ``dictionary`` has entry_id, entry_ord, label, label_ord, and the ``within`` columns if several
    dictionaries are searched at once.  A label owned by two entries belongs to the first.  Only scores that
    can be accepted are generated, so ranking three and taking the first acceptable one comes to taking the best.
    """
    by, threshold = list(within), accept / 100.0
    owned = (dictionary.select(*by, normalize_accents(F.col("label")).alias("label"), "entry_id", "entry_ord", "label_ord")
             .groupBy(*by, "label").agg(F.min(F.struct("entry_ord", "label_ord", "entry_id")).alias("owner"))
             .withColumn("key", sorted_tokens(F.col("label"))))
    texts = (mentions.select(*by, normalize_accents(F.col(text)).alias("text")).distinct().filter(F.trim("text") != "")
             .withColumn("key", sorted_tokens(F.col("text"))))
    # each text and label is searched as written and with its words in order
    forms_t = texts.select(*by, F.col("text").alias("whole"), F.explode(F.array_distinct(F.array("text", "key"))).alias("text"))
    forms_l = owned.select(*by, F.explode(F.array_distinct(F.array("label", "key"))).alias("label")).distinct()
    pairs = _similar_pairs(forms_t.select(*by, "text").distinct(), forms_l, threshold, by, strict=False)
    owners = owned.select(*by, F.col("label").alias("owned_label"), "owner", F.explode(F.array_distinct(F.array("label", "key"))).alias("label"))
    scored = (pairs.join(forms_t, [*by, "text"]).join(owners, [*by, "label"])
              .select(*by, "whole", "owned_label", "owner", entity_score(F.col("whole"), F.col("owned_label")).alias("score"))
              .filter(F.col("score") >= accept))
    best = scored.groupBy(*by, "whole").agg(F.min(F.struct(
        (-F.col("score")).alias("s"), F.col("owner.entry_ord"), F.col("owner.label_ord"),
        F.col("owner.entry_id"), F.col("owned_label").alias("label"))).alias("b"))
    answers = best.select(*by, F.col("whole").alias("_text"), F.col("b.entry_id").alias("entry_id"),
                          F.col("b.label").alias("label"), (-F.col("b.s")).alias("score"))
    keyed = mentions.withColumn("_text", normalize_accents(F.col(text)))
    return keyed.join(answers, [*by, "_text"]).drop("_text")
