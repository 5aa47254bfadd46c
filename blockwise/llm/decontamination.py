"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Every run of ``n`` words of a benchmark item is a window; an item with fewer words is one window.  Documents are scanned
once: the hash of the first words of each position is looked up in the broadcast set, and the few positions found are
verified against the window's words.  Words inside any occurrence are hit.

Native expressions only.  Defined results: null and empty texts have no words; repeated items and repeated documents
each count for themselves; without items nothing is hit; extra columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.functions.literals import let
from blockwise.llm.common import lower_ascii, small, text_key
from blockwise.session import stage

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window that the hash set holds; the rest is verified.
ANCHOR = 4
#: Windows that are broadcast at most; more are joined by shuffle.
MAX_WINDOWS = 1_000_000
ADDED = ("n_words", "n_hit", "n_items", "item_ids", "contaminated", "hit_positions")


def words_of(text: Column) -> Column:
    """Lower-case words; null has none."""
    return F.filter(F.split(F.coalesce(lower_ascii(text), F.lit("")), SEPARATORS), lambda w: w != "")


def windows(items: DataFrame, n: int = 13) -> DataFrame:
    """(item_id, length, window words joined by space, anchor length and hash) for each window of each item."""
    words = items.select(F.col("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(n))
    starts = words.select("item_id", "words", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("at"))
    window = F.slice("words", F.col("at"), F.col("length"))
    return starts.select("item_id", "length", F.array_join(window, " ").alias("window"), F.least("length", F.lit(ANCHOR)).alias("anchor"),
                         F.xxhash64(F.array_join(F.slice(window, 1, ANCHOR), " ")).alias("anchor_hash"))


def _anchors(length: int) -> Column:
    """Hash of the ``length`` words from each position on; positions too near the end have null words, which hash differently."""
    def at(x: Column, i: Column) -> Column:
        return F.xxhash64(F.concat_ws(" ", x, *(F.get("words", i + k) for k in range(1, length))))
    return F.transform("words", at)


def occurrences(docs: DataFrame, items: DataFrame, n: int = 13) -> tuple[DataFrame, DataFrame]:
    """(sizes, hits): sizes has (doc_id, key, n_words) for each document; hits (doc_id, key, at, length, item_id), verified."""
    found = stage(windows(items, n))
    lengths = [r.anchor for r in found.select("anchor").distinct().collect()]  # ANCHOR values at most
    rows = found.count()
    ids = found.groupBy("anchor", "anchor_hash", "length", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    ids = F.broadcast(ids) if rows <= MAX_WINDOWS else ids
    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    words = texts.select("doc_id", "key", words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    scans = []
    for i, anchor in enumerate(sorted(lengths) or [ANCHOR]):
        # a null in front, which matches nothing, keeps one row (at -1) of each document; outer, because a plain explode
        # would evaluate the array a second time to drop empty ones
        hashes = F.concat(F.array(F.lit(None).cast("long")), _anchors(anchor))
        scan = words.select("doc_id", "key", "n_words", F.posexplode_outer(hashes).alias("place", "hash"))
        scan = scan.join(ids.where(F.col("anchor") == anchor).drop("anchor"), F.col("hash") == F.col("anchor_hash"), "left")
        scan = scan.where(F.col("window").isNotNull() | ((F.col("place") == 0) & F.lit(i == 0)))
        scans.append(scan.select("doc_id", "key", "n_words", (F.col("place") - 1).alias("at"), "length", "window", "items"))
    scanned = scans[0]
    for more in scans[1:]:
        scanned = scanned.unionByName(more)
    scanned = stage(scanned)
    sizes = scanned.where("at = -1").select("doc_id", "key", "n_words")
    candidates = scanned.where(F.col("window").isNotNull()).groupBy("doc_id", "key").agg(
        F.collect_set(F.struct("at", "length", "window", "items")).alias("candidates"))
    candidates = small(candidates.withColumnsRenamed({"doc_id": "_doc", "key": "_key"}), 20_000)
    texts = texts.join(candidates, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    # the words are bound to a name: inside the filter they would be split off anew for each candidate
    same = let(words_of(F.col("text")), lambda words: F.filter(
        "candidates", lambda c: F.array_join(F.slice(words, c.at + 1, c.length), " ") == c.window))
    hits = texts.select("doc_id", "key", F.explode(same).alias("c"))
    return sizes, hits.select("doc_id", "key", "c.at", "c.length", F.explode("c.items").alias("item_id"))


def report(docs: DataFrame, items: DataFrame, n: int = 13, percent: int = 5) -> DataFrame:
    """Per document: doc_id, key, n_words, n_hit, n_items, item_ids, hit_positions (from 0), contaminated."""
    sizes, hits = occurrences(docs, items, n)
    found = hits.groupBy("doc_id", "key").agg(
        F.collect_set(F.struct("at", "length")).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.at, s.at + s.length - 1)))))
    found = found.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), covered.alias("hit_positions"),
                         F.array_sort("ids").alias("item_ids"))
    out = sizes.join(found, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    out = out.select("doc_id", "key", F.col("n_words").cast("long"), F.coalesce(F.size("hit_positions"), F.lit(0)).cast("long").alias("n_hit"),
                     F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
                     F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                     F.coalesce("hit_positions", F.array().cast("array<int>")).alias("hit_positions"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 13, percent: int = 5, remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents (``remove="documents"``), or with the hit words, and what stands before
    them, cut out of contaminated documents (``remove="spans"``)."""
    bad = report(docs, items, n, percent).where("contaminated").select(
        F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.col("hit_positions").alias("_hit")).distinct()
    bad = small(bad, 20_000)
    on = (text_key(F.col("text")) == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    if remove == "documents":
        return docs.join(bad, on, "left_anti")
    marked = docs.join(bad, on, "left")
    # one more gap than words: what stands before each, and after the last
    pieces = F.struct(F.split("text", WORDS).alias("gaps"), F.filter(F.split("text", SEPARATORS), lambda w: w != "").alias("words"))
    kept = let(pieces, lambda p: F.concat(F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(p.words) - 1), "_hit"), lambda i: F.concat(F.get(p.gaps, i), F.get(p.words, i))), ""),
        F.element_at(p.gaps, -1)))
    return marked.select(*[F.when(F.col("_hit").isNotNull(), kept).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns])
