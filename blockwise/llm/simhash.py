"""Near-duplicates by SimHash, linked by a self-join of binary tries.

A document's fingerprint has the majority bits of the hashes of its word shingles.  Fingerprints link if at most
``BUDGET`` of 64 bits differ.  The self-join descends a binary trie in pairs of nodes, adds up the bits in which the
two paths differ, and drops a pair as soon as they exceed the budget.

To spread that over tasks, the 64 bits are cut into 4 blocks of 16, and each block's remaining 48 bits into 4 of 12: two
fingerprints within 3 bits agree in one block and, in the rest, in one of the smaller ones.  So each distinct
fingerprint goes to 16 tries, each for 28 agreeing bits.  Copies count once: equal fingerprints are one entry.  A task
walks tries with bounded frontiers and returns only a spanning forest of the links it found, and components are joined
up over all tasks afterwards.

Defined results: null and empty texts have fingerprint zero and link like any other; a null doc_id is never the name of
a component, a component of only such rows has the null id; repeated rows share their fingerprint and component; extra
columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockwise.llm.common import text_key
from blockwise.llm.components import components
from blockwise.session import stage

SHINGLE, SEED, BUDGET = 3, 42, 3
#: Rows of sorted tries that a task takes up at a time, and node pairs that it holds at a time.
TRIE_ROWS, FRONTIER = 400_000, 1_000_000
ADDED = ("fingerprint", "component_id")


def shingle_hashes(text: bytes | None) -> list[int]:
    """XXH64 of each run of three words, repeats included; of all words if there are fewer."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the white space \\x20 \\x09-\\x0D
    if not words:
        return []
    line, width = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1]
    hashed, seed = xxhash.xxh64_intdigest, SEED
    return [hashed(line[a:b], seed) for a, b in zip(starts.tolist(), (ends[width - 1:] - 1).tolist())]


def fingerprint(hashes: list[int]) -> int:
    """A bit is one if it is in more than half of the hashes; none: zero."""
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 100_000):
        part = np.array(hashes[i:i + 100_000], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(shingle_hashes(t.as_py())) for t in batch["text"]], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(prints)], names=["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp): the fingerprint as a signed long; key stands for the text."""
    texts = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(_fingerprints, "doc_id long, key long, fp long")


def _bits(x: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << width) - 1))


def trie_keys(fp: Column) -> Column:
    """The 16 tries of a fingerprint: 28 of its bits, and which ones they are."""
    keys = []
    for block in range(4):
        rest = [low for low in range(0, 64, 4) if low // 16 != block]  # 12 nibbles, 3 to each smaller block
        for piece in range(4):
            inner = [F.shiftleft(_bits(fp, low, 4), 16 + 4 * k) for k, low in enumerate(rest[3 * piece:3 * piece + 3])]
            key = _bits(fp, 16 * block, 16)
            for x in inner:
                key = key.bitwiseOR(x)
            keys.append(key.bitwiseOR(F.lit((4 * block + piece) << 28)))
    return F.array(*keys)


class Forest:
    """Links among numbered nodes, kept as the least number reachable."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def trie_links(tries: np.ndarray, prints: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the links within each trie; both arrays are sorted by (trie, print), prints distinct in a trie."""
    n = len(prints)
    forest = Forest(n)
    edge = np.flatnonzero(np.concatenate(([True], tries[1:] != tries[:-1], [True])))
    low, high = edge[:-1], edge[1:]
    more = high - low > 1
    # a frontier entry is a pair of nodes (ranges of the sorted prints that share a path) and the bits they differ in
    todo = [(63, low[more], high[more], low[more], high[more], np.zeros(int(more.sum()), np.int64))]
    zeros_before = {}
    while todo:
        bit, a0, a1, b0, b1, err = todo.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            todo += [(bit, *(x[:half] for x in (a0, a1, b0, b1, err))), (bit, *(x[half:] for x in (a0, a1, b0, b1, err)))]
            continue
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaves.any():
            i, j = a0[leaves], b0[leaves]
            near = np.bitwise_count(prints[i] ^ prints[j]) <= budget
            forest.link(i[near], j[near])
            a0, a1, b0, b1, err = (x[~leaves] for x in (a0, a1, b0, b1, err))
        if not len(a0) or bit < 0:
            continue
        if bit not in zeros_before:
            zeros_before[bit] = np.concatenate(([0], np.cumsum((prints >> np.uint64(bit)) & np.uint64(1) == 0)))
        zeros = zeros_before[bit]
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        own = a0 == b0
        nexts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1)]
        cross = ~own
        nexts.append(tuple(x[cross] for x in (am, a1, b0, bm, err + 1)))
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*nexts))
        live = (err <= budget) & (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 == 1))
        todo.append((bit - 1, *(x[live] for x in (a0, a1, b0, b1, err))))
    linked = np.flatnonzero(forest.root != np.arange(n))
    return linked, forest.root[linked]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def joined(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, rows
        tries, prints = (np.concatenate(x) for x in zip(*held))
        cut = len(tries) if last else int(np.searchsorted(tries, tries[-1]))  # the last trie may go on in the next batch
        held, rows = [(tries[cut:], prints[cut:])], len(tries) - cut
        if cut:
            a, b = trie_links(tries[:cut], prints[:cut])
            yield pa.RecordBatch.from_arrays([pa.array(prints[a].view(np.int64)), pa.array(prints[b].view(np.int64))], names=["a", "b"])

    for batch in batches:
        held.append((batch["trie"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)))
        rows += batch.num_rows
        if rows >= TRIE_ROWS:
            yield from joined(False)
    if rows:
        yield from joined(True)


def links(prints: DataFrame) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints ``fp`` that differ in at most three bits."""
    # the order within a trie must be that of unsigned numbers
    tries = prints.select(F.explode(trie_keys(F.col("fp"))).alias("trie"), "fp").repartition("trie")
    tries = tries.sortWithinPartitions("trie", F.col("fp") < 0, "fp")
    return tries.mapInArrow(_links, "a long, b long")


def classes(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for every fingerprint in ``prints`` (doc_id, fp): the smallest doc_id reachable."""
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = distinct.join(components(links(distinct.select("fp"))), F.col("fp") == F.col("node"), "left")
    named = named.select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(names, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits) and component_id."""
    prints = stage(fingerprints(docs).select("doc_id", "fp"))
    return prints.join(classes(prints), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest doc_id (null last; of repeated rows one)."""
    prints = stage(fingerprints(docs))
    ranked = prints.join(classes(prints), "fp").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("unnamed"))
    kept = ranked.agg(F.min_by(F.struct("doc_id", "key"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))).alias("k"))
    kept = kept.select(F.coalesce("k.doc_id", F.lit(-(1 << 63))).alias("_doc"), F.col("k.key").alias("_key"))
    marked = docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_key": text_key(F.col("text"))})
    copies = W.partitionBy("_doc", "_key").orderBy("_doc", "_key")
    joined = marked.join(kept, ["_doc", "_key"], "left_semi").withColumn("_copy", F.row_number().over(copies))
    return joined.where("_copy = 1").drop("_doc", "_key", "_copy")
