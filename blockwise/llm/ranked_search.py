"""Ranked lexical search for many queries at once: term sets that items share are evaluated once.

The items (queries) are taken in blocks of at most ``BLOCK_TERMS`` terms.  A block is planned on its own: terms that stand in the
same items form a class, and the items are laid, classes most shared first, into a tree whose inner nodes are the term sets that
several items begin with.  Together they are a DAG: documents feed classes, a class feeds every node that uses it, a node feeds the
nodes below it and the items that end there.  Documents go through it in blocks: each class's accumulator (document, partial score)
is materialised once, each node's once as its parent's plus its class's, whatever the number of items that use them.

A task keeps the ``k`` best documents of each item, so what is shuffled are ``k`` rows an item and task.  Documents are split into
words once for each block of items; what is kept of them are the counts of the block's terms.

Scores are integers: a term's weight w is floor(1000 * ln((2N+2) / (2df+1))), a document's m is 75 + (25 n N) div L, and each term
of an item adds w * ((10**9 tf) div (1000 tf + 12 m)); N counts documents with a term, L all terms, n a document's terms.

Defined results: a null or empty text has no terms, as document or item; an item without terms, or that no document scores above 0
for, has no rows; each row of the items is an item, also where ids repeat or are null; each row of the documents is a document;
equal scores are ordered by doc_id, null last, and equal ids are interchangeable; extra columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwise.llm.common import lower_ascii
from blockwise.session import stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Distinct (item, term) pairs planned at a time: bounds the plan on the driver and in each Python worker.
BLOCK_TERMS = 400_000
#: Bytes of one text split into words at a time.
PIECE = 4_000_000
#: Documents that go through the DAG together, and the bytes their accumulators may take along one path.
DOCS, PATH_BYTES = 4096, 64_000_000


def terms_of(text: Column) -> Column:
    """The terms of a text in order, A-Z in lower case."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), 0)


def count_terms(text: bytes | None) -> Counter:
    """Occurrences of each term of a text, which is split piece by piece."""
    counts, at, data = Counter(), 0, (text or b"").lower()
    while at < len(data):
        gap = _BETWEEN.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        counts.update(_TERM_BYTES.findall(data, at, end))
        at = end
    return counts


@dataclass
class Node:
    """A term set that all items below begin with: its parent's terms and those of class ``of``."""
    of: int
    items: list[int] = field(default_factory=list)
    below: dict[int, int] = field(default_factory=dict)


@dataclass
class Plan:
    """The DAG of a block of items."""
    vocabulary: dict[bytes, int]
    #: (term, class, times): the class's accumulator gets ``times`` the term's score.
    feeds: np.ndarray
    nodes: list[Node]
    #: The accumulators that are alive at once at most.
    depth: int
    n_classes: int


def plan(items: dict[int, dict[bytes, int]]) -> Plan:
    """Mines the term sets that ``items`` (number -> term -> occurrences) share."""
    holders: dict[tuple[bytes, int], list[int]] = {}
    for item, terms in items.items():
        for term, n in terms.items():
            holders.setdefault((term, 1), []).append(item)
            if n > 1:  # the first occurrence is shared with all items that hold the term, the others with those that repeat it alike
                holders.setdefault((term, n - 1) if n > 2 else (term, 0), []).append(item)
    classes: dict[tuple[int, ...], int] = {}
    vocabulary: dict[bytes, int] = {}
    feeds = []
    for (term, times), where in holders.items():
        of = classes.setdefault(tuple(where), len(classes))
        feeds.append((vocabulary.setdefault(term, len(vocabulary)), of, times or 1))
    of_item: dict[int, list[int]] = {}
    for where, of in sorted(classes.items(), key=lambda x: (-len(x[0]), x[1])):
        for item in where:
            of_item.setdefault(item, []).append(of)
    nodes, depth = [Node(-1)], 1
    for item, path in of_item.items():
        at = 0
        for of in path:
            down = nodes[at].below.get(of)
            if down is None:
                down = nodes[at].below[of] = len(nodes)
                nodes.append(Node(of))
            at = down
        nodes[at].items.append(item)
        depth = max(depth, len(path))
    return Plan(vocabulary, np.array(sorted(feeds), np.int64).reshape(-1, 3), nodes, depth, len(classes))


def _count(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes, terms, times = [], [], []
            for text in batch["text"].cast(pa.binary()):
                counts = count_terms(text.as_py())
                sizes.append(sum(counts.values()))
                found = {known[t]: n for t, n in counts.items() if t in known}
                terms.append(list(found))
                times.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                                              pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "times"])
    return run


class Best:
    """The ``k`` best documents of each item that a task has met."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        kept = self.of.get(item)
        least = kept[0][-1] if kept is not None and len(kept[0]) == self.k else 1
        at = np.flatnonzero(scores >= least)
        if not len(at):
            return
        if len(at) > 4 * self.k:  # no document below the k-th best score can stay
            at = at[scores[at] >= np.partition(scores[at], -self.k)[-self.k]]
        found = [scores[at], ids[at], nulls[at]]
        if kept is not None:
            found = [np.concatenate(pair) for pair in zip(kept, found)]
        order = np.lexsort((found[1], found[2], -found[0]))[:self.k]
        self.of[item] = [x[order] for x in found]

    def rows(self) -> pa.RecordBatch:
        items = [np.full(len(v[0]), item, np.int64) for item, v in self.of.items()]
        cut = [np.concatenate([v[i] for v in self.of.values()]) if self.of else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, bool))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(items) if items else np.zeros(0, np.int64)), pa.array(cut[1], mask=cut[2]), pa.array(cut[0])],
                                          names=["item", "doc_id", "score"])


class Evaluation:
    """Takes blocks of documents through a plan."""

    def __init__(self, of: Plan, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.plan, self.weights, self.n_docs, self.n_terms, self.best = of, weights, n_docs, n_terms, Best(k)
        self.first = np.searchsorted(of.feeds[:, 0], np.arange(len(of.vocabulary) + 1))

    def _classes(self, place: np.ndarray, terms: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The accumulator of each class: (bounds of classes, documents, partial scores)."""
        times = self.first[terms + 1] - self.first[terms]
        at = np.repeat(self.first[terms] - np.cumsum(times) + times, times) + np.arange(times.sum())
        of = self.plan.feeds[at, 1]
        place, scores = np.repeat(place, times), np.repeat(scores, times) * self.plan.feeds[at, 2]
        key = of * DOCS + place
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.add.reduceat(scores[order], start) if len(start) else scores
        key = key[start]
        return np.searchsorted(key, np.arange(self.plan.n_classes + 1) * DOCS), key % DOCS, sums

    def add(self, ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, place: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
        m = 75 + 25 * sizes * self.n_docs // self.n_terms
        scores = self.weights[terms] * (1_000_000_000 * times // (1000 * times + 12 * m[place]))
        bounds, docs, sums = self._classes(place, terms, scores)
        nodes = self.plan.nodes
        stack = [(0, np.zeros(len(ids), np.int64), False)]
        while stack:
            at, total, shared = stack.pop()
            total, node = total.copy() if shared else total, nodes[at]
            if node.of >= 0:
                lo, hi = bounds[node.of], bounds[node.of + 1]
                total[docs[lo:hi]] += sums[lo:hi]
            for item in node.items:
                self.best.add(item, total, ids, nulls)
            for i, down in enumerate(node.below.values()):  # the child that is taken last gets the node's own array
                stack.append((down, total, i > 0))


def _rank(shared, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Evaluation(*shared.value, k)
        step = max(1, min(DOCS, PATH_BYTES // (8 * work.plan.depth)))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                ids, lists = part["doc_id"], part["terms"]
                place = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                work.add(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part["n"].to_numpy(), place,
                         lists.flatten().to_numpy().astype(np.int64), part["times"].flatten().to_numpy())
        yield work.best.rows()
    return run


def _blocks(counts: DataFrame) -> Iterator[dict[int, dict[bytes, int]]]:
    """Items with their terms, as many at a time as have ``BLOCK_TERMS`` terms together."""
    block, size = {}, 0
    for item, rows in groupby(counts.orderBy("item").toLocalIterator(), key=lambda r: r.item):
        terms = {r.term.encode(): r.n for r in rows}
        if block and size + len(terms) > BLOCK_TERMS:
            yield block
            block, size = {}, 0
        block[item], size = terms, size + len(terms)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    numbered = stage(items.select(F.monotonically_increasing_id().alias("item"), "item_id", terms_of(F.col("text")).alias("terms")))
    counts = numbered.select("item", F.explode("terms").alias("term")).groupBy("item", "term").agg(F.count("*").alias("n"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    best = spark.createDataFrame([], "item long, doc_id long, score long")
    for block in _blocks(counts):
        of = plan(block)
        known = spark.sparkContext.broadcast(of.vocabulary)
        counted = stage(texts.mapInArrow(_count(known), "doc_id long, n long, terms array<int>, times array<long>").where("n > 0"))
        n_docs, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
        # a number for each term of the block
        df = {r.term: r.df for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(of.vocabulary))], np.int64)
        shared = spark.sparkContext.broadcast((of, weights, n_docs, n_terms or 1))
        best = best.unionByName(counted.select("doc_id", "n", "terms", "times").mapInArrow(_rank(shared, k), "item long, doc_id long, score long"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
