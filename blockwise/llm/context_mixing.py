"""Scoring texts with a language model of mixed predictors.

A text is a sequence of lower-case words and one end.  Each token is predicted from what stands before it in its text by

* spelling, bit by bit: six predictors look up counts under hashed contexts (the last one to four bytes, the place in the
  word, the whole word so far), their log-odds are combined by weights from a set that the bit's place and the third-order
  context's experience choose, and a last table refines the result from what followed such results before,
* the dictionary of a class of texts (by default their language), gated by the class that the text's earlier frequent words make
  likeliest, with its unseen share falling back on the dictionary of all texts, and
* the text's own earlier words, with a weight that adapts to how often they have recurred so far.

All ways are added up for every token, so the probabilities of all texts sum to one.  What no dictionary has only the spelling
predicts.  Its contexts end at the word's edge, so that a word is spelled alike wherever it stands, and once for all its tokens.

Dictionaries and counts come from every token of all training texts, ends included.  The weights are learned online: every task
runs once through its share of the training words, predicting the tokens of each from the counts without one of them before
learning from all; the tasks' weights are averaged and the refining table's counts added.  The spelling's share in a token is that
of ``SHARES`` under which the training tokens, each left out of the dictionary and spelled before it was learned from, are
likeliest.  Across texts nothing is learned while scoring, so a score does not depend on the order of the texts.

The dictionary grows with the corpus and is never broadcast.  Words that make up more than one token in ``FREQUENT`` are
looked up in a table of at most that many; the others are joined by shuffle.  The predictors' tables have four places for
each distinct word or more, up to 2**``MAX_TABLE_BITS`` (201 MB of counts for all orders; beyond, contexts share places).

Defined results: null and empty texts are one end; repeated rows get the same score; a null doc_id is never held out;
without training texts the dictionary is empty and everything is spelled; a null class is one of its own with those
that are not among the ``CLASSES`` most frequent; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, compress, count, repeat
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.llm.common import held_out, text_key
from blockwise.session import stage

ORDERS, TABLE_BITS, GATES = 6, 20, 32
#: The tables have 2**TABLE_BITS places at least, and as many as the distinct words ask for up to this.
MAX_TABLE_BITS = 22
#: Bound of the words that are looked up without a join.
FREQUENT = 1 << 18
#: Words that a task counts before it hands them on, words of a task that learns, bytes whose bits are handled at once,
#: and bytes after which the weights are adapted.
HELD_WORDS, TASK_WORDS, SLICE, ADAPT = 300_000, 300_000, 1 << 14, 1 << 11
BLOCK = 1 << 15
SMOOTH, BASE_SMOOTH, DISCOUNT, BACKGROUND = 0.4, 0.1, 0.5, 0.03
#: Shares of the spelling in a token's probability, of which training takes the likeliest.
SHARES = 1 / (1 + np.exp(-np.linspace(-6, 6, 33)))
#: Classes with a dictionary of their own; all others share one.
CLASSES = 8
_MULTIPLY, _NODE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PRIME, _INVERSE = np.uint64(0x100000001B3), np.uint64(pow(0x100000001B3, -1, 1 << 64))
END = b""


def tokens(text: bytes | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes split at exactly the white space \\x20 \\x09-\\x0D."""
    return (text or b"").lower().split()


# ---- the corpus ----

def _count(kinds: dict[str | None, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter[bytes]] = [Counter() for _ in range(len(kinds) + 1)]
        others: set[bytes] = set()  # words of texts that are not counted

        def flush() -> pa.RecordBatch:
            words = [*chain.from_iterable(counts), *others]
            n = [*chain.from_iterable(c.values() for c in counts), *repeat(0, len(others))]
            of = np.repeat(np.arange(len(counts) + 1, dtype=np.int32) % len(counts), [*map(len, counts), len(others)])
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(of), pa.array(n, pa.int64())], names=["word", "class", "n"])
            for held in (*counts, others):
                held.clear()
            return out

        for batch in batches:
            for text, apart, label in zip(batch["text"], batch["held_out"].to_pylist(), batch["label"].to_pylist()):
                words = tokens(text.as_py())
                words.append(END)
                (others if apart else counts[kinds.get(label, len(kinds))]).update(words)
                if sum(map(len, counts)) + len(others) > HELD_WORDS:
                    yield flush()
        if others or any(counts):
            yield flush()
    return run


def vocabulary(texts: DataFrame, kinds: dict[str | None, int]) -> DataFrame:
    """(word, n, by_class) for every word of every text; training texts only are counted, so n may be zero.  The end is the empty word."""
    counts = texts.select("text", "held_out", "label").mapInArrow(_count(kinds), "word binary, class int, n long")
    each = [F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(kinds) + 1)]
    summed = counts.groupBy("word").agg(F.sum("n").alias("n"), *each)
    return stage(summed.select("word", "n", F.array(*[f"n{k}" for k in range(len(kinds) + 1)]).alias("by_class")))


# ---- predictors ----

def contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of each word and the space that ends it: hashed contexts (orders x bytes), byte, the byte before, word number."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 2)[:-1])) + 1
    word = np.repeat(np.arange(len(words)), sizes + 1)
    inside = np.arange(len(word)) - np.repeat(np.concatenate(([0], np.cumsum(sizes + 1)[:-1])), sizes + 1)
    at = starts[word] + inside
    back = [np.where(inside >= k - 1, data[np.maximum(at - k, 0)], 0).astype(np.uint64) for k in range(1, 5)]
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data), _PRIME))), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data), _INVERSE))), dtype=np.uint64)
    running = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)))
    so_far = (running[at] - running[starts[word]]) * inverse[starts[word]]
    near = [back[0]]
    for b in back[1:]:
        near.append((near[-1] << np.uint64(8)) | b)
    raw = [np.minimum(inside, 15).astype(np.uint64), *near, so_far]
    hashed = np.stack([(x + salt) * _MULTIPLY for x, salt in zip(raw, np.arange(1, ORDERS + 1, dtype=np.uint64) * _NODE)])
    return hashed ^ (hashed >> np.uint64(29)), data[at], back[0].astype(np.int64), word


def table_bits(distinct: int) -> int:
    return min(MAX_TABLE_BITS, max(TABLE_BITS, ceil(log2(4 * max(1, distinct)))))


def slots(hashed: np.ndarray, byte: np.ndarray, size: int = TABLE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(table places, orders x bytes x 8; the bits, bytes x 8)."""
    wide = byte.astype(np.uint64)[:, None]
    j = np.arange(8, dtype=np.uint64)
    bits = ((wide >> (np.uint64(7) - j)) & np.uint64(1)).astype(np.int64)
    nodes = (np.uint64(1) << j) | (wide >> (np.uint64(8) - j))
    places = hashed[:, :, None] + nodes * _NODE
    places *= _MULTIPLY
    places >>= np.uint64(64 - size)
    return places.view(np.int64), bits


def _distinct(hashed: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words share beginnings: a place of each distinct byte with its contexts, and each byte's number among these."""
    order = np.argsort(hashed[-1] ^ (byte.astype(np.uint64) * _MULTIPLY))
    h, b = hashed[:, order], byte[order]
    new = np.ones(len(byte), bool)
    new[1:] = (h[:, 1:] != h[:, :-1]).any(axis=0) | (b[1:] != b[:-1])
    number = np.empty(len(byte), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _names(words: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64).view(np.int64)


def _slices(words: list[bytes], most: int = 4 * SLICE) -> Iterator[list[bytes]]:
    """Runs of words of about ``most`` bytes."""
    run, size = [], 0
    for w in words:
        run.append(w)
        size += len(w) + 1
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def _all_words(batches: Iterator[pa.RecordBatch], key: Callable[[bytes], object] | None = None) -> tuple[list[bytes], np.ndarray]:
    """A task's words in order, and how often each occurs (once if that is not given); at most about ``TASK_WORDS``."""
    words, times = [], [np.zeros(0, np.int64)]
    for batch in batches:
        words += batch["word"].to_pylist()
        times.append(np.asarray(batch["n"]) if "n" in batch.schema.names else np.ones(batch.num_rows, np.int64))
    keys = words if key is None else [*map(key, words)]
    order = sorted(range(len(words)), key=keys.__getitem__)
    return [words[i] for i in order], np.concatenate(times)[order]


def _counted(words: list[bytes], times: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The slices of words with what belongs to them."""
    at = 0
    for some in _slices(words):
        yield some, times[at:at + len(some)]
        at += len(some)


def _tally(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((ORDERS, 2 << size), np.uint32)

        def flush() -> Iterator[pa.RecordBatch]:
            for number, block in enumerate(tables.reshape(-1, BLOCK)):
                at = np.flatnonzero(block)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                                                      pa.array([block[at].tobytes()], pa.binary())], names=["block", "at", "n"])
                    block[:] = 0

        held = 0  # no place has more
        for some, each in _counted(*_all_words(batches)):
            hashed, byte, _, word = contexts(some)
            first, number = _distinct(hashed, byte)
            hashed, byte = hashed[:, first], byte[first]
            times = np.zeros(len(first), np.int64)
            np.add.at(times, number, each[word])
            total = int(times.sum())
            # counts that 32 bits do not hold go on in several parts
            rounds = (total >> 31) + 1
            for r in range(rounds):
                n = (times // rounds + (times % rounds > r)).astype(np.uint32)
                held += int(n.sum(dtype=np.int64))
                if held >> 32:
                    yield from flush()
                    held = int(n.sum(dtype=np.int64))
                for i in range(0, len(byte), SLICE):
                    places, bits = slots(hashed[:, i:i + SLICE], byte[i:i + SLICE], size)
                    wide = np.repeat(n[i:i + SLICE], 8)
                    for k in range(ORDERS):
                        np.add.at(tables[k], (places[k] * 2 + bits).ravel(), wide)
        yield from flush()
    return run


def _added(parts: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK, np.int64)
    for at, n in zip(parts["at"], parts["n"]):
        total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
    # counts beyond 32 bits are halved together with the other of their place, which keeps their ratio
    pairs = total.reshape(-1, 2)
    while (over := pairs.max(axis=1) >> 32 > 0).any():
        pairs[over] >>= 1
    return pd.DataFrame({"block": parts["block"].iloc[:1], "n": [total.astype(np.uint32).tobytes()]})


def tally(words: DataFrame, size: int = TABLE_BITS) -> np.ndarray:
    """Counts of zeros and ones (orders x 2**size places x 2), each word counted n times, or once without a column n."""
    blocks = stage(words.mapInArrow(_tally(size), "block long, at binary, n binary").groupBy("block").applyInPandas(_added, "block long, n binary"))
    each = (2 << size) // BLOCK
    out = np.zeros((ORDERS * each, BLOCK), np.uint32)
    for k in range(ORDERS):  # one order at a time, for the driver's memory
        some = blocks.where((F.col("block") >= k * each) & (F.col("block") < (k + 1) * each)).toArrow()
        for block, n in zip(some["block"].to_pylist(), some["n"]):
            out[block] = np.frombuffer(n.as_buffer(), np.uint32)
    return out.reshape(ORDERS, -1, 2)


@dataclass
class Counts:
    """Counts that travel compressed: most places are empty or hold small numbers."""

    tables: np.ndarray

    def __getstate__(self) -> tuple[tuple[int, ...], list[bytes]]:
        return self.tables.shape, [zlib.compress(np.ascontiguousarray(t), 1) for t in self.tables]

    def __setstate__(self, state: tuple[tuple[int, ...], list[bytes]]) -> None:
        shape, packed = state
        self.tables = np.empty(shape, np.uint32)
        for k, t in enumerate(packed):
            self.tables[k] = np.frombuffer(zlib.decompress(t), np.uint32).reshape(shape[1:])


def _experience(total: np.ndarray) -> np.ndarray:
    return (total > 0).astype(np.int64) + (total > 3) + (total > 30)


def _refine_places(before: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    return before[:, None] * 33 + np.clip(np.rint((mixed + 8) * 2), 0, 32).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def _learn(shared, tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables
        size = tables.shape[1].bit_length() - 1
        pairs = [t.view(np.uint64).ravel() for t in tables]  # both counts of a place at once
        weights, gathered = np.full((ORDERS + 1, GATES), 0.3), np.full((ORDERS + 1, GATES), 1e-2)
        weights[ORDERS] = 0.0
        refine = np.zeros((2, 256 * 33))
        fit = np.zeros(len(SHARES))
        seen = 0
        # in order of a hash: neighbours in the alphabet would be learned one after the other
        for some, each in _counted(*_all_words(batches, xxhash.xxh64_intdigest)):
            hashed, byte, before, word = contexts(some)
            spelled = np.zeros(len(some))
            for i in range(0, len(byte), ADAPT):
                of = word[i:i + ADAPT]
                times = np.repeat(each[of], 8).astype(np.float64)
                places, bits = slots(hashed[:, i:i + ADAPT], byte[i:i + ADAPT], size)
                one = bits.astype(np.float64)
                own = np.stack([1 - one, one], axis=-1)
                odds, gate = [], None
                for k in range(ORDERS):
                    n = pairs[k].take(places[k]).view(np.uint32).reshape(own.shape) - own
                    np.maximum(n, 0, out=n)
                    if k == 3:
                        gate = _experience(n[..., 0] + n[..., 1]) * 8 + np.arange(8)
                    n += SMOOTH
                    odds.append(np.log(n[..., 1] / n[..., 0]))
                odds.append(np.ones_like(one))
                mixed = sum(weights[k].take(gate) * odds[k] for k in range(ORDERS + 1))
                ones = _sigmoid(mixed)
                error = (one - ones) * times.reshape(one.shape)
                spelled += np.bincount(of, np.log(np.where(bits == 1, ones, 1 - ones)).sum(axis=1), len(some))
                flat = gate.ravel()
                for k in range(ORDERS + 1):
                    step = np.bincount(flat, (error * odds[k]).ravel(), GATES)
                    gathered[k] += step * step
                    weights[k] += 0.1 * step / np.sqrt(gathered[k])
                at = _refine_places(before[i:i + ADAPT], mixed).ravel()
                refine[0] += np.bincount(at, times, 256 * 33)
                refine[1] += np.bincount(at, one.ravel() * times, 256 * 33)
            # a token under the dictionary without it and as it was spelled, for each share of the spelling
            known, chance = (each - 1) / max(1, tokens), np.maximum(np.exp(spelled), 1e-300)
            for j, share in enumerate(SHARES):
                fit[j] += each @ np.log((1 - share) * known + share * chance)
            seen += int(each.sum())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), *(pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in (weights, refine, fit))],
                                             names=["seen", "weights", "refine", "fit"])
    return run


def _merged(parts: pd.DataFrame) -> pd.DataFrame:
    """Weights averaged by the number of tokens, counts and logarithms added."""
    order = np.lexsort((parts["weights"].map(lambda w: w[0]), parts["seen"]))
    seen = parts["seen"].to_numpy(dtype=float)[order]
    weights = np.stack(parts["weights"].to_list())[order]
    refine = np.stack(parts["refine"].to_list())[order]
    fit = np.stack(parts["fit"].to_list())[order]
    return pd.DataFrame({"seen": [int(seen.sum())], "weights": [(seen @ weights / seen.sum()).tolist()], "refine": [refine.sum(axis=0).tolist()],
                         "fit": [fit.sum(axis=0).tolist()]})


@dataclass
class Speller:
    """The predictors' counts, the weights of each gate, the refining table and the spelling's share of a token's probability."""

    tables: np.ndarray | None
    weights: np.ndarray
    refine: np.ndarray
    share: float = 1.0
    odds: np.ndarray | None = None
    gates: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return vars(self) | {"tables": None if self.tables is None else Counts(self.tables)}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state | {"tables": state["tables"] and state["tables"].tables})

    def prepare(self) -> Speller:
        if self.odds is None:
            self.odds = np.empty(self.tables.shape[:2], np.float32)
            for k, table in enumerate(self.tables):
                n = table.astype(np.float32)
                self.odds[k] = np.log((n[:, 1] + np.float32(SMOOTH)) / (n[:, 0] + np.float32(SMOOTH)))
                if k == 3:
                    self.gates = (_experience(n.sum(axis=-1)) * 8).astype(np.uint8)
            self.tables = None  # no longer needed, and large
        return self

    def spell(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of the probability of spelling each word."""
        hashed, byte, before, word = contexts(words)
        first, number = _distinct(hashed, byte)
        hashed, byte, before = hashed[:, first], byte[first], before[first]
        size = self.odds.shape[1].bit_length() - 1
        each = np.zeros(len(byte))
        for i in range(0, len(byte), SLICE):
            places, bits = slots(hashed[:, i:i + SLICE], byte[i:i + SLICE], size)
            gate = self.gates.take(places[3]) + np.arange(8)
            mixed = self.weights[ORDERS].take(gate)
            for k in range(ORDERS):
                mixed += self.weights[k].take(gate) * self.odds[k].take(places[k])
            ones = 0.5 * _sigmoid(mixed) + 0.5 * self.refine.take(_refine_places(before[i:i + SLICE], mixed))
            ones = np.clip(ones, 1e-5, 1 - 1e-5)
            each[i:i + SLICE] = np.log(np.where(bits == 1, ones, 1 - ones)).sum(axis=1)
        return np.bincount(word, each[number], len(words))


def learn(words: DataFrame, size: int = TABLE_BITS, tokens: int = 0) -> Speller:
    """A speller with tables of 2**size places from the ``tokens`` training tokens (word, n), in two passes over them.

    A bit of a word is predicted alike wherever it stands, so that its n tokens are worked on at once and weigh n; without a
    column n each word is one token.
    """
    tables = tally(words, size)
    shared = words.sparkSession.sparkContext.broadcast(Counts(tables))  # at most ORDERS << (size + 3) bytes
    schema = "seen long, weights array<double>, refine array<double>, fit array<double>"
    parts = words.mapInArrow(_learn(shared, tokens), schema)
    # a few numbers per task, summed in groups of tasks before they are put together
    partial = parts.withColumn("g", F.pmod(F.xxhash64("seen", F.element_at("weights", 1)), F.lit(8))).groupBy("g").applyInPandas(
        _merged, schema)
    rows = sorted(partial.collect(), key=lambda r: (r.seen, r.weights))  # 8 at most
    if not rows:
        weights, hits, ones, share = np.full((ORDERS + 1, GATES), 0.3), np.zeros(256 * 33), np.zeros(256 * 33), 1.0
    else:
        merged = _merged(pd.DataFrame([r.asDict() for r in rows])).iloc[0]
        weights = np.array(merged["weights"]).reshape(ORDERS + 1, GATES)
        hits, ones = np.array(merged["refine"]).reshape(2, -1)
        share = float(SHARES[np.argmax(merged["fit"])])
    usual = np.tile(_sigmoid(np.arange(33) / 2 - 8), 256)
    shared.destroy()
    return Speller(tables, weights, (ones + 4 * usual) / (hits + 4), share)


# ---- tokens and texts ----

@dataclass
class Corpus:
    """Training tokens and distinct ones, of all texts and of each class, and the share of the spelling."""

    tokens: int
    distinct: int
    share: float
    of_class: list[tuple[int, int]]

    def base(self, n: Column) -> Column:
        return F.log10((n + BASE_SMOOTH) / (self.tokens + BASE_SMOOTH * (self.distinct + 1)))

    def chance(self, n: Column, in_class: Column, k: Column, spelled: Column) -> Column:
        """Probability of a word in a class."""
        everywhere = n / max(1, self.tokens)
        total, kinds = (F.element_at(F.array(*[F.lit(float(x[i])) for x in self.of_class]), k + 1) for i in (0, 1))
        own = (F.greatest(in_class - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * everywhere) / total
        known = F.when(total > 0, (1 - BACKGROUND) * own + BACKGROUND * everywhere).otherwise(everywhere)
        return (1 - self.share) * known + self.share * F.exp(spelled)


def _lexicon(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = shared.value.prepare()
        for batch in batches:
            words = batch["word"].to_pylist()
            spelled = np.concatenate([speller.spell(run) for run in _slices(words)]) if words else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["word"], pa.array(_names(words)), batch["n"], batch["by_class"], pa.array(spelled)],
                                             names=["word", "name", "n", "by_class", "spelled"])
    return run


@dataclass
class Frequent:
    """Frequent words: their number, base score and probability in each class; how likely each class is at first."""

    place: dict[bytes, int]
    base: np.ndarray
    chance: np.ndarray
    prior: np.ndarray

    @cached_property
    def evidence(self) -> np.ndarray:
        """The logarithms of ``chance``; the last row stands for other words."""
        return np.concatenate([np.log(self.chance), np.zeros((1, len(self.prior)))])


def walk(words: list[bytes], frequent: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token: its place among the frequent words or -1, the class, the weight of the dictionary, and the
    probability that the text's own earlier words give it."""
    n = len(words)
    # words go by the place of their first one
    known: dict[bytes, int] = {}
    own = np.fromiter(map(known.setdefault, words, count()), np.int64, n)
    places = np.empty(n, np.int64)
    places[np.fromiter(known.values(), np.int64, len(known))] = np.fromiter(map(frequent.place.get, known, repeat(-1)), np.int64, len(known))
    places = places[own]
    evidence = frequent.evidence.take(places, axis=0, mode="wrap")
    kind = (np.cumsum(evidence, axis=0) - evidence + frequent.prior).argmax(axis=1)
    order = np.argsort(own, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=n))[:-1]))
    times = np.empty(n, np.int64)
    times[order] = np.arange(n) - first[own[order]]
    again, at = times > 0, np.arange(n)
    # in steps of 1/256, which many tokens share
    weight = np.maximum(1, np.rint(128 * (np.cumsum(again) - again + 0.5) / (at + 10))) / 256 * (at > 0)
    return places, kind, 1 - weight, weight * times / np.maximum(at, 1)


def _parts(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per text a row with the sums over frequent words (class -1), and a row for each of its other tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent: Frequent = shared.value
        labels = ["doc_id", "key", "name", "class", "keep", "own", "head"]
        fields = [pa.field(x, pa.int64()) for x in ("n_tokens", "n_bytes", "n_known")]
        for batch in batches:
            heads, rows, names, kinds, keeps, owns = [], [], [], [], [], []
            held = 0

            def rest() -> pa.RecordBatch:
                take = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))
                out = [batch["doc_id"].take(take), batch["key"].take(take), pa.array(np.concatenate([np.zeros(0, np.int64), *names])),
                       pa.array(np.concatenate([np.zeros(0, np.int32), *kinds]), pa.int32()), pa.array(np.concatenate([np.zeros(0), *keeps])),
                       pa.array(np.concatenate([np.zeros(0), *owns])), pa.nulls(len(take), pa.struct(fields))]
                for x in (rows, names, kinds, keeps, owns):
                    x.clear()
                return pa.RecordBatch.from_arrays(out, names=labels)

            for i, text in enumerate(batch["text"]):
                words = tokens(text.as_py())
                words.append(END)
                places, kind, keep, own = walk(words, frequent)
                often, rare = np.flatnonzero(places >= 0), np.flatnonzero(places < 0)
                p = places[often]
                score = np.log10(own[often] + keep[often] * frequent.chance[p, kind[often]]).sum() if len(p) else 0.0
                base = frequent.base[p].sum() if len(p) else 0.0
                heads.append((len(words), sum(map(len, words)) + len(words), len(p), float(base), float(score)))
                rows.append(np.full(len(rare), i))
                names.append(_names(compress(words, places < 0)))
                kinds.append(kind[rare].astype(np.int32))
                keeps.append(keep[rare])
                owns.append(own[rare])
                held += len(rare)
                if held > 100_000:
                    yield rest()
                    held = 0
            yield rest()
            n = len(heads)
            size = [pa.array([h[j] for h in heads], pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], batch["key"], pa.array([-1] * n, pa.int32()), pa.array([h[3] for h in heads], pa.float64()),
                                              pa.array([h[4] for h in heads], pa.float64()), pa.StructArray.from_arrays(size, fields=fields)], names=labels)
    return run


def score(docs: DataFrame, label: str | None = "lang", modulus: int = 10, remainder: int = 0) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``label`` names the column with the classes of training texts; texts are scored without it.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key"), held_out(F.col("doc_id"), modulus, remainder).alias("held_out"),
                        (F.col(label).cast("string") if label else F.lit("")).alias("label"), F.col("text").cast("binary").alias("text"))
    sizes = texts.where(~F.col("held_out") & F.col("label").isNotNull()).groupBy("label").count().orderBy(F.desc("count"), "label").limit(CLASSES).collect()
    kinds = {r.label: k for k, r in enumerate(sizes)}
    words = vocabulary(texts, kinds)
    of = [x for k in range(len(kinds) + 1) for x in (F.coalesce(F.sum(F.get("by_class", F.lit(k))), F.lit(0)), F.count_if(F.get("by_class", F.lit(k)) > 0))]
    rows, n, distinct, *each = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), *of).first()
    words = words.repartition(max(1, ceil(rows / TASK_WORDS)))
    learned = learn(words.where("n > 0").select("word", "n"), table_bits(distinct), n)
    corpus = Corpus(n, distinct, learned.share, list(zip(each[::2], each[1::2])))
    speller = spark.sparkContext.broadcast(learned)
    lexicon = stage(words.mapInArrow(_lexicon(speller), "word binary, name long, n long, by_class array<long>, spelled double"))
    # at most FREQUENT words make up one token in FREQUENT each
    chances = [corpus.chance(F.col("n"), F.get("by_class", F.lit(k)), F.lit(k), F.col("spelled")).alias(f"p{k}") for k in range(len(kinds) + 1)]
    often = lexicon.where((F.col("n") > 0) & (F.col("n") * FREQUENT >= n)).select("word", corpus.base(F.col("n")).alias("base"), *chances).toArrow()
    prior = np.log([max(t, 0.5) for t, _ in corpus.of_class])
    frequent = spark.sparkContext.broadcast(Frequent({w: i for i, w in enumerate(often["word"].to_pylist())}, often["base"].to_numpy(),
                                                     np.stack([often[f"p{k}"].to_numpy() for k in range(len(kinds) + 1)], axis=1), prior))
    parts = texts.select("doc_id", "key", "text").mapInArrow(
        _parts(frequent), "doc_id long, key long, name long, class int, keep double, own double, head struct<n_tokens:long,n_bytes:long,n_known:long>")
    rare = lexicon.select(F.col("name").alias("_name"), "n", "by_class", "spelled")
    joined = parts.join(rare.hint("shuffle_hash"), (F.col("name") == F.col("_name")) & (F.col("class") >= 0), "left")
    is_head, k = F.col("class") < 0, F.greatest("class", F.lit(0))
    chance = corpus.chance(F.col("n"), F.get("by_class", k), k, F.col("spelled"))
    # a word too long to have a probability above zero has its logarithm all the same
    longest = F.greatest(F.col("own") + F.col("keep") * chance, F.lit(1e-300))
    spelled_out = F.when(F.col("spelled") < -600, F.when((F.col("n") == 0) & (F.col("own") == 0), F.log10(F.col("keep") * corpus.share) + F.col("spelled") / float(np.log(10))))
    totals = joined.groupBy("doc_id", "key").agg(
        F.count("head").alias("copies"), F.sum("head.n_tokens").alias("n_tokens"), F.sum("head.n_bytes").alias("n_bytes"),
        (F.sum("head.n_known") + F.count_if(~is_head & (F.col("n") > 0))).alias("n_known"),
        F.sum(F.when(is_head, F.col("keep")).otherwise(corpus.base(F.col("n")))).alias("base_score"),
        F.sum(F.when(is_head, F.col("own")).otherwise(F.coalesce(spelled_out, F.log10(longest)))).alias("score"))
    # repeated rows were added up
    apart = totals.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    whole = lambda c: (F.col(c) / F.col("copies")).cast("long").alias(c)
    real = lambda c: (F.col(c) / F.col("copies")).alias(c)
    return apart.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), whole("n_tokens"), whole("n_known"),
                        F.lit(n).cast("long").alias("train_tokens"), real("base_score"), real("score"),
                        (-F.col("score") / F.col("n_bytes") * float(np.log2(10))).alias("bits_per_byte"))
