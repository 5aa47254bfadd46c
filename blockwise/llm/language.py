"""Language identification with n-gram filters that hold a bit per language.

The n-grams (``N`` bytes of lower-case text in which everything but letters is one space) of each language's training
texts are put into Bloom filters that lie bit-sliced beside each other: a position holds one bit per language, in as many
words of 64 as the languages need, so that ANDing the words at an n-gram's positions gives all languages that contain it.  Per language the hits of a text are
counted, corrected for the filter's own rate of false positives, and the largest share decides.

An n-gram belongs to a language if its share of the language's n-grams is at least ``SHARE`` of that in the language
where it is most common, and it was seen twice.  All training texts are counted, in tasks and then by shuffle; the
filters have a size that follows the number of distinct n-grams up to a fixed bound, and are broadcast.

Defined results: ``und`` with score 0 for null texts, texts without letters and where nothing was learned; texts none of
whose n-grams is known get the language with most training text; ties go to the language first in order; rows with a null language teach nothing; repeated rows count each time; extra columns are
left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.llm.common import held_out
from blockwise.session import stage

N, PROBES, SHARE = 4, 3, 0.25
#: Positions of the filters: at least 2**MIN_BITS, about 16 per n-gram, at most 2**MAX_BITS (8 bytes each for every 64 languages: 32 MB).
MIN_BITS, MAX_BITS = 16, 22
#: Languages a filter word has bits for.
WORD = 64
UNKNOWN = "und"
#: Bytes of text that a task counts at a time.
BLOCK = 4_000_000
_SPACED = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def normal(text: str | None) -> bytes:
    """Letters in lower case, other ASCII as spaces, one between words and at both ends (more after a single letter)."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split(b" ")
    line = b" ".join(w for w in words if w)
    return (b" " + line + b" ").ljust(N) if line else b""


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def grams(data: np.ndarray) -> np.ndarray:
    """The n-grams of a byte array as numbers."""
    if len(data) < N:
        return np.zeros(0, np.uint32)
    wide = data.astype(np.uint32)
    out = wide[:len(data) - N + 1].copy()
    for k in range(1, N):
        out = (out << np.uint32(8)) | wide[k:len(data) - N + 1 + k]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def flush(lang: str) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(held[lang]), np.uint8)
        # texts are joined by the spaces at their ends; n-grams over a seam are those of two words that follow
        found, counts = np.unique(grams(data), return_counts=True)
        held[lang], sizes[lang] = [], 0
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(counts.astype(np.int64))],
                                          names=["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            line = normal(text)
            held.setdefault(lang, []).append(line)
            sizes[lang] = sizes.get(lang, 0) + len(line)
            if sizes[lang] > BLOCK:
                yield flush(lang)
    for lang in [k for k, v in held.items() if v]:
        yield flush(lang)


@dataclass
class Filters:
    """``words``: bits per language at each position, a row for every 64 languages; ``rates``: how often a language's filter holds what was never put in;
    ``usual``: the language with most training text."""

    languages: list[str]
    bits: int
    words: np.ndarray
    rates: np.ndarray
    usual: int = 0

    def positions(self, found: np.ndarray) -> list[np.ndarray]:
        wide = found.astype(np.uint64) + np.uint64(1)
        shift = np.uint64(64 - self.bits)
        return [((wide * np.uint64(m)) >> shift).astype(np.int64) for m in _MULTIPLIERS[:PROBES]]

    def contained(self, found: np.ndarray, row: int = 0) -> np.ndarray:
        """The languages of each n-gram, as bits; those from 64 * ``row`` on."""
        return self._at(self.positions(found), row)

    def _at(self, positions: list[np.ndarray], row: int) -> np.ndarray:
        first, *rest = positions
        words = self.words[row]
        out = words[first]
        for p in rest:
            out = out & words[p]
        return out

    def identify(self, text: str | None) -> tuple[str, float]:
        data = np.frombuffer(normal(text), np.uint8)
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        hits = np.zeros(len(self.languages))
        n = len(data) - N + 1
        for i in range(0, n, BLOCK):
            positions = self.positions(grams(data[i:i + BLOCK + N - 1]))
            for row in range(len(self.words)):
                kinds, counts = np.unique(self._at(positions, row), return_counts=True)
                for k in range(row * WORD, min(row * WORD + WORD, len(hits))):
                    hits[k] += counts[(kinds >> np.uint64(k % WORD)) & np.uint64(1) == 1].sum()
        true = np.clip((hits - n * self.rates) / (1 - self.rates), 0, n)
        if not true.any():
            return self.languages[self.usual], 1 / len(self.languages)
        # hits that all languages share tell nothing: each n-gram's vote is what its language has over the least
        lead = true - true.min() + 1e-9
        best = int(np.argmax(true))
        return self.languages[best], float(lead[best] / lead.sum())


def learn(docs: DataFrame) -> Filters:
    """Filters from ``docs`` (lang, text); rows with a null language teach nothing."""
    known = docs.where("lang is not null").select("lang", "text")
    counts = known.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stage(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang")
    rows = totals.collect()  # one for each language
    languages = sorted(r.lang for r in rows)
    if not languages:
        return Filters([], MIN_BITS, np.zeros((0, 0), np.uint64), np.zeros(0))
    place = {lang: i for i, lang in enumerate(languages)}
    known = docs.sparkSession.createDataFrame([(r.lang, float(r.total), place[r.lang]) for r in rows], "lang string, total double, place int")
    shares = counts.join(F.broadcast(known), "lang").withColumn("share", F.col("n") / F.col("total"))
    n_rows = -(-len(languages) // WORD)
    bit = lambda e: F.call_function("shiftleft", F.lit(1).cast("long"), e.place % WORD)
    mask = lambda each, row: F.aggregate(F.filter(each, lambda e: F.floor(e.place / WORD) == row), F.lit(0).cast("long"), lambda m, e: m.bitwiseOR(bit(e)))
    masks = stage(shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("place", "share", "n")).alias("each"))
                  .withColumn("each", F.filter("each", lambda e: (e.share >= SHARE * F.col("top")) & (e.n > 1))).where(F.size("each") > 0)
                  .select("gram", F.array(*[mask("each", row) for row in range(n_rows)]).alias("masks")))
    distinct = masks.count()
    bits = min(MAX_BITS, max(MIN_BITS, int(np.ceil(np.log2(16 * max(1, distinct))))))
    empty = Filters(languages, bits, np.zeros((0, 0), np.uint64), np.zeros(0))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(empty.positions(batch["gram"].to_numpy()))
            mask = np.tile(batch["mask"].to_numpy(), PROBES)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mask)], names=["at", "mask"])

    words = np.zeros((n_rows, 1 << bits), np.uint64)
    for row in range(n_rows):
        of = masks.select("gram", F.get("masks", F.lit(row)).alias("mask")).where("mask != 0")
        # at most 2**MAX_BITS positions, whatever the input
        filled = of.mapInArrow(positions, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
        words[row, filled["at"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    rates = np.array([np.mean((words[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)) ** PROBES for i in range(len(languages))])
    return Filters(languages, bits, words, np.minimum(rates, 0.99), languages.index(rows[0].lang))


def _identify(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for batch in batches:
            found = [filters.identify(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array([x for x, _ in found], pa.string()),
                                              pa.array([y for _, y in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, filters: Filters, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred and score (the lead of its language among the leads of all)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    texts = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "text")
    return texts.mapInArrow(_identify(shared), "doc_id long, held_out boolean, lang_pred string, score double")
