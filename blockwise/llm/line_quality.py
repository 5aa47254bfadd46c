"""Quality rules: a conditional random field marks each line of a text as content or boilerplate.

Lines (split at \\n, without those that have no word) are described by counts; Viterbi decoding gives the best labelling
of the whole text, so that a doubtful line goes with its neighbours.  A document is kept if the lines marked as content
hold at least ``CONTENT_SHARE`` of its words.  A base rule drops texts under 20 words, and those in which words of
repeated 8-word windows are over 30 %.

The field is trained on at most ``TRAINING_DOCUMENTS`` labelled documents (those with the smallest hashed ids): first
with the document's quality as the label of all its lines, then once more with the lines of poor documents labelled by
the first field, because these also hold ordinary lines.  Without both kinds of label, fixed weights are used.

Defined results: null and empty texts have no words and fail the base rule; repeated rows get the same verdict; a null
label is no label; of several labels of one id the larger counts; extra columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwise.llm.common import text_key
from blockwise.llm.crf import Crf, train
from blockwise.session import stage

#: Bound of the labelled sample that the field is trained on.
TRAINING_DOCUMENTS = 3000
CONTENT_SHARE = 0.5
WINDOW, LEAST_WORDS, REPEATED_PERCENT = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_CONTINUATION = bytes(range(0x80, 0xC0))
_KEEP_SYMBOLS = bytes(sorted(set(range(256)) - set(SYMBOLS)))
_KEEP_UPPER = bytes(sorted(set(range(256)) - set(range(65, 91))))
_KEEP_LOWER = bytes(sorted(set(range(256)) - set(range(97, 123))))
_KEEP_DIGITS = bytes(sorted(set(range(256)) - set(range(48, 58))))
FEATURES = 11
COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
           "base_failed": "boolean", "content_share": "double", "kept": "boolean"}


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight that are found at least twice, the first time included.

    Windows are named exactly: numbers of words give numbers of pairs, those of fours, those of eights.
    """
    if len(words) <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    names = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    for width in (1, 2, 4):
        _, names = np.unique(names[:-width] * np.int64(len(words) + 1) + names[width:], return_inverse=True)
    again = np.bincount(names)[names] > 1
    steps = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(steps[:-1])))


def line_features(line: bytes, words: list[bytes], repeated: bool) -> tuple[float, ...]:
    n = len(words)
    size = len(line)
    upper, lower = len(line.translate(None, _KEEP_UPPER)), len(line.translate(None, _KEEP_LOWER))
    return (1.0, min(n, 60) / 20, float(n <= 3), min(1.0, len(line.translate(None, _KEEP_SYMBOLS)) / n), min(1.0, line.count(b"|") / n),
            min(1.0, line.count(b"!") / n), float(upper > lower), 1 - len(set(words)) / n if n > 4 else 0.0,
            float(words[-1][-1:] in (b".", b"!", b"?", b":")), float(repeated), len(line.translate(None, _KEEP_DIGITS)) / size)


def read(text: bytes | None) -> tuple[tuple[int, ...], list[tuple[float, ...]], list[int]]:
    """((n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), features and words of each line with a word)."""
    text = text or b""
    seen: set[bytes] = set()
    features, sizes, everything, duplicates = [], [], [], 0
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            repeated = line in seen
            duplicates += repeated
            seen.add(line)
            features.append(line_features(line, words, repeated))
            sizes.append(len(words))
            everything += words
    base = (len(everything), len(text.translate(None, _SPACE + _CONTINUATION)), len(text.translate(None, _KEEP_SYMBOLS)), duplicates,
            repeated_words(everything))
    return base, features, sizes


#: Used where there is nothing to learn from: symbols, bars, shouting, repetition and repeated lines are boilerplate.
def default_field() -> Crf:
    weights = np.array([-2.0, -0.5, 0.5, 4.0, 6.0, 4.0, 2.0, 4.0, -0.5, 3.0, 1.0])
    return Crf(np.stack([np.zeros(FEATURES), weights], axis=1), np.array([[0.5, -0.5], [-0.5, 0.5]]), np.zeros(2))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        read_ = [[float(v) for f in read(t.as_py())[1] for v in f] for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["quality"], pa.array(read_, pa.list_(pa.float64()))], names=["quality", "features"])


def fit(docs: DataFrame, labels: DataFrame) -> Crf:
    """The field, from a bounded sample of labelled documents."""
    chosen = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_DOCUMENTS))
    sample = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").select("quality", "text")
    # the limit is for ids that many rows share; written first, as a collected limit would run a few tasks after the other
    rows = stage(sample.mapInArrow(_lines, "quality long, features array<double>").limit(2 * TRAINING_DOCUMENTS)).collect()
    texts = [(r.quality, np.array(r.features).reshape(-1, FEATURES)) for r in rows if r.features]
    if len({q for q, _ in texts}) < 2:
        return default_field()
    # rows come in any order: sums of floats should not depend on it
    texts.sort(key=lambda t: (t[0], len(t[1]), t[1].tobytes()))
    first = train([(x, np.full(len(x), int(q == 0))) for q, x in texts])
    again = [(x, np.array(first.decode((x @ first.emit).tolist())) if q == 0 else np.zeros(len(x), np.int64)) for q, x in texts]
    return train(again)


def _judge(field: Crf) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                base, features, sizes = read(t.as_py())
                n, repeated = base[0], base[4]
                failed = n < LEAST_WORDS or 100 * repeated > REPEATED_PERCENT * n
                marks = field.decode((np.array(features) @ field.emit).tolist()) if features else []
                share = sum(s for s, m in zip(sizes, marks) if m == 0) / n if n else 0.0
                rows.append((*base, failed, share, not failed and share >= CONTENT_SHARE))
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            new = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            old = {name: batch[name] for name in batch.schema.names if name != "text"}
            yield pa.RecordBatch.from_arrays([*old.values(), *new], names=[*old, *COLUMNS])
    return run


def judge(docs: DataFrame, field: Crf) -> DataFrame:
    """(doc_id, key, the base counts, base_failed, content_share, kept) per document; key stands for the text."""
    texts = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    schema = T.StructType([texts.schema["doc_id"], texts.schema["key"]])
    for name, kind in COLUMNS.items():
        schema = schema.add(name, kind)
    return texts.mapInArrow(_judge(field), schema)


def _keep(field: Crf) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = _judge(field)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch["text"].cast(pa.binary())], names=["text"])
            for verdict in judged(iter([texts])):
                yield batch.filter(verdict["kept"])
    return run


def keep(docs: DataFrame, field: Crf) -> DataFrame:
    """``docs`` without those that the rules reject."""
    return docs.mapInArrow(_keep(field), docs.schema)
