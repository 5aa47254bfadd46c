"""Repair of damaged conversations by lightest derivations.

The rows of a conversation, in order of their turns, are edited until their roles read as an optional system row and then pairs of a
user's and an assistant's row.  Keep costs 0, rerole (to user or assistant) 2, delete 3, insert (an empty user's or assistant's row)
2; a truncated row that is not deleted costs 1 more; blank and duplicate rows are deleted.  Of the cheapest repairs the one whose
edits, written K, R, D and I, come first in ASCII order is taken.

This is a weighted deduction: an item (i, q) says that i rows are edited and the roles so far end in q.  An edit and an item give an
item, weighed by the superior function (cost + cost, audit + letter), and Knuth's agenda pops the least (cost, audit) first, so that
an item's first weight is its lightest, until the goal is popped.  The function is monotone: two derivations of an item with the same
cost use as many inserts, so neither audit is a prefix of the other.  The audit also fixes the roles, as each state admits one role.

A conversation may hold any share of the rows, so it is cut into segments of ``SEGMENT`` rows.  A segment's items (q, q') are derived
in its own task, and the conversation's from those: Prefix(k, q) and Segment(k, q, q') give Prefix(k + 1, q').  Rows are numbered in
pieces, duplicates found by counted digests, and texts shuffled once, to be replayed row by row with their edits.  Two things of a
conversation are in one task because they are one value: its audit, a letter an edit, and its digest, which has to be
computed in order; its rows pass through that as a stream.

Defined results: null roles, texts and parts of the damage key are one space; rows with a null ``conv_id`` are one conversation; a null
turn comes before all others; rows that share a turn are ordered by role and then by their texts' digests; the first character of a
role, as it is written, is its initial, and only ``s``, ``u`` and ``a`` fit; a conversation all of whose rows are lost has zeros, an
empty audit and the digest of nothing; repeated rows are duplicates; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.operators.ordered import sequence_number
from blockwise.session import stage

#: Rows of a conversation that one agenda derives.
SEGMENT = 256
BLANKS, NOT_BLANK = " \t\n\x0b\x0c\r", r"[^\x20\x09-\x0D]"
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FULL = {"u": "user", "a": "assistant"}
GOALS = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: A row's code: the initial of its role (o: any other), in upper case where it is truncated; a row that has to go.
GONE = "-"
#: Distinct segments whose derivations a worker remembers.
REMEMBERED = 20_000
Item = tuple[int, int]
Weight = tuple[int, str]


def admitted(state: int) -> str:
    """The initial of the role that may be inserted in a state."""
    return "a" if state == USER else "u"


def lightest(start: Item, deduce: Callable[[Item], Iterator[tuple[Item, int, str]]], goal: Callable[[Item], bool]) -> dict[Item, tuple[int, str, Item | None]]:
    """Knuth's agenda: items with their lightest weight and the item before them, as far as the first goal (the last entry) or all."""
    agenda: list[tuple[int, str, Item, Item | None]] = [(0, "", start, None)]
    final: dict[Item, tuple[int, str, Item | None]] = {}
    while agenda:
        cost, audit, item, before = heappop(agenda)
        if item in final:
            continue
        final[item] = cost, audit, before
        if goal(item):
            break
        for then, more, letters in deduce(item):
            if then not in final:
                heappush(agenda, (cost + more, audit + letters, then, item))
    return final


def edits(codes: str) -> Callable[[Item], Iterator[tuple[Item, int, str]]]:
    """The deductions over the rows of a segment."""
    def deduce(item: Item) -> Iterator[tuple[Item, int, str]]:
        i, q = item
        fitting = STEP[q, admitted(q)]
        yield (i, fitting), 2, INSERT
        if i == len(codes):
            return
        yield (i + 1, q), 3, DELETE
        code = codes[i]
        if code == GONE:
            return
        truncated = int(code.isupper())
        kept = STEP.get((q, code.lower()))
        if kept is not None:
            yield (i + 1, kept), truncated, KEEP
        yield (i + 1, fitting), 2 + truncated, REROLE
    return deduce


@lru_cache(REMEMBERED)
def segment(codes: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(q, q', cost, audit) of the segment items; of a conversation's last segment only the lightest goal for each q."""
    n, out = len(codes), []
    for q in [START] if first else range(4):
        final = lightest((0, q), edits(codes), lambda item: last and item[0] == n and item[1] in GOALS)
        ends = list(final.items())[-1:] if last else final.items()
        out += [(q, end, cost, audit) for (i, end), (cost, audit, _) in ends if i == n]
    return out


def conversation(parts: list[list[tuple[int, int, int, str]]]) -> tuple[int, str, list[tuple[int, str]]]:
    """Cost, audit and, for each segment, the state before it and its part of the audit."""
    known: list[dict[int, list[tuple[int, int, str]]]] = []
    for part in parts:
        known.append({})
        for q, end, cost, audit in part:
            known[-1].setdefault(q, []).append((end, cost, audit))

    def deduce(item: Item) -> Iterator[tuple[Item, int, str]]:
        k, q = item
        if k < len(known):
            for end, cost, audit in known[k].get(q, []):
                yield (k + 1, end), cost, audit
        elif q not in GOALS:  # the last segment was a full one, which does not know that it is the last
            yield (k, STEP[q, admitted(q)]), 2, INSERT

    final = lightest((0, START), deduce, lambda item: item[0] == len(known) and item[1] in GOALS)
    item, (cost, audit, before) = list(final.items())[-1]
    ends, pieces = audit, []
    while before is not None:
        upto = final[before][1]
        if before[0] < len(known):
            pieces.append((before[1], ends[len(upto):]))
            ends = upto
        before = final[before][2]
    return cost, audit, pieces[::-1]


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with a fault in one of four rows: lost, emptied, cut, repeated or said by the user."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", written("conv_id"), written("turn"))) % 20
    rows = turns.select("conv_id", "turn", written("role").alias("role"), written("text").alias("text"), fault.alias("fault")).where("fault != 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def key_of(conv_id: Column) -> Column:
    """A conversation's id as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def prepared(turns: DataFrame) -> DataFrame:
    """The rows written once, each with an id, its conversation's key and what its text tells."""
    rows = turns.select(key_of(F.col("conv_id")).alias("c"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text"), F.lit(" ")).alias("text"))
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    return stage(rows.select("*", F.monotonically_increasing_id().alias("id"), F.unhex(F.sha2("text", 256)).alias("digest"),
                             (~F.col("text").rlike(NOT_BLANK)).alias("blank"), (~last.isin(".", "!", "?")).alias("open")))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``pos`` (from 1 in each conversation), ``duplicate`` and ``truncated``; texts are left out.  Written once."""
    rows = rows.select("c", "id", "turn", "role", "digest", "blank", "open", F.coalesce("turn", F.lit(-2**63)).alias("at"), F.col("turn").isNotNull().alias("told"))
    placed = sequence_number(rows, ["c"], "at", "pos", ties=["told", "role", "digest", "id"]).drop("at", "told")
    # one row for each distinct row: where it is met most, a hot side is split
    first = placed.groupBy("c", "role", "digest").agg(F.min("pos").alias("first"))
    marked = placed.join(first, ["c", "role", "digest"])
    again = ~F.col("blank") & (F.col("pos") > F.col("first"))
    return stage(marked.select("c", "id", "turn", "role", "pos", "blank", again.alias("duplicate"),
                               (F.col("open") & ~F.col("blank") & ~again).alias("truncated")))


def codes(places: DataFrame, width: int) -> DataFrame:
    """Per segment: c, k, codes and initials (a letter a row)."""
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    code = F.when(F.col("blank") | F.col("duplicate"), F.lit(GONE)).when(F.col("truncated"), F.upper(initial)).otherwise(initial)
    rows = places.select("c", F.floor((F.col("pos") - 1) / width).cast("long").alias("k"), F.struct("pos", code.alias("code"), initial.alias("initial")).alias("r"))
    each = rows.groupBy("c", "k").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return each.select("c", "k", F.array_join("r.code", "").alias("codes"), F.array_join("r.initial", "").alias("initials"))


def illegal_pairs(initials: str) -> int:
    return sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


PART = "array<struct<q:int,end:int,cost:long,audit:string>>"


def _derive(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("q", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [segment(c, k == 0, len(c) < width) for c, k in zip(batch["codes"].to_pylist(), batch["k"].to_pylist())]
            parts = [[dict(zip(("q", "end", "cost", "audit"), x)) for x in part] for part in found]
            initials = batch["initials"].to_pylist()
            yield pa.RecordBatch.from_arrays([batch["c"], batch["k"], pa.array(parts, kind), pa.array([illegal_pairs(i) for i in initials], pa.int64()),
                                              pa.array([i[:1] + i[-1:] for i in initials], pa.string())], names=["c", "k", "part", "illegal", "ends"])
    return run


def _combine(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("q", pa.int32()), ("audit", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, audits, illegal, pieces = [], [], [], []
            for segments in batch["segments"].to_pylist():
                cost, audit, used = conversation([[(x["q"], x["end"], x["cost"], x["audit"]) for x in s["part"]] for s in segments])
                costs.append(cost)
                audits.append(audit)
                illegal.append(sum(s["illegal"] for s in segments) + sum(illegal_pairs(a["ends"][1] + b["ends"][0]) for a, b in zip(segments, segments[1:])))
                pieces.append([{"pos": k * width + 1, "q": q, "audit": piece} for k, (q, piece) in enumerate(used)])
            yield pa.RecordBatch.from_arrays([batch["c"], pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(illegal, pa.int64()),
                                              pa.array(pieces, kind)], names=["c", "cost", "audit", "illegal", "pieces"])
    return run


def derivations(places: DataFrame, width: int = SEGMENT) -> DataFrame:
    """Per conversation: c, cost, audit, illegal, pieces (the edits from row ``pos`` on, in state ``q``).  Written once."""
    parts = codes(places, width).mapInArrow(_derive(width), f"c string, k long, part {PART}, illegal long, ends string")
    grouped = parts.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("k", "illegal", "ends", "part"))).alias("segments"))
    return stage(grouped.mapInArrow(_combine(width), "c string, cost long, audit string, illegal long, pieces array<struct<pos:long,q:int,audit:string>>"))


class Replay:
    """Applies edits to rows that arrive in order."""

    def __init__(self):
        self.state, self.left, self.at = START, "", 0

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.left[self.at:self.at + 1] == INSERT:
            role = admitted(self.state)
            self.state, self.at = STEP[self.state, role], self.at + 1
            yield FULL[role], ""

    def piece(self, state: int, audit: str) -> Iterator[tuple[str, str]]:
        """Starts a segment; yields what the segment before still inserts."""
        yield from self.inserts()
        self.state, self.left, self.at = state, audit, 0

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        letter, self.at = self.left[self.at], self.at + 1
        if letter == DELETE:
            return
        initial = role[:1] if letter == KEEP else admitted(self.state)
        self.state = STEP[self.state, initial]
        yield (role if letter == KEEP else FULL[initial]), text


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, str | None]]:
    """(conversation, role, text) of each repaired row, and (conversation, None, None) at its end."""
    now, replay = None, Replay()
    for batch in batches:
        cut = [batch[c] for c in ("c", "q", "role", "text")]
        for i in range(batch.num_rows):
            c, q, role, text = (x[i].as_py() for x in cut)
            if c != now:
                if now is not None:
                    yield from ((now, *r) for r in replay.inserts())
                    yield now, None, None
                now, replay = c, Replay()
            yield from ((c, *r) for r in (replay.row(role, text) if q is None else replay.piece(q, text)))
    if now is not None:
        yield from ((now, *r) for r in replay.inserts())
        yield now, None, None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, digest, lines = [], hashlib.sha256(), 0
    for c, role, text in _replayed(batches):
        if role is not None:
            digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
            lines += 1
            continue
        done.append((c, digest.hexdigest(), lines))
        digest, lines = hashlib.sha256(), 0
        if len(done) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["c", "repaired_sha256", "n_repaired"])
            done = []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["c", "repaired_sha256", "n_repaired"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, at, size = [], 0, 0
    for c, role, text in _replayed(batches):
        if role is None:
            at = 0
            continue
        rows.append((c, at, role, text))
        at, size = at + 1, size + len(text)
        if len(rows) == 10_000 or size > 16_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["c", "turn", "role", "text"])
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["c", "turn", "role", "text"])


def _in_order(rows: DataFrame, places: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's edits and rows in one stream: a segment's edits stand before its rows."""
    given = found.select("c", F.inline("pieces")).select("c", "pos", F.col("q"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    told = rows.select("id", "text").join(places.select("id", "c", "pos", "role"), "id")
    told = told.select("c", F.col("pos").cast("long").alias("pos"), F.lit(None).cast("int").alias("q"), "role", "text")
    return given.unionByName(told).repartition("c").sortWithinPartitions("c", "pos", F.col("q").isNull())


def repaired(turns: DataFrame, width: int = SEGMENT) -> DataFrame:
    """The repaired rows: conv_id, turn (from 0, dense), role, text."""
    rows = prepared(turns)
    places = numbered(rows)
    out = _in_order(rows, places, derivations(places, width)).mapInArrow(_texts, "c string, turn long, role string, text string")
    return out.join(turns.select("conv_id", key_of(F.col("conv_id")).alias("c")).distinct(), "c").select("conv_id", "turn", "role", "text")


def report(turns: DataFrame, given: DataFrame | None = None, width: int = SEGMENT) -> DataFrame:
    """Per conversation of ``given`` (by default those of ``turns``): conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256, n_repaired."""
    rows = prepared(turns)
    places = numbered(rows)
    found = derivations(places, width)
    digests = _in_order(rows, places, found).mapInArrow(_digests, "c string, repaired_sha256 string, n_repaired long")
    counted = places.groupBy("c").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
                                      *[F.sum(F.col(x).cast("long")).alias(x) for x in ("blank", "duplicate", "truncated")])
    all_of = (turns if given is None else given).select("conv_id", key_of(F.col("conv_id")).alias("c")).distinct()
    out = all_of.join(counted, "c", "left").join(found.drop("pieces"), "c", "left").join(digests, "c", "left")
    return out.select("conv_id", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
                      F.coalesce("n_repaired", F.lit(0)).cast("long").alias("n_repaired"))
