"""Conversation repair against plain enumeration, over segments of any width, and hard rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from blockwise.llm import conversation_repair as repair

BLANKS = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL = {"u": "user", "a": "assistant"}


def damaged(turns):
    for c, t, role, text in turns:
        written = [" " if x is None else x for x in (c, t, role, text)]
        fault = zlib.crc32(f"{written[0]}:{written[1]}".encode()) % 20
        role, text = written[2:]
        text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
        yield from [] if fault == 0 else [(c, t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation's rows, by a table over all prefixes."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, marks = set(), []
    for _, _, role, text in rows:
        said = text.strip(BLANKS)
        marks.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    def spread(table):
        for _ in range(3):
            for q, (cost, audit, lines) in list(table.items()):
                w = "a" if q == "u" else "u"
                if w not in table or (cost + 2, audit + "I") < table[w][:2]:
                    table[w] = cost + 2, audit + "I", [*lines, FULL[w] + ":"]
        return table
    table = {"": (0, "", [])}
    for (_, _, role, text), mark in zip(rows, marks):
        after = {}
        def offer(q, *entry):
            if q not in after or entry[:2] < after[q][:2]:
                after[q] = entry
        for q, (cost, audit, lines) in spread(table).items():
            offer(q, cost + 3, audit + "D", lines)
            if mark not in ("blank", "duplicate"):
                more, w = int(mark == "truncated"), "a" if q == "u" else "u"
                if (q, role[:1]) in NEXT:
                    offer(NEXT[q, role[:1]], cost + more, audit + "K", [*lines, f"{role}:{text}"])
                offer(w, cost + 2 + more, audit + "R", [*lines, f"{FULL[w]}:{text}"])
        table = after
    cost, audit, lines = min(v for q, v in spread(table).items() if q in ("", "a"))
    turns = [t for _, t, _, _ in rows if t is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[marks.count(x) for x in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows, ids):
    return {c: brute([r for r in rows if r[0] == c]) for c in ids}


def got(df):
    return {r.conv_id: tuple(r)[1:9] for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("width", [3, 256])
def test_brute_force(spark, width):
    rng, turns = random.Random(5), []
    for c in range(60):
        for t in range(rng.randint(1, 14)):
            turns.append((c, t + (rng.random() < 0.1), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "usr"]),
                          rng.choice(["Yes.", "No!", "so", "Really? ", "well,", " ", "A longer one.\n", f"{c}.{t}?"])))
    df = spark.createDataFrame(turns, SCHEMA)
    assert got(repair.report(repair.damage(df), df, width)) == expected(list(damaged(turns)), {t[0] for t in turns})


def test_one_conversation_of_many_rows(spark):
    rows = [(1, t, ("user", "assistant")[t % 2] if t % 97 else "tool", f"{t}" + (".", "")[t % 31 == 0]) for t in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(repair.report(df)) == {1: brute(rows)}
    fixed = repair.repaired(df).orderBy("turn").collect()
    assert [r.turn for r in fixed] == list(range(len(fixed)))
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in fixed).encode()).hexdigest() == brute(rows)[-1]


def test_hard_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (2, None, None, None), (None, 3, "user", "a!"), (None, None, "assistant", "b"),
            (3, 0, "", ""), (3, 5, "assistant", "x" * 300_000), (3, 5, "assistant", " " * 300_000 + "."), (4, 0, "system", "s."), (5, -7, "User", "é ."),
            (5, 9, "user", "a\x00?"), (6, None, "user", "q?"), (6, None, "assistant", "q?")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit("x") for x in ("c", "pos", "k", "id", "fault", "copy", "digest")})
    told = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got(repair.report(df)) == expected(told, {r[0] for r in rows})
    assert got(repair.report(repair.damage(df), df, 1)) == expected(list(damaged(rows)), {r[0] for r in rows})
    none = spark.createDataFrame([], SCHEMA)
    assert repair.report(none).count() == 0 and repair.repaired(none).count() == 0
    lost = spark.createDataFrame([(9, 1, "user", "x")], SCHEMA)
    assert got(repair.report(none, lost)) == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_agenda_stops_at_the_goal():
    popped = []
    def deduce(item):
        popped.append(item)
        return repair.edits("uauaua")(item)
    final = repair.lightest((0, repair.START), deduce, lambda item: item[0] == 6 and item[1] in repair.GOALS)
    assert list(final.values())[-1][:2] == (0, "KKKKKK") and len(popped) == 6
