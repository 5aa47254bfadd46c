"""The license join against all pairs of blocks and templates, its filters, and hard rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from blockwise.llm import licenses

NOTICES = [("x", "red green blue red"), ("y", "one two three four five six seven eight nine ten the of"), ("z", "the of the a"), ("x", "green the"), ("none", "...")]
PHRASES = {"red green": "rg", "the of the": "tot", "one": "single"}
SCHEMA = "doc_id long, text string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, percent=60):
    words, found = words_of(text), []
    for k, t in enumerate(licenses.templates(NOTICES, percent)):
        for b in range(-(-len(words) // t.length)):
            shared = t.tokens & set(words[b * t.length:(b + 2) * t.length])
            if 100 * len(shared) >= percent * len(t.tokens):
                found.append((k, t.label, b, b * t.length, len(shared) / len(t.tokens)))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    base = {label for _, label in at}
    return (len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted(base)),
            ",".join(sorted(base | {f[1] for f in found})), max([f[4] for f in found], default=0.0), sorted(found))


def run(df, percent=60):
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return [(r.doc_id, *(r[n] for n in names), sorted(map(tuple, r.found))) for r in licenses.scan(df, NOTICES, PHRASES, percent).collect()]


@pytest.mark.parametrize("percent", [60, 100])
def test_brute_force(spark, percent):
    rng = random.Random(2)
    kinds = "red green blue one two three four five six seven eight nine ten".split() + ["the", "of", "a"] * 4 + ["word"] * 12
    rows = [(d, ", ".join(rng.choice(kinds) for _ in range(rng.randint(0, 60)))) for d in range(150)]
    rows += [(900, "One two three four, five six seven eight nine; TEN the of!"), (901, "one " * 20 + "two three four five six")]
    got = run(spark.createDataFrame(rows, SCHEMA), percent)
    assert sorted(got) == sorted((d, *brute(t, percent)) for d, t in rows)


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (None, "red green"), (3, "Red\x00GREEN é blue"), (3, "Red\x00GREEN é blue"), (None, None), (4, "the of a " * 30_000), (5, " \t\n"), (6, "réd greens")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("hits", "w", "p", "labels", "found", "n_words", "other")})
    got = run(df)
    assert sorted(got, key=str) == sorted([(d, *brute(t)) for d, t in rows], key=str)
    assert "other" in licenses.scan(df).columns
    assert licenses.scan(df.limit(0)).count() == 0
    assert [r.labels for r in licenses.scan(df, [], PHRASES).where("doc_id = 3").collect()] == ["rg"] * 2


def test_usual_notices(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.",
             "Released under the MIT License.", "All rights reserved.", "We were licensed under a public version of rights."]
    got = licenses.scan(spark.createDataFrame(list(enumerate(f"Some prose first.\n{t} And more prose." for t in texts)), SCHEMA)).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["cc-by,cc-by-nc-4.0", "gpl,gpl-3.0", "apache-2.0", "mit", "all-rights-reserved,reserved", ""]
    assert [r.score for r in got] == [1.0] * 5 + [0.0]


def test_native(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "all rights reserved")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
