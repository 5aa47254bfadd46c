"""The ranked search against brute force, the sharing of its plan, and hard rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwise.llm import ranked_search

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


def brute(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = [(d, Counter(split(t))) for d, t in docs]
    texts = [(d, c, sum(c.values())) for d, c in texts if c]
    n_docs, n_terms, df = len(texts), sum(n for *_, n in texts), Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in texts:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if c[t])
            scored += [(-score, d is None, d or 0, d)] if score > 0 else []
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k=20):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("item", "rank", "score", "terms", "n")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("x"))
    return sorted(map(tuple, ranked_search.search(d, i, k).collect()), key=str)


@pytest.mark.parametrize("block", [400_000, 5])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(WORDS, n, p=np.arange(10, 0, -1) / 55))
    docs = [(d, text(rng.integers(1, 30))) for d in range(120)] + [(d, "Zeta, ZETA-eta!") for d in range(200, 230)]
    items = [(i, text(rng.integers(1, 9))) for i in range(30)] + [(7, "alpha beta gamma"), (8, "alpha beta gamma delta"), (8, "alpha beta")]
    assert run(spark, docs, items, 7) == brute(docs, items, 7)


def test_hard_rows(spark):
    docs = [(1, "One two, two É1"), (1, "One two, two É1"), (2, None), (3, ""), (None, "two x_y"), (None, None), (4, "...\n\t"), (5, "lorem ipsum " * 60_000 + "two"), (6, "é1")]
    items = [(1, "TWO"), (1, "TWO"), (2, None), (3, ""), (None, "x y two"), (4, "nowhere"), (5, "É1 é1"), (6, "ipsum " * 5000)]
    assert run(spark, docs, items) == brute(docs, items, 20)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_pieces(monkeypatch):
    data = b"ab cd  ef;GH \xc3\xa9x " * 50
    whole = ranked_search.count_terms(data)
    monkeypatch.setattr(ranked_search, "PIECE", 7)
    assert ranked_search.count_terms(data) == whole and ranked_search.count_terms(None) == Counter()


def test_shared_terms_are_one_class():
    of = ranked_search.plan({1: {b"a": 1, b"b": 2, b"c": 1, b"x": 1}, 2: {b"a": 1, b"b": 2, b"c": 3}, 3: {b"a": 1, b"b": 1}})
    # a and b stand in all items; the second b in 1 and 2; c in 1 and 2; x, and two more c, in one each
    kinds = {}
    for term, kind, times in of.feeds:
        kinds.setdefault(int(kind), set()).add((list(of.vocabulary)[term], int(times)))
    assert {frozenset(k) for k in kinds.values()} == {frozenset({(b"a", 1), (b"b", 1)}), frozenset({(b"b", 1), (b"c", 1)}),
                                                      frozenset({(b"x", 1)}), frozenset({(b"c", 2)})}
    assert len(of.nodes) == 1 + 4  # the root, the shared pair, the part of 1 and 2, and an end for each of these
