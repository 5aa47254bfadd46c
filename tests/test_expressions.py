"""Column expressions on literal edge cases and against plain Python."""

import random

from pyspark.sql import functions as F

from blockwise.functions import names, numbers
from blockwise.functions.text import _listed_words, _trie_pattern, contains_any, edit_budget, first_matching_list, first_matching_word, normalize_accents, similar_to_any, similarity
from blockwise.plans.profiles import audit_profiles
from blockwise.vocabulary import DEFAULT, KEYWORDS


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", expr(F.col("t")).alias("v"))
    return [r.v for r in sorted(rows.collect(), key=lambda r: r.i)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def like(a, b):
    if not a or not b:
        return 0.0
    a, b = a.lower(), b.lower()
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def noisy(words, n, seed):
    rnd = random.Random(seed)
    out = ["", " ", "x"]
    for _ in range(n):
        w = list(rnd.choice(words))
        for _ in range(rnd.randrange(4)):
            p = rnd.randrange(len(w) + 1)
            w[p:p + rnd.randrange(2)] = rnd.choice(["", "x", "é", "力", "1"])
        out.append("".join(w) + rnd.choice(["", "", " 12", "s"]))
    return out


def test_similar_to_any_matches_brute_force(spark):
    words = DEFAULT.words("ui_keywords", "power_labels", "kill_points_labels", "units")
    texts = noisy(words, 300, 1)
    got = column(spark, texts, lambda t: similar_to_any(t, words, 0.82))
    assert got == [any(like(t, w) > 0.82 for w in words) for t in texts]


def test_contains_and_first_match(spark):
    words = KEYWORDS["civilizations"]
    texts = noisy(words, 200, 2) + ["gChina", "SGERMANY!", "nothing", "N/A."]
    assert column(spark, texts, lambda t: contains_any(t, words)) == [any(w.lower() in t.lower() for w in words) for t in texts]
    want = [next((w for w in words if like(t, w) > 0.75 or w.lower() in t.lower()), None) for t in texts]
    assert column(spark, texts, lambda t: first_matching_word(t, words, 0.75)) == want
    marks = ["a.b", "c[1]", "N/A"]
    assert column(spark, ["xa.bx", "axb", "C[1]", "c1", "n/a"], lambda t: contains_any(t, marks)) == [True, False, True, False, True]


def test_first_matching_list(spark):
    lists = [["dead", "Killed in action"], ["units", "total units"], ["dead units", "heal"], ["heals"]]
    texts = sorted(set(noisy([w for ws in lists for w in ws], 150, 12))) + ["", "the dead units", "all units heal", "x" * 500, None]
    def want(t):
        hits = [i for i, ws in enumerate(lists, 1) if t and any(w.lower() in t.lower() or like(t, w) > 0.8 for w in ws)]
        return hits[0] if hits else None
    assert column(spark, texts, lambda t: first_matching_list(t, lists, 0.8)) == [want(t) for t in texts]


def test_edit_budget_is_the_threshold():
    for a in range(1, 20):
        for b in range(1, 20):
            k = edit_budget(a, b, 0.82)
            assert k < 0 or 1.0 - k / max(a, b) > 0.82
            assert 1.0 - (max(k, abs(a - b) - 1) + 1) / max(a, b) <= 0.82


def test_similarity_of_empty_and_missing(spark):
    assert column(spark, ["", "Power", None], lambda t: similarity(t, F.lit("power"))) == [0.0, 1.0, 0.0]


def test_metric_numbers(spark):
    texts = ["1,234", "1.5K", "2.5M", "12", "Dead 1,5OO", "43%", "", "1,234,567", "Units 7302", "2.5", "3.5", "|12|", "+7", "no"]
    assert column(spark, texts, numbers.suffixed_number) == [1234, 1500, 2500000, 12, 1500, 0, 0, 1234567, 7302, 2, 4, 12, 7, 0]
    assert column(spark, ["1,234,567"], lambda t: numbers.suffixed_number(t, fix_multi_group=False)) == [1234]


def test_other_numbers(spark):
    assert column(spark, ["1.5M", "2,063,935,270", "12K", "x"], numbers.grouped_long) == [15000000, 2063935270, 12000, 0]
    assert column(spark, ["ID: 193397278", "(1D: 10000005", "ID 9999999999", "12"], numbers.player_id) == [193397278, 10000005, 0, 0]
    assert column(spark, ["Owned: 2,086", "possui 12", "Total 4"], numbers.owned_quantity) == [2086, 12, 0]
    assert column(spark, ["875/1,000", "944 / 1.700", "x"], lambda t: numbers.bar_values(t)[1]) == [1000, 1700, 0]
    assert column(spark, ["-43,2%", "43%"], numbers.damage_percent) == [43.2, 0.0]
    assert column(spark, ["99999999999", "a1b2"], numbers.digits_only_int) == [0, 12]


def test_tags(spark):
    texts = ["[RE87]RoyalEmpire", "[ABC name x", "[ABCDrest", "AB rest of it", "toolongword x", "]odd", "[T 1]x"]
    got = column(spark, texts, names.split_tag_and_name)
    assert [tuple(g) for g in got] == [("RE87", "RoyalEmpire"), ("ABC", "name x"), ("ABCD", "rest"), ("AB", "rest of it"),
                                       ("--", "toolongword x"), ("--", "]odd"), ("T1", "x")]
    rigid = column(spark, ["[T12]Bob", "T123]Bob", "[ABCDBob", "[x", "ab"], names.split_tag_rigid)
    assert [tuple(g) for g in rigid] == [("T12", "Bob"), ("T123", "Bob"), ("ABCD", "Bob"), ("x", ""), ("ab", "")]


def test_accents(spark):
    assert column(spark, ["Péricles", "JOÃO", "Ç", "Ёлка", "Sức mạnh"], normalize_accents) == ["pericles", "joao", "c", "елка", "suc manh"]


def test_audit_swaps_power_and_kill_points(spark):
    row = spark.createDataFrame([(1, 5, " ", "", "x", 1_600_000_000, 7, "--"), (2, 0, "a", "t", "n", 5, 6, "c")],
                                "page_id int, id int, name string, alliance_tag string, alliance_name string, power bigint, kill_points bigint, civilization string")
    a, b = sorted(audit_profiles(row).collect(), key=lambda r: r.page_id)
    assert (a.power, a.kill_points, a.name, a.alliance_tag, a.success, a.complete) == (7, 1_600_000_000, "--", "--", True, False)
    assert not b.success


def test_many_words_are_searched_in_groups(spark):
    rnd = random.Random(21)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzñжあ-&^]0") for _ in range(rnd.randint(2, 4))) for _ in range(120)]
    assert "(?=[" in _trie_pattern(sorted(set(words)))
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzñжあ-&^]0") for _ in range(12)) for _ in range(300)] + words + [w[:-1] for w in words]
    want = [any(w in t for w in words) for t in texts]
    assert True in want and False in want
    assert column(spark, texts, lambda t: contains_any(t, words)) == want


def test_listed_words_are_decided_without_a_comparison(spark):
    """They have the list that the comparison gives, which need not be their own."""
    lists = [["units"], ["unit", "dead units"], ["unite", "gold", "bold"], ["golds"]]
    assert _listed_words(tuple(map(tuple, lists)), 0.75) == [(1, ["dead units", "unit", "unite", "units"]), (3, ["bold", "gold", "golds"])]
    texts = [w for words in lists for w in words] + ["Unit", "GOLDS", "goldy", "xyz"]
    assert column(spark, texts, lambda t: first_matching_list(t, lists, 0.75)) == [1, 1, 1, 1, 3, 3, 3, 1, 3, 3, None]
