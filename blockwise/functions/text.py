"""Text comparison as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockwise.functions.literals import constant, let, word_array


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, on lower-cased text; 0 when either side is empty."""
    la, lb = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(la), F.length(lb))
    score = F.lit(1.0) - F.levenshtein(la, lb).cast("double") / longest
    return F.when((F.length(a) > 0) & (F.length(b) > 0), score).otherwise(F.lit(0.0))


def edit_budget(len_a: int, len_b: int, threshold: float, strict: bool = True) -> int:
    """Largest edit distance whose similarity still passes the threshold, -1 if none does."""
    longest = max(len_a, len_b)
    passing = [d for d in range(abs(len_a - len_b), longest + 1)
               if (1.0 - d / longest > threshold if strict else 1.0 - d / longest >= threshold)]
    return passing[-1] if passing else -1


@lru_cache(maxsize=256)
def _words_by_length(words: tuple[str, ...], threshold: float) -> list[list[dict]]:
    """At index n the words that can pass against a text of length n, with their edit budgets."""
    lowered = sorted({w.lower() for w in words if w})
    longest = max((len(w) for w in lowered), default=0)
    table: list[list[dict]] = [[]]
    for n in range(1, int(longest / threshold) + 2):
        fits = ((w, edit_budget(n, len(w), threshold)) for w in lowered)
        table.append([{"w": w, "k": k} for w, k in fits if k >= 0])
    return table


def _few_digits(text: Column, words: list[str], threshold: float) -> Column:
    """False where a text has more digits than edits allowed, so that none of ``words``, if they have none, resembles it."""
    if any(c.isdigit() for w in words for c in w):
        return F.lit(True)
    size = F.length(text)
    digits = size - F.length(F.translate(text, "0123456789", ""))
    return digits <= size * ((1.0 - threshold) / threshold) + 1e-9


def similar_to_any(text: Column, words: list[str], threshold: float) -> Column:
    """True where the text is more similar than ``threshold`` to one of the words.

    The words are a checked, bounded list, so they travel as a literal and no join is needed.  Only
    words of a workable length are compared, each with the early-exit form of the edit distance.
    """
    by_length = constant(_words_by_length(tuple(words), threshold), "array<array<struct<w:string,k:int>>>")
    lowered = F.lower(text)
    hit = let(lowered, lambda low: F.exists(F.get(by_length, F.length(low)),
                                            lambda x: F.call_function("levenshtein", low, x["w"], x["k"]) >= 0))
    return F.coalesce(F.when(_few_digits(lowered, words, threshold), hit), F.lit(False))


def _literal(word: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", word)


#: Branches of a pattern that are tried one by one.
_BRANCHES = 4


def _trie_pattern(words: list[str]) -> str:
    """A pattern for any of ``words`` that tries what they begin alike once.

    Many branches stand in groups behind a look at the next letter, so that only one group's are tried.
    """
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(w[1:])
    branches = [(first, _literal(first) + ("" if "" in tails else _trie_pattern(tails))) for first, tails in sorted(by_first.items())]

    def any_of(some: list[tuple[str, str]]) -> str:
        if len(some) <= _BRANCHES:
            return some[0][1] if len(some) == 1 else f"(?:{'|'.join(p for _, p in some)})"
        size = -(-len(some) // _BRANCHES)
        groups = [some[i:i + size] for i in range(0, len(some), size)]
        return "(?:" + "|".join(f"(?=[{''.join(_literal(c) for c, _ in g)}]){any_of(g)}" for g in groups) + ")"
    # a class of letters beyond ASCII is dear to test, so they are kept apart
    near, far = ([b for b in branches if b[0].isascii() == kind] for kind in (True, False))
    if not near or not far or len(branches) <= _BRANCHES:
        return any_of(near) if not far else f"(?:{'|'.join(p for _, p in branches)})"
    letters = "".join(_literal(c) for c, _ in near)
    return f"(?:(?=[{letters}]){any_of(near)}|(?=[^\\x00-\\x7F])(?:{'|'.join(p for _, p in far)}))"


def contains_any(text: Column, words: list[str]) -> Column:
    """True where the text contains one of the words, ignoring case."""
    distinct = sorted({w.lower() for w in words if w})
    # a word that contains another listed word can never decide the answer
    needed = [w for w in distinct if not any(o != w and o in w for o in distinct)]
    if not needed:
        return F.lit(False)
    # one pattern: a single pass in generated code
    return F.coalesce(F.lower(text).rlike(_trie_pattern(needed)), F.lit(False))


def matches_any(text: Column, words: list[str], threshold: float) -> Column:
    """Contains one of the words, or is similar to one of them."""
    return contains_any(text, words) | similar_to_any(text, words, threshold)


@lru_cache(maxsize=64)
def _ranked_by_length(lists: tuple[tuple[str, ...], ...], threshold: float) -> list[list[dict]]:
    """At index n the words of all lists that can pass against a text of length n, with their budgets and first lists."""
    rank: dict[str, int] = {}
    for i, words in enumerate(lists, 1):
        for w in words:
            rank.setdefault(w.lower(), i)
    table = _words_by_length(tuple(rank), threshold)
    return [[{**x, "rank": rank[x["w"]]} for x in fits] for fits in table]


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@lru_cache(maxsize=64)
def _listed_words(lists: tuple[tuple[str, ...], ...], threshold: float) -> list[tuple[int, list[str]]]:
    """The listed words by the number of the first list with a word that they contain or resemble."""
    ranked = _ranked_by_length(lists, threshold)
    found: dict[int, list[str]] = {}
    for word in sorted({w.lower() for words in lists for w in words if w}):
        alike = [x["rank"] for x in (ranked[len(word)] if len(word) < len(ranked) else []) if _distance(word, x["w"]) <= x["k"]]
        held = [i for i, words in enumerate(lists, 1) if any(w and w.lower() in word for w in words)]
        found.setdefault(min(alike + held), []).append(word)
    return sorted(found.items())


def first_matching_list(text: Column, lists: list[list[str]], threshold: float) -> Column:
    """Number (from 1) of the first list with a word that the text contains or resembles, NULL if there is none.

    A text is compared once with each word of a workable length, whatever number of lists has it, and searched once for all
    words together; only a text that contains one is looked at list by list.  A text that is a listed word itself is not compared.
    """
    key = tuple(map(tuple, lists))
    table = constant(_ranked_by_length(key, threshold), "array<array<struct<w:string,k:int,rank:int>>>")
    lowered = F.lower(text)
    every = [w for words in lists for w in words]
    alike = F.when(_few_digits(lowered, every, threshold), let(lowered, lambda low: F.array_min(F.transform(
        F.get(table, F.length(low)), lambda x: F.when(F.call_function("levenshtein", low, x["w"], x["k"]) >= 0, x["rank"])))))
    held = F.when(contains_any(text, lists[0]), 1)
    for i, words in enumerate(lists[1:], 2):
        held = held.when(contains_any(text, words), i)
    found = F.least(alike, F.when(contains_any(text, every), held))
    listed = _listed_words(key, threshold)
    if not listed:
        return found
    first, *others = [(lowered.isin(words), F.lit(i)) for i, words in listed]
    known = F.when(*first)
    for case in others:
        known = known.when(*case)
    return known.otherwise(found)


def first_matching_word(text: Column, words: list[str], threshold: float) -> Column:
    """The first word in list order that the text resembles or contains, NULL if there is none."""
    hits = F.filter(word_array(words), lambda w: (similarity(text, w) > threshold) | F.contains(F.lower(text), F.lower(w)))
    return F.get(hits, F.lit(0))


def _accent_map() -> tuple[str, str]:
    """Lower-case letters of the Latin, Greek and Cyrillic blocks that decompose to a base letter plus marks."""
    source, target = [], []
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        base = "".join(p for p in parts if unicodedata.category(p) != "Mn")
        if ch == ch.lower() and base != ch and len(base) == 1:
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_map()


def normalize_accents(text: Column) -> Column:
    """Lower-cased text without accents or combining marks."""
    return F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"\p{Mn}", "")


def sorted_tokens(text: Column) -> Column:
    """The words of a text in alphabetical order, separated by single spaces."""
    return F.array_join(F.array_sort(F.split(F.trim(text), r"\s+")), " ")


def entity_score(a: Column, b: Column) -> Column:
    """0-100: the better of the plain and the word-order-free edit ratio of two normalised texts."""
    plain = similarity(a, b)
    reordered = similarity(sorted_tokens(a), sorted_tokens(b))
    return F.lit(100.0) * F.greatest(plain, reordered)
