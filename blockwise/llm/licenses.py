"""License scans: an exact set-similarity join between text blocks and notice templates.

A template is the set of a notice's words.  For a template of L words the blocks of a text are the windows of 2 L words that start at
every L-th word, so that any passage of L words stands whole in one; a block meets the template if at least ``PERCENT`` of 100
of the template's words are in it.  All such blocks are found:

* tokens are ordered by the number of documents that hold them, over all documents, rarest first;
* prefix filter: a template of n words of which m are needed shares one of its n - m + 1 rarest with every block that meets it, so
  only blocks around those are looked at;
* length filter: a block that holds fewer than m of the templates' words is passed over;
* positional filter: if the shared word is the i-th of the template's order, counted from 0, then no more than n - i words can be
  shared, nor more than the block has from that word's rank on;
* what is left is verified by the intersection.

A text is split into words once; what is kept of it are the places of words that templates or base phrases use, and all later steps
work on those, row by row.  Only the counts of the templates' words are shuffled and come to the driver; templates are configuration and
travel with the plan, as does the order.

Native expressions only.  Defined results: null and empty texts have no words, labels or places, and score 0; blocks that start
before the text do not exist; a notice whose words contain another's has both labels; the score is the largest share of a template's
words in a block that meets it, 0 without one; repeated documents each have a row; extra columns pass through, clashing ones are
replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.functions.literals import constant, let
from blockwise.llm.decontamination import words_of
from blockwise.session import stage

#: Per cent of a template's words that a block needs.
PERCENT = 90

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Labels and the wording of usual notices.
NOTICES = [
    ("all-rights-reserved", "All rights reserved"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
                   "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found")


@dataclass(frozen=True)
class Template:
    label: str
    #: Words of the notice, which set the length of its blocks.
    length: int
    tokens: frozenset[str]
    #: Words that a block needs.
    needed: int


def templates(notices: list[tuple[str, str]], percent: int = PERCENT) -> list[Template]:
    out = []
    for label, text in notices:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        if words:
            out.append(Template(label, len(words), frozenset(words), -(-percent * len(set(words)) // 100)))
    return out


def used_words(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``docs`` without its text, with ``n_words`` and ``hits``: place and word where the text has one of ``vocabulary``.  Written once."""
    known = lambda words: F.filter(F.transform(words, lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("p"), w.alias("w")))),
                                   lambda h: h.isNotNull())
    both = let(words_of(F.col("text")), lambda words: F.struct(F.size(words).alias("n_words"), known(words).alias("hits")))
    rest = [c for c in docs.columns if c not in ("text", *ADDED, "hits")]
    return stage(docs.select(*rest, both.alias("_read")).select(*rest, "_read.n_words", "_read.hits"))


def frequency_order(scanned: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, words that the fewest documents hold first."""
    words = scanned.select(F.explode(F.array_distinct(F.col("hits.w"))).alias("w"))
    count = {r.w: r.n for r in words.groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row for each word of the templates
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def matches(hits: Column, known: list[Template], order: list[str]) -> Column:
    """array<struct<template, label, block, from_word, share>>: the blocks that meet a template, once for each of both.

    A pair has many anchors: it is taken from the first place of the rarest of the words that both have.
    """
    rank = {w: i for i, w in enumerate(order)}
    prefixes = []
    for k, t in enumerate(known):
        tokens = sorted(t.tokens, key=rank.get)
        prefixes += [{"w": w, "k": k, "label": t.label, "i": i, "rank": rank[w] + 1, "len": t.length, "n": len(tokens), "need": t.needed}
                     for i, w in enumerate(tokens[:len(tokens) - t.needed + 1])]
    if not prefixes:
        return F.array().cast("array<struct<template:int,label:string,block:int,from_word:int,share:double>>")
    rare = constant(prefixes, "array<struct<w:string,k:int,label:string,i:int,rank:int,len:int,n:int,need:int>>")
    sets = constant([sorted(t.tokens, key=rank.get) for t in known], "array<array<string>>")
    ranks = constant(order, "array<string>")
    anchors = F.filter(F.transform(hits, lambda h, at: F.struct(h.p.alias("p"), h.w.alias("w"), at.alias("at"))),
                       lambda h: h.w.isin(sorted({x["w"] for x in prefixes})))

    def around(h: Column, q: Column, back: int) -> Column:
        """The block that starts ``back`` blocks before the anchor's, verified."""
        block = F.floor(h.p / q.len).cast("int") - back
        near = F.slice(hits, F.greatest(F.lit(1), h.at + 2 - 2 * q.len), 4 * q.len)
        inside = F.filter(near, lambda x: (x.p >= block * q.len) & (x.p < (block + 2) * q.len))

        def verified(tokens: Column) -> Column:
            later = F.size(F.filter(tokens, lambda w: F.array_position(ranks, w) >= q["rank"]))
            rarest = ~F.arrays_overlap(tokens, F.slice(F.get(sets, q.k), F.lit(1), q.i))
            shared = F.size(F.array_intersect(tokens, F.get(sets, q.k)))
            met = F.when((F.size(tokens) >= q.need) & (F.least(q.n - q.i, later) >= q.need) & rarest, shared)  # the filters before the intersection
            share = F.when(met >= q.need, met / q.n)
            return F.struct(q.k.alias("template"), q.label.alias("label"), block.alias("block"), (block * q.len).alias("from_word"), share.alias("share"))

        def looked_at(found: Column) -> Column:
            first = ~F.exists(found, lambda x: (x.w == h.w) & (x.p < h.p))
            return F.when(first, let(F.array_distinct(F.transform(found, lambda x: x.w)), verified))
        return F.when(block >= 0, let(inside, looked_at))

    each = F.transform(anchors, lambda h: F.transform(F.filter(rare, lambda q: q.w == h.w), lambda q: F.array(around(h, q, 0), around(h, q, 1))))
    return F.filter(F.flatten(F.flatten(each)), lambda m: m.share.isNotNull())


def places(hits: Column, phrase: str) -> Column:
    """The places where the words of ``phrase`` stand one after another."""
    words = phrase.split()

    def here(h: Column, at: Column) -> Column:
        found = h.w == words[0]
        for k, w in enumerate(words[1:], 1):
            found = found & F.coalesce((F.get(hits, at + k).w == w) & (F.get(hits, at + k).p == h.p + k), F.lit(False))
        return found
    return F.transform(F.filter(hits, here), lambda h: h.p)


def scan(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, phrases: dict[str, str] = PHRASES, percent: int = PERCENT) -> DataFrame:
    """``docs`` without its text and with n_words, n_base, first_word, last_word, base_labels, labels, score and ``found``, the
    blocks that meet a template (template, label, block, from_word, share)."""
    known = templates(notices, percent)
    vocabulary = sorted({w for t in known for w in t.tokens} | {w for p in phrases for w in p.split()})
    scanned = used_words(docs, vocabulary)
    order = frequency_order(scanned, vocabulary)
    hits, rest = F.col("hits"), [c for c in scanned.columns if c not in ("n_words", "hits")]
    spots = F.array(*[F.struct(F.lit(label).alias("label"), places(hits, p).alias("at")) for p, label in phrases.items()])
    joined = scanned.select(*rest, F.col("n_words").cast("long"), spots.alias("_spots"), matches(hits, known, order).alias("found"))
    starts, base = F.flatten("_spots.at"), F.transform(F.filter("_spots", lambda s: F.size(s.at) > 0), lambda s: s.label)
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return joined.select(*rest, "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
                         F.array_max(starts).cast("long").alias("last_word"), listed(base).alias("base_labels"),
                         listed(F.concat(base, F.col("found.label"))).alias("labels"),
                         F.coalesce(F.array_max("found.share"), F.lit(0.0)).alias("score"), "found")
