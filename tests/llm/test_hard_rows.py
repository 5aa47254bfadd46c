"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blockwise.llm import (chat, context_mixing, decontamination, language, line_quality, mixing, pii, pu_quality, simhash, warc)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, name string, found string, target string"
LONG = "lorem ipsum dolor " * 40_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, and then it sleeps. " * 3, "en", "a", 1, *"kznft"),
    (1, "The quick brown fox jumps over the lazy dog, and then it sleeps. " * 3, "en", "a", 1, *"kznft"),
    (2, None, None, None, None, *[None] * 5),
    (3, "", "en", "a", 0, *"kznft"),
    (None, "no id here\nbut\ttwo lines", "en", None, 5, *"kznft"),
    (None, None, None, None, None, *[None] * 5),
    (4, LONG, "de", "b", len(LONG), *"kznft"),
    (5, "x" * 300_000, "fr", "b", 300_000, *"kznft"),
    (6, " \t\n\x0b\x0c\r ", "fr", "b", 7, *"kznft"),
    (7, "Ünïcödé  no-break é\x00\x1f ***", "fr", "b", 3, *"kznft"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "lazy dog"), (2, None), (3, ""), (4, "lorem ipsum dolor " * 6), (4, "lazy dog")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, None, 0), (None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")


def test_mixing(docs, none):
    got = mixing.shares(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 2 * r.size for r in got)
    assert {r.source: r.source_size for r in got} == {"a": 78, "b": 120_005, None: 6}
    again = mixing.shares(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert {"key", "name", "found"} <= set(got[0].asDict()) and "repetition" in mixing.mix(docs).columns
    assert mixing.mix(none).count() == 0


def test_given_weights(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate(["a", "b", "c", "d", None] * 40)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("b", 1.0), ("c", 0.0), (None, None), ("z", 5.0)], "source string, weight double")
    got = {r.source: (r.n, r.target, r.taken) for r in mixing.shares(docs, weights, share=1.0).groupBy("source").agg(
        F.count("*").alias("n"), F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert got == {"a": (40, 600.0, 600), "b": (40, 200.0, 200), "c": (40, 0.0, 0), "d": (40, 0.0, 0), None: (40, 0.0, 0)}
    nothing = mixing.shares(docs, weights.where("weight = 0"))
    assert nothing.count() == 200 and nothing.agg(F.sum("taken")).first()[0] == 0


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, "assistant", None), (None, 1, None, "</turn> \\ <turn x>"), (2, 1, "a>b\\g", "<\\\\turn"),
             (3, 0, "assistant", "a" * 500_000), (4, 0, "user", "")]
    got = chat.expand(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("answers", F.lit(1)))
    read = got.select("conv_id", "target_turn", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    rows = {(r.conv_id, r.target_turn): ([tuple(x) for x in r.t], r.loss) for r in read.collect()}
    assert rows == {
        (1, 1): ([("assistant", "")], ""), (1, None): ([("assistant", ""), ("user", "hi"), ("user", "hi")], None),
        (None, None): ([("", "</turn> \\ <turn x>")], None), (2, None): ([("a>b\\g", "<\\\\turn")], None),
        (3, 1): ([("assistant", "a" * 500_000)], "a" * 500_000), (4, None): ([("user", "")], None)}
    assert chat.expand(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pii(docs, none):
    got = pii.pseudonymise(docs, "k")
    assert got.columns == [*docs.columns, "n_pii"]
    assert sorted(map(str, got.drop("n_pii").collect())) == sorted(map(str, docs.collect()))
    assert pii.pseudonymise(none, "k").count() == 0


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {2, 3, 6, None} and {r.component_id for r in zero} == {2}
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "5", "7", "None"]
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0


def test_context_mixing(docs, none):
    got = context_mixing.score(docs).collect()
    assert len(got) == len(ROWS) and all(r.score < 0 and r.base_score < 0 for r in got)
    assert {(r.n_tokens, round(r.score, 9)) for r in got if r.doc_id in (2, 3, 6)} == {(1, round(next(r.score for r in got if r.doc_id == 3), 9))}
    assert len({(r.score, r.n_known) for r in got if r.doc_id == 1}) == 1
    assert context_mixing.score(none).count() == 0


def test_warc(spark):
    pages = [(1, "http://a/b c\n", "x"), (1, "http://a", "x"), (0, None, "x"), (2, "u", None), (None, "v", "x"), (None, "v", "y"), (None, "v", "y"), (3, "w", ""), (4, "w", "é" * 900_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("kind", F.lit("?"))
    streams, members = warc.new_folder(df, "t-streams"), warc.new_folder(df, "t-members")
    got = warc.read(warc.normalise(warc.write(df, streams), streams, members), members).collect()
    kinds = Counter((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter([("1", 1, "revisit", 0), ("1", 1, "revisit", 0), ("0", 1, "response", None), ("2", 0, "response", None), ("None", 1, "revisit", 0),
                            ("None", 1, "response", None), ("None", 1, "revisit", None), ("3", 0, "revisit", 2), ("4", 1_800_000, "response", None)])
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.normalise(warc.write(empty, streams), streams, members), members).count() == 0


@pytest.mark.parametrize("harm, kept", [("pad", 6), ("cut", 3), ("zeros", 6), ("length", 5), ("text", 0)])
def test_damaged_archives(spark, tmp_path, harm, kept):
    records = [warc.record(i, "u", bytes([65 + i]) * 50_000, hashlib.sha1(bytes([65 + i]) * 50_000).hexdigest(), "response", None) for i in range(6)]
    if harm == "length":
        records[5] = records[5].replace(b"Content-Length:", b"Content-Size:")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    first = b"".join(packer.compress(r) for r in records[:3]) + packer.flush(zlib.Z_FULL_FLUSH)
    whole = first + b"".join(packer.compress(r) for r in records[3:]) + packer.flush()
    data = {"pad": whole + bytes(3000), "cut": first, "zeros": whole + bytes(1) + zlib.compress(b"", wbits=31), "length": whole, "text": b"no gzip"}[harm]
    (tmp_path / "a").write_bytes(data)
    archives, target = spark.createDataFrame([("a",)], "archive string"), warc.new_folder(spark.range(0), "t-members")
    index = warc.normalise(archives, f"file://{tmp_path}", target, strict=False)
    assert [r.record_type for r in index.orderBy("offset", F.desc("length")).collect()] == ["response"] * kept + ["damaged"] * (harm in ("cut", "length", "text"))
    assert sorted(r.page_id for r in warc.read(index, target).collect()) == list(range(kept))
    if harm in ("cut", "length", "text"):
        with pytest.raises(Exception, match="DamagedArchive: a: "):
            warc.normalise(archives, f"file://{tmp_path}", target)


def test_line_quality(docs, none, labels):
    field = line_quality.fit(docs, labels)
    got = line_quality.judge(docs, field).collect()
    assert len(got) == len(ROWS) and all(r.base_failed for r in got if r.doc_id != 1) and not any(r.kept for r in got if r.base_failed)
    assert [(r.n_words, r.n_repeat_words) for r in got if r.doc_id == 4] == [(120_000, 120_000)]
    assert line_quality.keep(docs, field).columns == docs.columns
    assert line_quality.judge(none, line_quality.fit(none, labels.limit(0))).count() == 0


def test_decontamination(docs, none, items):
    got = decontamination.report(docs, items).collect()
    assert len(got) == len(ROWS)
    first = [r for r in got if r.doc_id == 1]
    assert [(r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in first] == [(39, 6, ["1", "4"], True)] * 2
    assert [(r.n_hit, r.item_ids) for r in got if r.doc_id == 4] == [(120_000, ["4"])]
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns and not {1, 4} & {r.doc_id for r in kept.select("doc_id").collect()} and kept.count() == len(ROWS) - 3
    spans = {r.doc_id: r.text for r in decontamination.decontaminate(docs, items, remove="spans").collect()}
    assert spans[1] == ("The quick brown fox jumps over the, and then it sleeps. " * 3) and spans[4] == " " and spans[7] == ROWS[-1][1]
    assert decontamination.report(none, items).count() == 0 and decontamination.decontaminate(docs, items.limit(0)).count() == len(ROWS)


def test_pu_quality(docs, none, labels):
    got = pu_quality.score(docs, pu_quality.fit(docs, labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    model = pu_quality.fit(none, labels)
    assert pu_quality.score(none, model).count() == 0 and {r.score for r in pu_quality.score(docs, model).collect()} == {0.5}


def test_language(docs, none):
    filters = language.learn(docs)
    got = language.identify(docs, filters).collect()
    assert len(got) == len(ROWS) and {r.lang_pred for r in got if r.doc_id in (2, 3, 6)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id == 1} == {"en"} and all(0 <= r.score <= 1 for r in got)
    assert language.identify(none, filters).count() == 0 and {r.lang_pred for r in language.identify(docs, language.learn(none)).collect()} == {"und"}


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages(spark, tmp_path, rows, items, labels):
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, table in (("documents", docs), ("benchmark", items), ("labels", labels)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    for name, apply in corpus_pipeline.STAGES:
        out = apply(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        assert set(docs.columns) <= set(out.columns) and (name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns)
        assert (out.count() == 0) == (not rows) or name == "quality_rules"
