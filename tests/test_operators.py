"""Operators against brute force on small random inputs, with buckets small enough to be crossed."""

import json
import math
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from blockwise.functions.names import is_player_name
from blockwise.functions.numbers import page_timestamp
from blockwise.functions.text import edit_budget
from blockwise.operators import dictionary_match as M
from blockwise.operators import grid as G
from blockwise.operators.dictionary_match import entity_resolution_topk, fuzzy_dictionary_join
from blockwise.operators.neighbours import nearest_around, nearest_in_direction, proximity_veto
from blockwise.operators.ordered import ConflictFold, running_before, sequence_number
from blockwise.operators.picks import top_k
from blockwise.operators.rescans import repair_assignment
from blockwise.operators.rollups import full_text
from blockwise.plans import flows, item_lists, profiles, reports
from blockwise.session import clear_staged, stage
from blockwise.sources import dictionaries, records, replies
from blockwise.vocabulary import DEFAULT, Vocabulary
from suite import fixtures as FX
from suite import reports as suite_reports
from tests.test_expressions import like, noisy

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fuzzy_join_matches_brute_force(spark):
    labels = ["small ring", "red bolt", "old gear", "hot", "a", "Scipio Africanus", "bolt"]
    texts = sorted(set(noisy(labels, 120, 3)))
    m = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, mention string")
    d = spark.createDataFrame([(w,) for w in labels], "label string")
    for threshold in (0.75, 0.85):
        got = rows(fuzzy_dictionary_join(m, d, threshold).select("id", "label"))
        assert got == sorted((i, w) for i, t in enumerate(texts) for w in labels if like(t, w) > threshold)
    got = rows(fuzzy_dictionary_join(m, d, 0.8, contains=True).select("id", "label"))
    assert got == sorted((i, w) for i, t in enumerate(texts) for w in labels if like(t, w) > 0.8 or w.lower() in t.lower())


def within(a, b, k):
    """Whether the edit distance is k or less."""
    if abs(len(a) - len(b)) > k:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1] <= k


@pytest.mark.parametrize("threshold, strict", [(0.6, True), (0.75, True), (0.83, False), (0.9, True)])
def test_keys_find_every_pair(spark, threshold, strict):
    rnd = random.Random(21)
    letters = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    labels = sorted({letters(rnd.randint(1, 30)) for _ in range(80)})
    texts = sorted(set(noisy(labels, 150, 9)) | {letters(rnd.randint(1, 12)) for _ in range(60)} | {letters(3000)} - {""})
    got = rows(M._similar_pairs(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(x,) for x in labels], "label string"), threshold, (), strict))
    want = {(t, x) for t in texts for x in labels if t and within(t, x, edit_budget(len(t), len(x), threshold, strict))}
    assert want <= set(got)


def test_short_words_have_few_candidates(spark):
    rnd = random.Random(22)
    parts = [c + v for c in "bcdfghjklmnprstvwz" for v in "aeiou"]
    def words(n):
        out = set()
        while len(out) < n:
            out.add(("".join(rnd.choice(parts) for _ in range(3)) + rnd.choice("nrst"))[rnd.randint(0, 2):][:rnd.randint(4, 6)])
        return sorted(out)
    texts, labels = (spark.createDataFrame([(w,) for w in words(8000)], f"{c} string") for c in ("text", "label"))
    pairs = M._similar_pairs(texts, labels, 0.75).groupBy("text").count()
    assert pairs.agg(F.sum("count")).first()[0] < 10 * 8000
    keys = labels.select(F.inline(F.expr(M._short_keys("label", 0.75, True))))
    assert keys.agg(F.min(F.length("seg"))).first()[0] >= 3


def test_containment_by_the_rarest_piece(spark):
    texts, labels = ["small red ring", "small gear", "smal", "ab", "x", "hot small pot"], ["small", "small red", "ring", "b", "all g", "smalls", "x"]
    got = rows(M._containing_pairs(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(x,) for x in labels], "label string")))
    assert got == sorted((t, x) for t in texts for x in labels if x in t)


def test_entities_ties_and_word_order(spark):
    d = spark.createDataFrame([("prime", 0, "Scipio Africanus", 0), ("old", 1, "Scipio Africanus", 0), ("old", 1, "Scipio", 1), ("sun", 2, "Sun Tzu", 0)],
                              "entry_id string, entry_ord int, label string, label_ord int")
    m = spark.createDataFrame([("scípio africanus",), ("Africanus Scipio",), ("Sum Tzu",), ("nobody",), ("scipio",)], "mention string")
    got = {r.mention: r.entry_id for r in entity_resolution_topk(m, d).collect()}
    assert got == {"scípio africanus": "prime", "Africanus Scipio": "prime", "Sum Tzu": "sun", "scipio": "old"}


def py_fold(reads):
    kept, log = None, []
    for seq, q, c in reads:
        if kept is None:
            kept = (seq, q, c)
            continue
        if q != kept[1]:
            wins = q > kept[1] if abs(c - kept[2]) <= 5 else c > kept[2] + 5
            log.append((seq, kept[1], q, q if wins else kept[1]))
        else:
            wins = c > kept[2]
        if wins:
            kept = (seq, q, c)
    return kept, log


def test_conflict_fold_across_buckets(spark):
    rnd = random.Random(4)
    data = {g: [(s, rnd.randrange(6), float(rnd.randrange(50, 75))) for s in sorted(rnd.sample(range(400), n))] for g, n in ((0, 1), (1, 5), (2, 300))}
    df = spark.createDataFrame([(g, "x", *r) for g, rs in data.items() for r in rs], "session_id int, item_id string, seq bigint, qty bigint, conf double")
    for width in (2, 7, 512):
        fold = ConflictFold(df, ["session_id", "item_id"], "seq", "qty", "conf", width=width)
        assert rows(fold.winners().select("session_id", "seq", "qty", "conf")) == sorted((g, *py_fold(rs)[0]) for g, rs in data.items())
        got = rows(fold.conflicts().select("session_id", "seq", "previous_qty", "new_qty", "chosen_qty"))
        assert got == sorted((g, *line) for g, rs in data.items() for line in py_fold(rs)[1])


def test_conflict_fold_of_sparse_and_of_contrary_reads(spark):
    rnd = random.Random(14)
    sparse = [(s, rnd.randrange(6), float(rnd.randrange(50, 75))) for s in sorted(rnd.sample(range(10**12), 200))]
    contrary = [(s, s, 100.0 - s / 10) for s in range(300)]
    df = spark.createDataFrame([(g, "x", *r) for g, rs in ((0, sparse), (1, contrary)) for r in rs],
                               "session_id int, item_id string, seq bigint, qty bigint, conf double")
    fold = ConflictFold(df, ["session_id", "item_id"], "seq", "qty", "conf", width=16)
    assert rows(fold.winners().select("session_id", "seq", "qty", "conf")) == sorted((g, *py_fold(rs)[0]) for g, rs in ((0, sparse), (1, contrary)))
    got = rows(fold.conflicts().select("session_id", "seq", "previous_qty", "new_qty", "chosen_qty"))
    assert got == sorted((g, *line) for g, rs in ((0, sparse), (1, contrary)) for line in py_fold(rs)[1])


def test_conflict_fold_of_a_hundred_thousand_contrary_reads(spark):
    # quantities rise while confidence falls: no read forestalls another
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("session_id"), F.lit("x").alias("item_id"), F.col("id").alias("seq"), F.col("id").alias("qty"), (100 - F.col("id") / 1500).alias("conf"))
    fold = ConflictFold(df, ["session_id", "item_id"], "seq", "qty", "conf")
    kept, log = py_fold([(i, i, 100 - i / 1500) for i in range(n)])
    assert rows(fold.winners().select("seq", "qty", "conf")) == [kept]
    assert rows(fold.conflicts().select("seq", "previous_qty", "new_qty", "chosen_qty")) == log
    assert fold.buckets.agg(F.max(F.size("reads"))).first()[0] == 128


def test_long_vocabulary_and_long_text(spark):
    words = [f"word{i:05d}" for i in range(2500)]
    mine = Vocabulary(keywords={**DEFAULT.keywords, "pve_terms": words})
    df = spark.createDataFrame([("a word02499 b",), ("plain",)], "txt string")
    assert [r[0] for r in df.select(is_player_name(F.col("txt"), mine)).collect()] == [False, True]
    texts = spark.createDataFrame([(0, "lorem ipsum " * 10_000), (1, "red bolt")], "id int, mention string")
    labels = spark.createDataFrame([("red bolt",), ("red bolts",)], "label string")
    assert rows(fuzzy_dictionary_join(texts, labels, 0.75).select("id", "label")) == [(1, "red bolt"), (1, "red bolts")]


def test_staged_results_are_removed(spark):
    df = stage(spark.range(3))
    path = df.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path) and clear_staged(spark) >= 1 and not os.path.exists(path)
    FX._STAGED.clear()


def test_two_digit_years(spark):
    df = spark.createDataFrame([("on 12/01/24",), ("2024/12/01",), ("12/01/2024",), ("99/99/99",)], "txt string")
    got = [r[0] and r[0].strftime("%Y-%m-%d") for r in df.select(page_timestamp(F.col("txt"), 2024)).collect()]
    assert got == ["2024-12-01"] * 3 + [None]


def test_running_values_across_buckets(spark):
    rnd = random.Random(5)
    data = [(g, s, rnd.randrange(100)) for g in range(3) for s in rnd.sample(range(200), 40)]
    df = spark.createDataFrame(data, "g int, s int, v int")
    want = []
    for g, s, v in data:
        before = [x for h, t, x in data if h == g and t < s]
        want.append((g, s, max(before) if before else None))
    got = running_before(df, ["g"], "s", F.col("v"), "max", "m", width=16).select("g", "s", "m").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    numbered = sequence_number(df, ["g"], "s", "n", width=16).collect()
    assert all(r.n == 1 + sum(1 for h, t, _ in data if h == r.g and t < r.s) for r in numbered)


def py_greedy(pairs):
    out = []
    for p in {x[0] for x in pairs}:
        used_a, used_q = set(), set()
        for _, d, a, q in sorted(x for x in pairs if x[0] == p):
            if a not in used_a and q not in used_q:
                used_a.add(a), used_q.add(q), out.append((p, a, q))
    return sorted(out)


def test_greedy_matching(spark):
    rnd = random.Random(6)
    pairs = [(p, float(rnd.randrange(8)), a, q) for p in range(3) for a in range(12) for q in range(12) if rnd.random() < 0.4]
    df = spark.createDataFrame(pairs, "page_id int, dist double, anchor_ord int, qty_ord int")
    assert rows(G.greedy_matching(df).select("page_id", "anchor_ord", "qty_ord")) == py_greedy(pairs)
    assert G.greedy_matching(df.limit(0)).count() == 0


def test_greedy_matching_of_a_long_chain(spark):
    # each anchor's nearer number is also the next anchor's: the choice runs through from one end
    n = 5000
    pairs = [x for i in range(n) for x in ((0, 1.0 + (2 * i) / 1e4, i, i), (0, 1.0 + (2 * i + 1) / 1e4, i + 1, i))]
    df = spark.createDataFrame(pairs, "page_id int, dist double, anchor_ord int, qty_ord int")
    started = time.time()
    assert rows(G.greedy_matching(df).select("page_id", "anchor_ord", "qty_ord")) == py_greedy(pairs)
    assert time.time() - started < 20


def test_parts_of_a_page_are_matched_alone(spark):
    rnd = random.Random(16)
    a = [(p, i, rnd.randrange(900) * 1.0, rnd.randrange(4000) * 1.0) for p in range(2) for i in range(150)]
    q = [(p, 500 + i, rnd.randrange(900) * 1.0, rnd.randrange(4000) * 1.0, 5) for p in range(2) for i in range(200)]
    m = spark.createDataFrame([(0, 10.0), (1, 25.0)], "page_id int, m double")
    pairs = stage(G.grid_candidates(spark.createDataFrame(a, "page_id int, ord int, cx double, cy double"),
                                    spark.createDataFrame(q, "page_id int, ord int, cx double, cy double, qty int"), m))
    parted = stage(G.page_parts(pairs))
    assert parted.count() == pairs.count() and parted.select("page_id", "column", "part").distinct().count() > 20
    ends = parted.select("page_id", F.explode(F.array("anchor_ord", "qty_ord")).alias("end"), F.struct("column", "part").alias("g"))
    assert ends.groupBy("page_id", "end").agg(F.count_distinct("g").alias("n")).where("n > 1").count() == 0
    whole = py_greedy([(r.page_id, r.dist, r.anchor_ord, r.qty_ord) for r in pairs.collect()])
    assert rows(G.greedy_matching(parted, ["page_id", "column", "part"]).select("page_id", "anchor_ord", "qty_ord")) == whole


def test_pairs_are_dealt_out_without_their_places(spark):
    pairs = spark.createDataFrame([(1, 2, 3, 0.0, 0.0, 1.0, 5.0, 10.0, 5.1)],
                                  "page_id int, anchor_ord int, qty_ord int, ax double, ay double, qx double, qy double, m double, dist double")
    assert set(G.page_parts(pairs).columns) == {"page_id", "anchor_ord", "qty_ord", "dist", "column", "part"}


def test_grid_views_share_what_they_read(spark):
    for name in ("grid", "rescan"):
        FX.load(spark, "/root/testdata/sf0.001", name)
    assert "grid_source" in {key[3] for key in FX._STAGED}


def test_neighbours_by_cell(spark):
    rnd = random.Random(7)
    pts = [(0, i, f"t{i}", rnd.random(), rnd.random()) for i in range(150)]
    df = spark.createDataFrame(pts, "page_id int, ord int, txt string, nx double, ny double")
    src = df.withColumn("src_ord", F.col("ord"))
    for d, sign, axis in (("right", 1, 0), ("up", -1, 1)):
        want = []
        for _, i, _, x, y in pts:
            best = None
            for _, j, _, u, v in pts:
                dx, dy = u - x, v - y
                along, across = (dx, dy) if axis == 0 else (dy, dx)
                if along * sign > 0 and abs(dx) < 0.3 and abs(dy) < 0.3:
                    best = min(best or (9e9, 0), (abs(across) * 10 + abs(along), j))
            if best:
                want.append((i, best[1]))
        assert rows(nearest_in_direction(src, df, d, 0.3).select("src_ord", "ord")) == sorted(want)
        around = nearest_around(src, df, {"right": 0.3, "left": 0.1, "up": 0.3, "down": 0.2}).where(F.col("direction") == d)
        assert rows(around.select("src_ord", "ord")) == sorted(want)
        by_column = nearest_in_direction(src.withColumn("r", F.lit(0.3)), df, d, "r")
        assert rows(by_column.select("src_ord", "ord")) == sorted(want)


def test_veto_cells(spark):
    rnd = random.Random(8)
    c = [(0, i, rnd.randrange(2000) * 1.0, rnd.randrange(300) * 1.0) for i in range(100)]
    b = [(0, i, rnd.randrange(2000) * 1.0, rnd.randrange(300) * 1.0) for i in range(4)]
    schema = "page_id int, ord int, cx double, cy double"
    got = rows(proximity_veto(spark.createDataFrame(c, schema), spark.createDataFrame(b, schema)).select("ord"))
    assert got == [(i,) for _, i, x, y in c if not any(abs(v - y) < 30 and abs(u - x) < 450 for _, _, u, v in b)]


def test_grid_candidates_match_all_pairs(spark):
    rnd = random.Random(9)
    a = [(0, i, rnd.randrange(200) * 1.0, rnd.randrange(200) * 1.0) for i in range(30)]
    q = [(0, 100 + i, rnd.randrange(200) * 1.0, rnd.randrange(200) * 1.0, 5) for i in range(40)]
    m = spark.createDataFrame([(0, 10.0)], "page_id int, m double")
    ad = spark.createDataFrame(a, "page_id int, ord int, cx double, cy double")
    qd = spark.createDataFrame(q, "page_id int, ord int, cx double, cy double, qty int")
    near = [(i, j) for _, i, x, y in a for _, j, u, v, _ in q if v > y and abs(u - x) <= 20 and math.hypot(u - x, v - y) < 55]
    pairs = G.grid_candidates(ad, qd, m)
    assert rows(pairs.select("anchor_ord", "qty_ord")) == sorted(near)
    pos, qpos = {i: (x, y) for _, i, x, y in a}, {j: v for _, j, _, v, _ in q}
    seen = [(i, j) for i, j in near if not any(k != i and pos[i][1] < y < qpos[j] and abs(x - pos[i][0]) < 20 for k, (x, y) in pos.items())]
    assert rows(G.line_of_sight(ad, qd, m).select("anchor_ord", "qty_ord")) == sorted(seen)


def py_pool(numbers, pool):
    out = []
    for page in sorted({n[0] for n in numbers}):
        left = sorted((x for x in pool if x[0] == page and x[3].isdigit() and x[4] > 0.6), key=lambda x: (-x[4], x[1], x[2]))
        for _, ord_, txt, conf in sorted(n for n in numbers if n[0] == page):
            takes = bool(left) and left[0][4] > conf
            _, _, _, new, sure = left.pop(0) if takes else (0, 0, 0, txt, conf)
            out.append((page, ord_, new, sure, takes))
    return out


def test_numbers_take_from_one_pool_in_page_order(spark):
    rnd = random.Random(31)
    numbers = [(p, o, f"{o}", rnd.randrange(10, 85) / 100) for p in range(4) for o in rnd.sample(range(90), (0, 1, 30, 60)[p])]
    pool = [(p, rnd.randrange(90), s, rnd.choice(["7", "12", "x1", ""]), rnd.randrange(30, 100) / 100) for p in range(5) for s in range(40)]
    got = repair_assignment(spark.createDataFrame(numbers, "page_id int, ord int, txt string, conf double"),
                            spark.createDataFrame(pool, "page_id int, ord int, shot int, txt string, conf double"), pool=True)
    assert rows(got.select("page_id", "ord", "txt", "conf", "repaired")) == py_pool(numbers, pool)


def test_a_complete_page_ignores_later_rounds(spark):
    page = [(1, "ID: 10000007", 400, 100), (2, "Ann Example", 430, 130), (3, "Power", 400, 300), (4, "5,000,000", 420, 330), (5, "Civilization", 880, 270)]
    blocks = [(p, o, t, 0.9, float(x), float(y), x + 80.0, float(y), x + 80.0, y + 20.0) for p in (1, 2, 3) for o, t, x, y in page if (p, o) != (3, 2)]
    crop = (0.0, 0.0, 160.0, 40.0, 860.0, 310.0, 2.0)
    rescans = [(1, 1, "Civilization", 1, 1, "Ge"), (1, 1, "Civilization", 2, 1, "Germany"), (1, 2, "Civilization", 1, 1, "China"),  # complete after its first round
               (2, 1, "Civilization", 1, 1, "nothing"), (2, 2, "Civilization", 1, 1, "China"), (2, 2, "Power", 1, 1, "9,000,000"),  # civilization in the second, power not asked for
               (3, 2, "Civilization", 1, 1, "China"), (3, 2, "Name", 1, 1, "Late One")]                                           # nothing in the first: no second
    out = profiles.profiles_with_rescans(
        spark.createDataFrame(blocks, "page_id int, ord int, txt string, conf double, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double"),
        spark.createDataFrame([(*r, 0.9, *crop) for r in rescans], "page_id int, round int, field string, shot int, line int, txt string, conf double, "
                              "x0 double, y0 double, x2 double, y2 double, origin_x double, origin_y double, scale double"))
    assert rows(out.select("page_id", "civilization", "power", "complete")) == [(1, "Germany", 5_000_000, True), (2, "China", 5_000_000, True), (3, "--", 5_000_000, False)]


def test_top_k_of_one_hot_group(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), "id", (F.col("id") * 7919 % 5000).alias("v"))
    got = top_k(df, ["g"], [F.col("v"), F.col("id")], 3, F.col("id")).orderBy("rank").collect()
    assert [(r.rank, r.v) for r in got] == [(1, 0), (2, 1), (3, 2)]


def test_text_in_runs(spark):
    df = spark.range(50).select(F.lit(1).alias("page_id"), F.col("id").alias("ord"), F.concat(F.lit("l'"), F.col("id").cast("string")).alias("txt"))
    assert full_text(df.repartition(7), ["page_id"], "\n", run=8).first().full_text == "\n".join(f"l'{i}" for i in range(50))


def test_row_order_does_not_matter(spark):
    blocks = FX.blocks(spark, SF, "titled")
    a = rows(item_lists.session_items(blocks)[0])
    assert a and a == rows(item_lists.session_items(blocks.repartition(9, F.rand(3)))[0])


def test_replies_from_files(spark, tmp_path):
    good = {"page_id": "a", "success": True, "blocks": [{"text": "x", "box": [[0, 1], [4, 1], [4, 3], [0, 3]], "conf": 0.5}, {"text": "y", "box": [[0, 1]], "conf": 0.4}]}
    (tmp_path / "r.json").write_text("\n".join([json.dumps(good), json.dumps({"page_id": "b", "success": False, "detail": "no"}), '{"page_id": "c", "succ']))
    r = replies.read_replies(spark, str(tmp_path))
    got = rows(replies.load_detections(r, ["page_id"]).select("page_id", "ord", "txt", "x1", "y2"))
    assert got == [("a", 1, "x", 4.0, 3.0), ("a", 2, "y", None, None)]
    assert sorted(x.code for x in replies.error_rows(r, ["page_id"]).collect()) == ["RECOGNISER_FAILED", "UNREADABLE_REPLY"]


def test_dictionary_file_and_missing_file(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"id": "a", "canonicalName": "A", "labels": ["x", "y"]}, {"id": "b", "labels": []}]))
    got = dictionaries.read_dictionary(spark, str(tmp_path / "d.json")).select("entry_id", "label").collect()
    assert [tuple(r) for r in got] == [("a", "x"), ("a", "y"), ("b", None)]
    assert dictionaries.read_dictionary(spark, str(tmp_path / "none.json")).count() == 0


def test_records_are_written_by_source(spark, tmp_path):
    df = spark.createDataFrame([(1, "report"), (2, "profile")], "page_id int, source string")
    records.write_records(df, str(tmp_path / "out"), "source")
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(1, "report"), (2, "profile")]


def files(folder):
    return sorted((os.path.join(d, f), os.path.getsize(os.path.join(d, f)), os.path.getmtime(os.path.join(d, f))) for d, _, names in os.walk(folder) for f in names)


def test_a_run_is_written_once(spark, tmp_path):
    out = str(tmp_path / "out")
    one, none = spark.range(5).withColumn("v", F.rand()), spark.range(0)
    assert records.committed(spark, out).count() == 0
    assert records.write_run({"records": one, "warnings": none}, out, "a") == {"records": 5, "warnings": 0}
    before, kept = files(out), rows(records.read_runs(spark, out, "records"))
    assert records.write_run({"records": one, "warnings": none}, out, "a") == {"records": 5, "warnings": 0}
    assert files(out) == before and rows(records.read_runs(spark, out, "records")) == kept
    spark.range(99).write.parquet(f"{out}/records/run=b")  # broken off: no commit
    assert records.read_runs(spark, out, "records").count() == 5
    assert records.write_run({"records": spark.range(2), "warnings": none}, out, "b") == {"records": 2, "warnings": 0}
    assert rows(records.read_runs(spark, out, "records").groupBy("run").count()) == [("a", 5), ("b", 2)]


def test_list_pages_are_numbered_by_arrival(spark, tmp_path):
    title, unit, item = DEFAULT.titled_items[0]
    def reply(page, arrival, qty, conf):
        box = lambda y: [[100, y], [400, y], [400, y + 20], [100, y + 20]]
        blocks = [{"text": title, "box": box(100), "conf": conf}, {"text": f"Owned: {qty}", "box": box(140), "conf": conf}]
        return json.dumps({"session_id": "7", "page_id": page, "arrival": str(arrival), "success": True, "blocks": blocks})
    lost = '{"session_id": "7", "page_id": "c", "arrival": "25", "succ'
    (tmp_path / "r.json").write_text("\n".join([reply("b", 20, 9, 0.8), lost, reply("a", 10, 5, 0.8), reply("d", 30, 9, 0.95)]))
    keys = ["session_id", "page_id", "arrival"]
    envelopes, warnings = flows.list_flow(replies.read_replies(spark, str(tmp_path), keys))
    envelope = json.loads(envelopes.first().envelope)
    assert envelope["data"] == {"grand_total": 9 * unit, "items": [{"unit_value": unit, "item_id": item, "title": title, "quantity": 9, "confidence": 95.0, "total_value": 9 * unit}]}
    assert envelope["raw_text"] == f"[IMG 1] {title} | Owned: 5 | [IMG 2] {title} | Owned: 9 | [IMG 4] {title} | Owned: 9"
    assert envelope["warnings"] == [f"[Item Conflict] '{title}' diverged between images. Values: 5 vs 9. System chose: 9 (Conf: 80% vs 80%).", "UNREADABLE_REPLY"]
    assert rows(warnings.select("source", "session_id", "page_seq")) == [("item", 7, 2), ("reply", 7, 3)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_per_page_are_not_broadcast(spark, monkeypatch):
    """However small the files look: at 5.4 million pages two of them took the driver's memory."""
    plans = []

    def staged(df, *args):
        plans.append(_plan(df))
        return stage(df, *args)

    monkeypatch.setattr(reports, "stage", staged)
    monkeypatch.setattr(suite_reports, "stage", staged)
    plans.append(_plan(suite_reports.Q["exists_flags"](spark, SF)))
    joins = [line for plan in plans for line in plan.splitlines() if re.search(r"Join \[page_id#\d+L\], \[page_id#\d+L\]", line)]
    assert len(joins) >= 5 and all("SortMergeJoin" in line for line in joins), joins


def test_flags_of_pages_with_and_without_warnings(spark, monkeypatch):
    names = {1: ("Ann", "Bob"), 2: ("Ann", "Ann"), 3: ("--", "Bob"), 4: ("AT x", "Bob")}
    state = spark.createDataFrame([(p, "SingleBattle_PVP", False, True, 0.9, None, "--") for p in (*names, 5)] + [(None, "SingleBattle_PVP", False, True, 0.9, None, "--")],
                                  "page_id long, page_type string, npc boolean, isolated boolean, mean_conf double, report_ts timestamp, coordinates string")
    zeros = dict.fromkeys(reports.METRIC_COLUMNS.values(), 0)
    sides = spark.createDataFrame([{"page_id": p, "side": side, "governor_name": n, "alliance_tag": "AT", "primary_id": "x"} | zeros
                                   | {"total_units": 10, "remaining": 10} for p, both in names.items() for side, n in zip(("attacker", "defender"), both)],
                                  "page_id long, side string, governor_name string, alliance_tag string, primary_id string, "
                                  + ", ".join(f"{c} long" for c in zeros))
    monkeypatch.setattr(suite_reports, "sides_of", lambda *_: (state, sides))
    got = {r.page_id: (r.any_warning, r.identity_warning) for r in suite_reports.Q["exists_flags"](spark, "").collect()}
    assert got == {1: (False, False), 2: (True, True), 3: (True, False), 4: (True, True)}
