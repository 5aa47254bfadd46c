"""Second looks at a page: which regions to read again, which answers to accept, how they come back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwise.functions.numbers import digits_only_int, has_digit, is_digits
from blockwise.operators.picks import first_by

# The strategies tried per region, in order.
REPORT_STRATEGIES = ["HighContrastBinary", "Sharpen", "InvertedBinary"]
TITLE_STRATEGIES = ["Sharpen", "HighContrastBinary"]
GRID_STRATEGY = "WhiteIsolation"
REPORT_ACCEPT = 0.60
TITLE_ACCEPT = 0.75
PROFILE_MIN_TEXT = 3


def _trunc(c: Column) -> Column:
    return c.cast("int")


def _emit(blocks: DataFrame, shots: list[tuple[str, Column, Column, Column, Column]]) -> DataFrame:
    """One row per shot: (strategy, x, y, w, h)."""
    structs = F.array(*[F.struct(F.lit(i + 1).alias("shot"), F.lit(n).alias("strategy"), _trunc(x).alias("x"),
                                 _trunc(y).alias("y"), _trunc(w).alias("w"), _trunc(h).alias("h"))
                        for i, (n, x, y, w, h) in enumerate(shots)])
    return blocks.select("page_id", "ord", F.inline(structs))


def plan_report(numbers: DataFrame) -> DataFrame:
    """Padded region of each unsure number, under three strategies."""
    x, y = F.greatest(F.lit(0), _trunc(F.col("x0")) - 10), F.greatest(F.lit(0), _trunc(F.col("y0")) - 8)
    w, h = _trunc(F.col("x2") - F.col("x0")) + 25, _trunc(F.col("y2") - F.col("y0")) + 16
    return _emit(numbers, [(s, x, y, w, h) for s in REPORT_STRATEGIES])


def plan_titles(blocks: DataFrame) -> DataFrame:
    """Widened region of each unsure line of an item list, under two strategies."""
    x = F.greatest(F.lit(0), _trunc(F.col("x0")) - 5)
    w, h = _trunc(F.col("x2") - F.col("x0")) + 15, _trunc(F.col("y2") - F.col("y0"))
    return _emit(blocks, [(s, x, _trunc(F.col("y0")), w, h) for s in TITLE_STRATEGIES])


def plan_grid(orphans: DataFrame) -> DataFrame:
    """A centred and a right-hand shot below each orphan, sized by the page's median orphan height."""
    scale = orphans.groupBy("page_id").agg(
        F.expr("percentile_disc(0.5) within group (order by y2 - y0 desc)").alias("m"))
    sized = orphans.join(scale, "page_id")
    center = (F.col("x0") + F.col("x2")) / 2
    y, h = F.col("y2") - F.col("m") * 0.2, F.col("m") * 4.5
    wide = _trunc(F.col("m") * 10.0)
    # half of the truncated width, itself a whole number
    return _emit(sized, [(GRID_STRATEGY, center - F.floor(wide / 2), y, wide, h),
                         (GRID_STRATEGY, center, y, F.col("m") * 6.0, h)])


def plan_profile(anchors: DataFrame) -> DataFrame:
    """Regions to search for a missing field, by the ``field`` its anchor stands for."""
    x, y, w, h = F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y2") - F.col("y0")
    # Offsets per field and strategy; every region is 300 high.
    shots = {
        "Civilization": [("1_Civ_Inverted_Binary", x - 20, y - 15, w + 800), ("2_Civ_Normal_Sharpen", x - 20, y - 15, w + 800)],
        "Power": [("1_Stat_Below_Binary", x - 20, y + h * 0.5, w + 300), ("2_Stat_Wide_Contrast", x - 50, y - 10, w + 400)],
        "Name": [("1_Name_Panorama", x - 150, y + h, w + 500)],
        "Alliance": [("1_Alliance_Panorama", x - 50, y + h * 0.5, w + 500)],
    }
    shots["KillPoints"] = shots["Power"]
    plans = [_emit(anchors.filter(F.col("field") == f), [(n, a, b, c, F.lit(300)) for n, a, b, c in s]).withColumn("field", F.lit(f))
             for f, s in shots.items()]
    out = plans[0]
    for p in plans[1:]:
        out = out.unionByName(p)
    return out


def clip_regions(regions: DataFrame, canvas_w: Column, canvas_h: Column, min_size: int = 1, pad: int = 0) -> DataFrame:
    """Regions cut to the canvas; those narrower or lower than ``min_size`` are dropped."""
    x, y = F.greatest(F.lit(0), F.col("x") - pad), F.greatest(F.lit(0), F.col("y") - pad)
    if pad:
        w = F.least(canvas_w, F.col("x") + F.col("w") + pad) - x
        h = F.least(canvas_h, F.col("y") + F.col("h") + pad) - y
    else:
        w, h = F.least(F.col("w"), canvas_w - x), F.least(F.col("h"), canvas_h - y)
    clipped = regions.select(*[c for c in regions.columns if c not in "xywh"],
                             x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    return clipped.filter((F.col("w") >= min_size) & (F.col("h") >= min_size))


def accept_report(rescans: DataFrame) -> DataFrame:
    return rescans.filter(F.col("conf") > REPORT_ACCEPT)


def accept_titles(rescans: DataFrame) -> DataFrame:
    return rescans.filter((F.col("conf") > TITLE_ACCEPT) & has_digit(F.col("txt")))


def accept_profile(rescans: DataFrame, keys: Sequence[str] = ("page_id", "ord"), line: str | None = None) -> DataFrame:
    """The first strategy per region that read enough text; with ``line``, all lines of that reading, which count together."""
    if line is None:
        readable = rescans.filter(F.length(F.trim("txt")) >= PROFILE_MIN_TEXT)
        return first_by(readable, keys, [F.col("shot")], [c for c in rescans.columns if c not in keys])
    lines = F.array_sort(F.collect_list(F.struct(line, "txt")))
    read = rescans.groupBy(*keys, "shot").agg(F.trim(F.array_join(lines["txt"], " ")).alias("_text"))
    first = read.filter(F.length("_text") >= PROFILE_MIN_TEXT).groupBy(*keys).agg(F.min("shot").alias("shot"))
    return rescans.join(first, [*keys, "shot"])


def best_per_region(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """The surest line read in each requested region; empty text and confidence 0 where nothing was read."""
    best = first_by(lines, ["region_id"], [-F.col("conf"), F.col("line")], ["txt", "conf"])
    return requests.join(best, "region_id", "left").select(
        *requests.columns, F.coalesce("txt", F.lit("")).alias("txt"), F.coalesce("conf", F.lit(0.0)).alias("conf"))


def rescan_join(requests: DataFrame, rescans: DataFrame) -> DataFrame:
    """Answers next to the request they belong to; answers nobody asked for are dropped."""
    answers = rescans.select("region_id", "shot", "txt", "conf")
    return requests.join(answers, ["region_id", "shot"])


def rescan_quantity_merge(items: DataFrame, rescans: DataFrame) -> DataFrame:
    """Pending items filled from their rescans: larger quantity first, then higher confidence.

    ``items`` has page_id, anchor_ord, quantity, confidence, color; ``rescans`` page_id, ord, txt, conf.
    """
    qty = digits_only_int(F.col("txt"))
    usable = (rescans.select("page_id", F.col("ord").alias("anchor_ord"), qty.alias("q"), "conf")
              .filter((F.col("q") > 0) & (F.col("conf") > F.when(F.col("q") < 10, 0.15).otherwise(0.40))))
    best = (usable.groupBy("page_id", "anchor_ord")
            .agg(F.max(F.struct("q", F.bround(F.col("conf") * 100, 2).alias("c"))).alias("_best")))
    pending = F.col("quantity") == -1
    found = pending & F.col("_best").isNotNull()
    filled = {
        "quantity": F.when(found, F.col("_best.q")).otherwise(F.col("quantity")),
        "confidence": F.when(found, F.col("_best.c")).otherwise(F.col("confidence")),
        "color": F.when(found, F.replace("color", F.lit("_PENDING"), F.lit(""))).otherwise(F.col("color")),
    }
    return items.join(best, ["page_id", "anchor_ord"], "left").withColumns(filled).drop("_best")


def _numeric(rescans: DataFrame) -> DataFrame:
    return accept_report(rescans).filter(is_digits(F.col("txt")))


def _repaired(found: DataFrame) -> DataFrame:
    """Numbers next to their rescan (new_txt, new_conf), replaced where that is surer."""
    better = F.col("new_conf") > F.col("conf")
    return (found.withColumns({"repaired": F.coalesce(better, F.lit(False)),
                               "txt": F.when(better, F.col("new_txt")).otherwise(F.col("txt")),
                               "conf": F.when(better, F.col("new_conf")).otherwise(F.col("conf"))})
            .drop("new_txt", "new_conf"))


def _deal(batches):
    """Rows (page_id, ord, surer) in page order: the rank of the rescan that each takes, while one of the ``surer`` is left."""
    import pyarrow as pa

    page, used = None, 0
    for batch in batches:
        pages, surer = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        takes, ranks = [], []
        for i, (now, n) in enumerate(zip(pages, surer)):
            page, used = (page, used) if now == page else (now, 0)
            if used < n:
                used += 1
                takes.append(i)
                ranks.append(used)
        taken = batch.take(pa.array(takes, pa.int64()))
        yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(ranks, pa.int64())], names=["page_id", "ord", "rank"])


def _from_pool(numbers: DataFrame, rescans: DataFrame) -> DataFrame:
    """Each number next to the rescan that it takes from its page's pool.

    A number takes the surest rescan left if that is surer than itself, so it takes the next one exactly while fewer are gone than
    are surer.  How many are surer is counted where numbers and rescans lie sorted by confidence; then the numbers pass in page
    order as a stream that holds one count.
    """
    surest = Window.partitionBy("page_id").orderBy(F.desc("conf"), "ord", "shot")
    pool = _numeric(rescans).select("page_id", F.row_number().over(surest).cast("bigint").alias("rank"), F.col("txt").alias("new_txt"), F.col("conf").alias("new_conf"))
    both = numbers.select("page_id", "ord", "conf", F.lit(0).alias("of_pool")).unionByName(
        pool.select("page_id", F.lit(None).cast(numbers.schema["ord"].dataType).alias("ord"), F.col("new_conf").alias("conf"), F.lit(1).alias("of_pool")))
    # a rescan that is only as sure comes after the number
    before = Window.partitionBy("page_id").orderBy(F.desc("conf"), "of_pool").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("surer", F.sum("of_pool").over(before)).filter((F.col("of_pool") == 0) & (F.col("surer") > 0))
    stream = counted.select("page_id", "ord", "surer").repartition("page_id").sortWithinPartitions("page_id", "ord")
    schema = T.StructType([stream.schema["page_id"], stream.schema["ord"], T.StructField("rank", T.LongType())])
    dealt = stream.mapInArrow(lambda batches, deal=_deal: deal(batches), schema)
    return numbers.join(dealt.join(pool, ["page_id", "rank"]).drop("rank"), ["page_id", "ord"], "left")


def repair_assignment(numbers: DataFrame, rescans: DataFrame, pool: bool = False) -> DataFrame:
    """Unsure numbers replaced by the surest numeric rescan of their own region, if that is surer.

    With ``pool``, a page's numbers take their rescans in page order from one pool, whatever region a rescan came from, and each
    rescan is taken once.
    """
    if pool:
        return _repaired(_from_pool(numbers, rescans))
    best = first_by(_numeric(rescans), ["page_id", "ord"], [-F.col("conf"), F.col("shot")], ["txt", "conf"])
    best = best.withColumnsRenamed({"txt": "new_txt", "conf": "new_conf"})
    return _repaired(numbers.join(best, ["page_id", "ord"], "left"))
