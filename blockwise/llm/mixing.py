"""Mixing sources to target weights by capped water-filling.

Every source is offered a share of the budget in proportion to its weight.  A source whose share is more than
``max_epochs`` times its size is clamped there, and what it cannot take is offered again to the others by weight, until
no share is too large.  Documents are then taken whole: the whole part of a source's epochs for all of its documents,
the fraction for the first documents in a seeded order until it is used up.

Defined results: null and empty texts have size 0 and are taken as often as the others of their source; a null source is
a source of its own, the last one; sources without a word have target 0; repeated rows are taken together; an empty
table gives no rows; columns of ``docs`` that clash with an added one are replaced.  Given weights of a source that is listed
more than once are added up; a source without a weight, or with none above 0, has target 0, so its documents are taken 0 times,
and it does not count towards the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockwise.llm.common import small, word_count

CYCLE = (5, 2, 1)
ADDED = ("size", "source_size", "target", "repetitions", "taken")


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """``sources`` with ``weight``: the cycle dealt out in code point order, null last."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")))


def water_fill(sources: DataFrame, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Adds ``target`` to one row (source, source_size, weight) per source.

    Clamping round by round ends with the sources clamped that come first by cap per weight, so one sorted pass finds
    them: a source is clamped if the level reached with all earlier ones clamped is not below its own ratio.
    """
    everything, before = W.partitionBy(), W.orderBy("ratio", F.col("source").asc_nulls_last())
    s = (sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
         .withColumn("ratio", F.col("cap") / F.col("weight"))
         .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
         .withColumn("cap_before", F.coalesce(F.sum("cap").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("weight_from", F.sum("weight").over(before.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("clamped", F.col("cap") * F.col("weight_from") <= (F.col("budget") - F.col("cap_before")) * F.col("weight"))
         .withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(everything), F.lit(0.0)))
         .withColumn("open", F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(everything)))
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("left") * F.col("weight") / F.col("open"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def order_key(seed: int) -> Column:
    """Seeded place of a document in its source; documents without an id go by their text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))))


def plan(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per source: source, source_size, target, whole (epochs of all documents) and last_key.

    Documents whose key is not above ``last_key`` are taken once more.  It lies where the running size comes nearest to
    the fraction.  Running sizes are found in two steps: sums over 4096 slices of the key, then a running sum inside the
    one slice in which the fraction ends, so a source that holds most documents is never sorted as a whole.
    ``weights`` has (source, weight); without it the cycle is dealt out.
    """
    sized = docs.select("source", word_count(F.col("text")).alias("size"), order_key(seed).alias("key"))
    slices = small(sized.groupBy("source", F.substring("key", 1, 3).alias("slice")).agg(F.sum("size").alias("slice_size")))
    sources = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    if weights is None:
        sources = cyclic_weights(sources)
    else:
        named = weights.groupBy(F.col("source").alias("_source")).agg(F.sum("weight").alias("weight"))
        sources = sources.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    wanted = sources if weights is None else sources.where("weight > 0")
    targets = water_fill(wanted, share, max_epochs)
    if weights is not None:
        rest = sources.where("weight is null or weight <= 0").select("source", "source_size", "weight", F.lit(0.0).alias("target"))
        targets = targets.unionByName(rest)
    filled = (targets
              .withColumn("whole", F.coalesce(F.floor(F.col("target") / F.col("source_size")), F.lit(0)).cast("long"))
              .withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")))
    filled = small(filled)
    part = filled.select(F.col("source").alias("_source"), "part")
    running = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    cut = (slices.withColumn("before", F.coalesce(F.sum("slice_size").over(running), F.lit(0)))
           .join(part, F.col("source").eqNullSafe(F.col("_source"))).where("before < part and part <= before + slice_size")
           .select(F.col("source").alias("_source"), F.col("slice"), "before", "part"))
    cut = small(cut)
    inside = (sized.join(cut, F.col("source").eqNullSafe(F.col("_source")) & (F.substring("key", 1, 3) == F.col("slice")))
              .groupBy("source", "slice", "before", "part", "key").agg(F.sum("size").alias("size")))
    to_here = W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    last = (inside.withColumn("middle", F.col("before") + F.sum("size").over(to_here) - F.col("size") / 2)
            .groupBy("source").agg(F.max(F.when(F.col("middle") < F.col("part"), F.col("key"))).alias("last_key")))
    # with nothing taken inside the slice, all earlier slices are taken: their keys are below the slice's name
    whole_slices = cut.select(F.col("_source"), F.col("slice"))
    bounds = (whole_slices.join(last, F.col("source").eqNullSafe(F.col("_source")), "left")
              .select("_source", F.coalesce("last_key", "slice").alias("last_key")))
    return small(filled.join(bounds, F.col("source").eqNullSafe(F.col("_source")), "left")
                 .select("source", "source_size", "target", "whole", F.coalesce("last_key", F.lit("")).alias("last_key")))


def shares(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """Every document with size, source_size, target, repetitions (how often the mix takes it) and taken (words)."""
    docs = docs.drop(*ADDED)
    per_source = plan(docs, weights, share, max_epochs, seed)
    per_source = per_source.withColumnsRenamed({c: f"_mix_{c}" for c in per_source.columns})
    repetitions = F.col("_mix_whole") + (order_key(seed) <= F.col("_mix_last_key")).cast("long")
    joined = docs.join(per_source, F.col("source").eqNullSafe(F.col("_mix_source")))
    return joined.select(*docs.columns, word_count(F.col("text")).alias("size"), F.col("_mix_source_size").alias("source_size"),
                         F.col("_mix_target").alias("target"), repetitions.alias("repetitions")).withColumn("taken", F.col("size") * F.col("repetitions"))


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: a row of ``docs`` for each time it is taken, with its number as ``repetition``."""
    taken = shares(docs, weights, share, max_epochs, seed).where("repetitions > 0")
    return taken.withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("long"), "repetitions"))).drop(*ADDED)
