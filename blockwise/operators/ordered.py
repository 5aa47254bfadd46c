"""Order-dependent work over groups of any size.

A group is cut into buckets of its order column.  Each bucket is summarised on its own, summaries are
taken in order, and what stood before a bucket is handed back to its rows.  A row holds one bucket of reads or
its summary, whatever share of the table a group has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Keys = Sequence[str]


def _bucket(seq: str, width: int) -> Column:
    return F.floor(F.col(seq) / width).cast("bigint")


def running_before(df: DataFrame, keys: Keys, seq: str, value: Column, how: str, name: str,
                   width: int = 65536, ties: Sequence[str] = ()) -> DataFrame:
    """Adds ``name``: the sum or max of ``value`` over the rows of the group before this one.

    ``seq`` is a number; ``ties`` orders rows that share it.  NULL where no row stands before.
    """
    combine = {"sum": F.sum, "max": F.max}[how]
    order = [F.col(seq), *[F.col(t) for t in ties]]
    rows = df.withColumn("_b", _bucket(seq, width)).withColumn("_v", value)
    totals = rows.groupBy(*keys, "_b").agg(combine("_v").alias("_t"))
    # sparse numbers leave many buckets: their totals are summed up in buckets of buckets
    totals = totals.withColumn("_bb", F.floor(F.col("_b") / width).cast("bigint"))
    above = Window.partitionBy(*keys).orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1)
    upper = totals.groupBy(*keys, "_bb").agg(combine("_t").alias("_t2")).select(*keys, "_bb", combine("_t2").over(above).alias("_above"))
    beside = Window.partitionBy(*keys, "_bb").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    both = totals.withColumn("_beside", combine("_t").over(beside)).join(upper, [*keys, "_bb"])
    carry = F.greatest("_above", "_beside") if how == "max" else F.when(
        F.col("_above").isNotNull() | F.col("_beside").isNotNull(), F.coalesce("_above", F.lit(0)) + F.coalesce("_beside", F.lit(0)))
    carried = both.select(*keys, "_b", carry.alias("_carry"))
    within = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", combine("_v").over(within))
    merged = F.greatest("_carry", "_local") if how == "max" else F.when(
        F.col("_carry").isNotNull() | F.col("_local").isNotNull(),
        F.coalesce("_carry", F.lit(0)) + F.coalesce("_local", F.lit(0)))
    return local.join(carried, [*keys, "_b"]).withColumn(name, merged).drop("_b", "_v", "_local", "_carry")


def sequence_number(df: DataFrame, keys: Keys, seq: str, name: str, width: int = 65536,
                    ties: Sequence[str] = ()) -> DataFrame:
    """Adds ``name``: 1, 2, ... in the order of the group."""
    counted = running_before(df, keys, seq, F.lit(1), "sum", "_before", width, ties)
    return counted.withColumn(name, (F.coalesce("_before", F.lit(0)) + 1).cast("int")).drop("_before")


# --- conflict fold -------------------------------------------------------------------------------
#
# Reads of one item arrive in order; each either replaces the kept read or is dropped.  The rule is
# not associative on reads, but it is on functions: a run of reads maps "the read kept so far" to "the
# read kept afterwards".  That map is described by the run's reads, each with the read that would be
# kept at the end of the run had it just been accepted (``out``).  A kept read meets the first entry
# that replaces it and ends as that entry's ``out``; if none does it survives.

READ = "struct<seq:bigint,qty:bigint,conf:double>"
ENTRY = f"struct<seq:bigint,qty:bigint,conf:double,out:{READ}>"
SUMMARY = f"array<{ENTRY}>"


def replaces(new: Column, kept: Column, margin: float) -> Column:
    """Whether a new read takes over from the kept one."""
    gap = new["conf"] - kept["conf"]
    differs = F.when(F.abs(gap) <= margin, new["qty"] > kept["qty"]).otherwise(new["conf"] > kept["conf"] + margin)
    return F.when(new["qty"] != kept["qty"], differs).otherwise(gap > 0)


def _read(x: Column) -> Column:
    return F.struct(x["seq"].alias("seq"), x["qty"].alias("qty"), x["conf"].alias("conf"))


def _after(kept: Column, summary: Column, margin: float) -> Column:
    """The read kept after a summarised run."""
    taken = F.get(F.filter(summary, lambda e: replaces(e, kept, margin)), F.lit(0))
    return F.when(kept.isNull(), F.get(summary, F.lit(0))["out"]).otherwise(F.coalesce(taken["out"], kept))


def _entry(x: Column, out: Column) -> Column:
    return F.struct(x["seq"].alias("seq"), x["qty"].alias("qty"), x["conf"].alias("conf"), out.alias("out"))


def _prune(summary: Column) -> Column:
    """Drops entries that an earlier entry, at least as large and as sure, always forestalls.

    The first entry stays in any case: it is what an empty state becomes.
    """
    def keep(acc: Column, e: Column) -> Column:
        dominated = F.exists(acc, lambda k: (k["qty"] >= e["qty"]) & (k["conf"] >= e["conf"]))
        return F.when(dominated, acc).otherwise(F.array_append(acc, e))
    return F.aggregate(summary, F.array().cast(SUMMARY), keep)


def _summarise_reads(reads: Column, margin: float) -> Column:
    def prepend(acc: Column, r: Column) -> Column:
        return F.concat(F.array(_entry(r, _after(_read(r), acc, margin))), acc)
    return F.aggregate(F.reverse(reads), F.array().cast(SUMMARY), prepend)


def _scan(keys: int, margin: float, winners: bool) -> Callable:
    """Takes the buckets of each group in order, holding one read: the one kept so far.

    Gives a row for each bucket, with the read kept before it, or one for each group, with the read kept at its end.
    """
    def run(batches):
        import pyarrow as pa

        names, group, kept, ready = None, None, None, []

        def replaced(new, old) -> bool:
            gap = new["conf"] - old["conf"]
            if new["qty"] == old["qty"]:
                return gap > 0
            return new["qty"] > old["qty"] if abs(gap) <= margin else gap > margin

        def rows():
            return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in ready], t) for i, (n, t) in enumerate(names)})

        for batch in batches:
            fields = batch.schema
            names = [*[(fields.names[i], fields.types[i]) for i in range(keys)], ("b", pa.int64()), ("seq", pa.int64()), ("qty", pa.int64()), ("conf", pa.float64())]
            columns = [batch.column(i).to_pylist() for i in range(keys + 2)]
            for *key, b, summary in zip(*columns):
                if key != group:
                    if winners and group is not None:
                        ready.append((*group, None, kept["seq"], kept["qty"], kept["conf"]))
                    group, kept = key, None
                if not winners:
                    ready.append((*key, b, *((kept["seq"], kept["qty"], kept["conf"]) if kept else (None, None, None))))
                kept = summary[0]["out"] if kept is None else next((e["out"] for e in summary if replaced(e, kept)), kept)
            if ready:
                yield rows()
                ready = []
        if winners and group is not None:
            ready.append((*group, None, kept["seq"], kept["qty"], kept["conf"]))
            yield rows()
    return run


class ConflictFold:
    """Ordered merge of repeated reads, for groups of any size.

    ``seq`` must be unique within a group, so a bucket of ``width`` numbers gathers at most that many reads, and its summary has at
    most that many entries.  Buckets are summarised in tasks of their own; then the summaries of a group, not its reads, pass through
    one task as a sorted stream that holds a single read.  For the log, what was kept before a bucket is joined back to it.
    """

    def __init__(self, reads: DataFrame, keys: Keys, seq: str, qty: str, conf: str,
                 margin: float = 5.0, width: int = 128):
        self.keys, self.margin = list(keys), margin
        one = F.struct(F.col(seq).cast("bigint").alias("seq"), F.col(qty).cast("bigint").alias("qty"),
                       F.col(conf).cast("double").alias("conf"))
        self.buckets = (reads.select(*keys, _bucket(seq, width).alias("b"), one.alias("r"))
                        .groupBy(*keys, "b").agg(F.array_sort(F.collect_list("r")).alias("reads")))

    def _scanned(self, winners: bool) -> DataFrame:
        summaries = self.buckets.select(*self.keys, "b", _prune(_summarise_reads(F.col("reads"), self.margin)).alias("summary"))
        schema = T.StructType([*[summaries.schema[k] for k in self.keys], *T.StructType.fromDDL("b bigint, seq bigint, qty bigint, conf double")])
        stream = summaries.repartition(*self.keys).sortWithinPartitions(*self.keys, "b")
        return stream.mapInArrow(_scan(len(self.keys), self.margin, winners), schema)

    def winners(self) -> DataFrame:
        """One row per group: the read kept at the end."""
        return self._scanned(True).drop("b")

    def conflicts(self) -> DataFrame:
        """One row per read that disagreed with what was kept: kept and new read, and the choice."""
        before = self._scanned(False).select(*self.keys, "b", F.when(F.col("seq").isNotNull(), F.struct("seq", "qty", "conf")).alias("carried"))
        rows = self.buckets.join(before, [*self.keys, "b"])
        log_type = f"array<struct<new:{READ},kept:{READ},chosen:bigint>>"
        state = F.struct(F.col("carried").alias("kept"), F.array().cast(log_type).alias("log"))

        def step(acc: Column, r: Column) -> Column:
            kept = acc["kept"]
            wins = kept.isNull() | replaces(r, kept, self.margin)
            line = F.struct(r.alias("new"), kept.alias("kept"), F.when(wins, r["qty"]).otherwise(kept["qty"]).alias("chosen"))
            clash = kept.isNotNull() & (r["qty"] != kept["qty"])
            return F.struct(F.when(wins, r).otherwise(kept).alias("kept"),
                            F.when(clash, F.array_append(acc["log"], line)).otherwise(acc["log"]).alias("log"))
        lines = F.aggregate(F.col("reads"), state, step)["log"]
        return rows.select(*self.keys, F.inline(lines)).select(
            *self.keys, F.col("new.seq").alias("seq"), F.col("kept.qty").alias("previous_qty"),
            F.col("new.qty").alias("new_qty"), F.col("kept.conf").alias("previous_conf"),
            F.col("new.conf").alias("new_conf"), F.col("chosen").alias("chosen_qty"))
