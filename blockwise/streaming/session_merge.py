"""Sessions that arrive over time: the max-wins merge and its log of disagreements, kept up to date.

Reads of a session's item come in any order within the allowed lateness, and may come again.  The state of an open item is the
read kept so far and the reads that the watermark has not passed; once it has, they are settled in the order of their arrival times,
so that the log tells what a batch over the whole session would tell.  A state ends when the watermark is ``gap`` past its last read.
The items of a group are held and settled together, as arrays; a group has one in ``GROUPS`` of the open items.

No micro-batch reads what an earlier one wrote: rows are appended to one table by Spark's file sink, which lists each file once
also where a batch is run again.

Defined results: a read whose arrival the watermark has passed is dropped (Spark counts it as late); a read that comes again, with the
same ``seq``, counts once; a row without a session is a heartbeat, which only moves the watermark; other rows with a null are left out; a session that goes on after
more than ``gap`` is logged as a new one, while its winner is still the best of all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

READ_SCHEMA = "session_id bigint, item_id string, seq bigint, qty bigint, conf double, unit_value bigint, arrived timestamp"
KEYS = ["session_id", "item_id"]
OUT = "kind string, session_id bigint, item_id string, seq bigint, qty bigint, conf double, unit_value bigint, previous_qty bigint, chosen_qty bigint"
#: Groups that share a state, fixed for the life of a checkpoint: calling Python costs milliseconds a group, so items share one.
GROUPS = 1 << 10
#: A group's open items: the kept read (``any`` is false before the first) and the last arrival of each, and the reads that wait;
#: both as rows of numbers in bytes.
STATE = "kept binary, items array<string>, waiting binary"
WINNER, CONFLICT = "winner", "conflict"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Item reads arriving as parquet files."""
    return spark.readStream.schema(READ_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _settle(gap_us: int) -> Callable:
    """What the states of a group do with new reads, or with a watermark that has moved on."""
    def settle(key, frames, state):
        import numpy as np
        import pandas as pd

        if pd.isna(key[0]):
            return
        numbers = ["seq", "qty", "conf", "unit_value"]
        read_type = np.dtype([("key", "i8"), ("us", "i8"), *[(c, "f8" if c == "conf" else "i8") for c in numbers]])
        kept_type = np.dtype([("session_id", "i8"), ("last", "i8"), ("any", "?"), *[(c, read_type[c]) for c in numbers]])
        kept, items, waiting = b"", [], b""
        if state.exists:
            kept, items, waiting = state.get
        old, waiting = np.frombuffer(kept, kept_type), np.frombuffer(waiting, read_type)
        frames = [f for f in frames if len(f)]
        # numbered as they appear: open items keep their places
        names = pd.concat([pd.DataFrame({"session_id": old["session_id"], "item_id": np.array(items, object)}), *[f[KEYS] for f in frames]], ignore_index=True)
        number = names.groupby(KEYS, sort=False).ngroup().to_numpy()
        at = np.unique(number, return_index=True)[1]
        kept, items = np.zeros(len(at), kept_type), names["item_id"].to_numpy()[at]
        kept[:len(old)] = old
        kept["session_id"] = names["session_id"].to_numpy()[at]
        new = np.zeros(len(number) - len(old), read_type)
        new["key"] = number[len(old):]
        for c in ("us", *numbers) if frames else ():
            new[c] = np.concatenate([f[c].to_numpy() for f in frames])
        reads = np.concatenate([waiting, new])
        reads = reads[np.lexsort((reads["seq"], reads["key"]))]
        again = (reads["key"][1:] == reads["key"][:-1]) & (reads["seq"][1:] == reads["seq"][:-1])
        reads = reads[~np.concatenate([np.zeros(min(1, len(reads)), bool), again])]
        reads = reads[np.lexsort((reads["seq"], reads["us"], reads["key"]))]
        np.maximum.at(kept["last"], reads["key"], reads["us"])
        passed = state.getCurrentWatermarkMs() * 1000
        settled, waiting = reads[reads["us"] <= passed], reads[reads["us"] > passed]
        if len(settled):
            qty, owner = settled["qty"], settled["key"]
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            before = kept[owner[starts]]
            previous = np.concatenate([qty[:1], qty[:-1]])
            previous[starts] = np.where(before["any"], before["qty"], qty[starts])
            previous = pd.Series(previous).groupby(owner).cummax().to_numpy()
            best = np.lexsort((settled["seq"], -settled["conf"], -qty, owner))[starts]
            offered = settled[best]
            more, same = ([f(offered[c], before[c]) for c in ("qty", "conf")] for f in (np.greater, np.equal))
            better = ~before["any"] | more[0] | (same[0] & (more[1] | (same[1] & (offered["seq"] < before["seq"]))))
            won = offered[better]
            for c in numbers:
                kept[c][won["key"]] = won[c]
            kept["any"][won["key"]] = True
            at = np.concatenate([np.flatnonzero(previous != qty), best[better]])
            kinds = np.repeat([CONFLICT, WINNER], [len(at) - len(won), len(won)])
            told = settled[at]
            yield pd.DataFrame({"kind": kinds, "session_id": kept["session_id"][told["key"]], "item_id": items[told["key"]], **{c: told[c] for c in numbers},
                                "previous_qty": previous[at], "chosen_qty": np.maximum(previous, qty)[at]})
        idle = np.bincount(waiting["key"], minlength=len(kept)) == 0
        ends = kept["last"] + gap_us
        stays = ~(idle & (passed > ends))
        if not stays.any():
            state.remove()
            return
        waiting["key"] = (np.cumsum(stays) - 1)[waiting["key"]]
        state.update((kept[stays].tobytes(), items[stays].tolist(), waiting.tobytes()))
        wake = int(np.concatenate([waiting["us"], ends[stays & idle]]).min())
        state.setTimeoutTimestamp(max(-(-wake // 1000), state.getCurrentWatermarkMs() + 1))
    return settle


def merge(reads: DataFrame, late: str = "1 hour", gap_seconds: int = 30 * 86400) -> DataFrame:
    """Rows of both kinds as they are settled: a winner whenever a better read is kept, and every disagreement once."""
    names = [*KEYS, "seq", "qty", "conf", "unit_value"]
    whole = reads.where(F.col("session_id").isNull() | ~F.greatest(*[F.col(c).isNull() for c in (*names, "arrived")]))
    timed = whole.select(*names, "arrived").withWatermark("arrived", late).withColumn("us", F.unix_micros("arrived"))
    group = F.when(F.col("session_id").isNotNull(), F.pmod(F.xxhash64(*KEYS), F.lit(GROUPS)))
    return timed.withColumn("group", group).groupBy("group").applyInPandasWithState(_settle(gap_seconds * 1_000_000), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run(reads: DataFrame, out: str, checkpoint: str, late: str = "1 hour", gap_seconds: int = 30 * 86400) -> StreamingQuery:
    """Starts the merge over what is available; a later run continues from the checkpoint."""
    return (merge(reads, late, gap_seconds).writeStream.format("parquet").partitionBy("kind").outputMode("append")
            .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _best() -> Column:
    return F.max(F.struct(F.col("qty"), F.col("conf"), (-F.col("seq")).alias("neg_seq"), F.col("unit_value")))


def winners(reads: DataFrame) -> DataFrame:
    """One row per session and item: largest quantity, then confidence, then the earlier read."""
    return (reads.groupBy(*KEYS).agg(_best().alias("b"))
            .select(*KEYS, "b.qty", "b.conf", (-F.col("b.neg_seq")).alias("seq"), "b.unit_value"))


def current(spark: SparkSession, out: str) -> DataFrame:
    """The winners among all settled reads."""
    return winners(spark.read.schema(OUT).parquet(out).where(F.col("kind") == WINNER))


def conflict_log(spark: SparkSession, out: str) -> DataFrame:
    """Every settled disagreement."""
    log = spark.read.schema(OUT).parquet(out).where(F.col("kind") == CONFLICT)
    return log.select(*KEYS, "seq", "previous_qty", F.col("qty").alias("new_qty"), "chosen_qty")
