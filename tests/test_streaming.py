"""The session merge over several deliveries: order, lateness, repeats, expiry, and restarts."""

import datetime as dt

from pyspark.sql import functions as F

from blockwise.operators.merges import max_wins_conflicts
from blockwise.streaming import session_merge as S

DAY0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def read(session, seq, qty, hours, conf=90.0, item="i"):
    return (session, item, seq, qty, conf, 1, DAY0 + dt.timedelta(hours=hours))


def heartbeat(hours):
    return (None, None, None, None, None, None, DAY0 + dt.timedelta(hours=hours))


class Stream:
    def __init__(self, spark, folder, **how):
        self.spark, self.folder, self.how = spark, str(folder), how

    def deliver(self, *rows):
        """One file and the micro-batches it needs; each call is a restart from the checkpoint."""
        self.spark.createDataFrame(list(rows), S.READ_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        query = S.run(S.read_stream(self.spark, f"{self.folder}/in"), f"{self.folder}/out", f"{self.folder}/checkpoint", **self.how)
        query.awaitTermination()
        return query.recentProgress

    def winners(self):
        return sorted((r.session_id, r.item_id, r.qty, r.seq) for r in S.current(self.spark, f"{self.folder}/out").collect())

    def log(self):
        return sorted((r.session_id, r.seq, r.previous_qty, r.new_qty, r.chosen_qty) for r in S.conflict_log(self.spark, f"{self.folder}/out").collect())


def test_late_and_repeated_deliveries_give_the_batch_log(spark, tmp_path):
    s = Stream(spark, tmp_path, late="10 hours")
    rows = [read(1, n, q, n) for n, q in enumerate([5, 3, 8, 8, 2, 9, 1])] + [read(2, 100 + n, q, n, c) for n, (q, c) in enumerate([(7, 80.0), (7, 95.0), (7, 95.0)])]
    s.deliver(rows[4], rows[1], rows[8])           # out of order
    s.deliver(rows[0], rows[2], rows[3], rows[8])  # earlier ones arrive later, one comes again
    s.deliver(rows[6], rows[5], rows[4], rows[7], rows[9])
    assert s.winners() == []                       # nothing is settled before the watermark passes it
    s.deliver(heartbeat(100))
    batch = spark.createDataFrame(rows, S.READ_SCHEMA)
    assert s.log() == sorted((r.session_id, r.seq, r.previous_qty, r.new_qty, r.chosen_qty) for r in max_wins_conflicts(batch, S.KEYS, "qty", "seq").collect())
    assert s.winners() == sorted((r.session_id, r.item_id, r.qty, r.seq) for r in S.winners(batch).collect()) == [(1, "i", 9, 5), (2, "i", 7, 101)]


def test_reads_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    s = Stream(spark, tmp_path, late="1 hour")
    s.deliver(read(1, 1, 5, 0))
    s.deliver(heartbeat(10))
    progress = s.deliver(read(1, 2, 50, 3), read(1, 3, 6, 12))
    assert sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"]) == 1
    s.deliver(heartbeat(20))
    assert s.winners() == [(1, "i", 6, 3)] and s.log() == [(1, 3, 5, 6, 6)]


def test_state_ends_with_the_session(spark, tmp_path):
    s = Stream(spark, tmp_path, late="1 hour", gap_seconds=5 * 3600)
    kept = lambda progress: progress[-1]["stateOperators"][0]["numRowsTotal"]
    s.deliver(read(1, 1, 5, 0), read(2, 2, 5, 0), read(3, 3, 5, 9))
    assert kept(s.deliver(heartbeat(12))) == 1     # sessions 1 and 2 ended, 3 is settled but open
    assert kept(s.deliver(read(1, 4, 3, 13), heartbeat(40))) == 0
    assert s.winners() == [(1, "i", 5, 1), (2, "i", 5, 2), (3, "i", 5, 3)]
    assert s.log() == []                           # a session that goes on after the gap is a new one


def test_rows_with_nulls(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.deliver((1, None, 1, 5, 90.0, 1, DAY0), (1, "i", 2, None, 90.0, 1, DAY0), (1, "i", 3, 4, 90.0, 1, DAY0), (1, "i", 4, 9, 90.0, 1, None))
    s.deliver(heartbeat(24 * 60))
    assert s.winners() == [(1, "i", 4, 3)]


def test_no_delivery(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.deliver(heartbeat(1))
    assert s.winners() == [] and s.log() == [] and S.current(spark, f"{tmp_path}/out").where(F.col("qty") > 0).count() == 0


def test_many_items_share_few_states(spark, tmp_path):
    s = Stream(spark, tmp_path, late="10 hours")
    rows = [read(n, 10 * n + k, (n * 7 + k * k * 5) % 11, n % 5 + k, 80.0 + k % 2, item="ij"[n % 2]) for n in range(2 * S.GROUPS) for k in range(4)]
    s.deliver(*rows[::2], *rows[::10])
    progress = s.deliver(*rows[1::2], *rows[::6])
    assert 0 < progress[-1]["stateOperators"][0]["numRowsTotal"] <= S.GROUPS
    s.deliver(heartbeat(100))
    batch = spark.createDataFrame(rows, S.READ_SCHEMA)
    assert s.log() == sorted((r.session_id, r.seq, r.previous_qty, r.new_qty, r.chosen_qty) for r in max_wins_conflicts(batch, S.KEYS, "qty", "seq").collect())
    assert s.winners() == sorted((r.session_id, r.item_id, r.qty, r.seq) for r in S.winners(batch).collect())
