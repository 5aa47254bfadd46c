"""Folders for staged results: without a setting, registered, removed, and made anew."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from blockwise import session
from suite import fixtures

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

ALONE = """
from pyspark.sql import SparkSession
from blockwise import session
spark = session.tune(SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate())
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert session.stage(spark.range(3)).count() == 3 and session.stage(spark.range(4)).count() == 4
assert session.clear_staged(spark) == 2
print("done")
"""


def test_local_session_without_a_checkpoint_folder(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT, "TMPDIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", ALONE], env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]


def test_views_are_derived_again_after_clearing(spark):
    first = fixtures.load(spark, "/root/testdata/sf0.001", "votes").count()
    assert session.clear_staged(spark) > 0
    assert fixtures.load(spark, "/root/testdata/sf0.001", "votes").count() == first


def test_report_view_meets_every_part(spark):
    sf = "/root/testdata/sf0.001"
    named = fixtures.load(spark, sf, "report").where(F.col("ord").isin(200, 201)).select("txt").distinct()
    parts = fixtures.load(spark, sf, "part").select(F.col("p_name").alias("txt")).distinct()
    assert parts.join(named, "txt", "left_anti").count() == 0


def test_tasks_stay_small_and_smaller_settings_stay(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    was = {k: spark.conf.get(k) for k in keys}
    try:
        for given, want in (("128m", str(16 << 20)), ("4m", "4m")):
            for k in keys:
                spark.conf.set(k, given)
            session.tune(spark)
            assert [spark.conf.get(k) for k in keys] == [want] * 2
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_staged_files_are_bounded(spark):
    staged = session.stage(spark.range(100, numPartitions=1), 30)
    assert staged.count() == 100 and len(staged.inputFiles()) == 4
