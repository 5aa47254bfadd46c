"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only, so they can be applied to a session someone else built.  A page or a
# session may hold a large share of all rows, so skewed joins are split even where that costs an
# extra exchange of the (already pre-aggregated) result.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}
# Bytes that a task reads of files (opening one counts as some) and of coalesced shuffle partitions at most: small rows
# can be costly, and what a task sorts should fit its memory.  Smaller settings stay.
TASK_BYTES = 16 << 20
# Rows of a staged file whose readers are costly.
FILE_ROWS = 250_000


def _bytes(spark: SparkSession, size: str | int) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(size))


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    settings = spark._jsparkSession.sessionState().conf()
    for key, now in (("spark.sql.files.maxPartitionBytes", settings.filesMaxPartitionBytes()),
                     ("spark.sql.adaptive.advisoryPartitionSizeInBytes", settings.getConfString("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m"))):
        if _bytes(spark, now) > TASK_BYTES:
            spark.conf.set(key, str(TASK_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; only a local session without one gets its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    # the setting itself cannot change while a session runs
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="blockwise-"))
    return spark.sparkContext.getCheckpointDir()


# what an application has written and not removed, and how often it has removed all
_STAGED: dict[str, list[str]] = {}
_CLEARED: dict[str, int] = {}


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder, which :func:`clear_staged` removes."""
    path = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cleared(spark: SparkSession) -> int:
    """How often this application has removed its folders: a cache of staged frames holds only while this stays."""
    return _CLEARED.get(spark.sparkContext.applicationId, 0)


def clear_staged(spark: SparkSession) -> int:
    """Removes every folder this application has got from :func:`new_folder`; call it when the results that read from them are written."""
    app = spark.sparkContext.applicationId
    paths = _STAGED.pop(app, [])
    _CLEARED[app] = cleared(spark) + 1
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    return len(paths)


def stage(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads on from there.

    For results that several later steps need: they are computed once, survive the loss of executors, and
    being parquet they can be read by column and filtered in the scan.  ``file_rows`` bounds the rows of a file, so that
    rows that are small but costly to work on are read by as many tasks as there are files.
    """
    path = new_folder(df.sparkSession, "blockwise")
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
