"""Result envelopes and how they are written."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def inventory_envelopes(items: DataFrame, summary: DataFrame, found: str, nothing: str) -> DataFrame:
    """One JSON envelope per session.

    ``found`` is a format with the number of items.  A session holds at most one row per known item, so
    its item list is bounded by the item table.
    """
    row = F.struct("unit_value", "item_id", "quantity", "confidence", "total_value")
    lists = items.groupBy("session_id").agg(F.array_sort(F.collect_list(row)).alias("items"))
    joined = summary.join(lists, "session_id", "left")
    n = F.coalesce(F.size("items"), F.lit(0))
    message = F.when(F.col("items").isNull(), F.lit(nothing)).otherwise(F.format_string(found, n))
    data = F.struct(F.col("grand_total"), F.coalesce("items", F.array().cast("array<struct<unit_value:int,item_id:string,quantity:bigint,confidence:double,total_value:bigint>>")).alias("items"))
    return joined.select("session_id", message.alias("message"),
                         F.to_json(F.struct(F.lit(True).alias("success"), message.alias("message"), data.alias("data"))).alias("envelope"))


def unite_warnings(tables: dict[str, DataFrame], *keys: str) -> DataFrame:
    """One table (source, *keys, code, message) of warnings from several steps.

    A table has the keys that it knows, and either a ``code`` (with a ``detail`` if there is one) or a ``message``.
    """
    out = None
    for source, table in tables.items():
        code = F.col("code") if "code" in table.columns else F.lit(source.upper())
        text = next((F.col(c) for c in ("message", "detail") if c in table.columns), F.lit(None))
        known = [F.col(k) if k in table.columns else F.lit(None).alias(k) for k in keys]
        rows = table.select(F.lit(source).alias("source"), *known, code.alias("code"), text.cast("string").alias("message"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _warnings_of(warnings: DataFrame, key: str) -> DataFrame:
    """The distinct codes of each record; a record has at most one per rule."""
    return warnings.groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("warnings"))


def profile_envelopes(pages: DataFrame, profiles: DataFrame, warnings: DataFrame) -> DataFrame:
    """One JSON envelope per page: success, message, the profile if there is one, and the codes of its warnings."""
    data = F.struct("id", "name", "alliance_tag", "alliance_name", "power", "kill_points", "civilization")
    rows = profiles.select("page_id", "success", data.alias("data"))
    joined = pages.join(rows, "page_id", "left").join(_warnings_of(warnings, "page_id"), "page_id", "left")
    ok = F.coalesce("success", F.lit(False))
    message = F.when(ok, "Profile read").when(F.col("data").isNull(), "No detections").otherwise("No profile found")
    codes = F.coalesce("warnings", F.array().cast("array<string>"))
    return joined.select("page_id", F.to_json(F.struct(ok.alias("success"), message.alias("message"), "data", codes.alias("warnings"))).alias("envelope"))


def report_envelopes(pages: DataFrame, reports: DataFrame, sides: DataFrame, texts: DataFrame, warnings: DataFrame) -> DataFrame:
    """One JSON envelope per page that was sent: success, message, its text, the report with both sides, and the codes of its warnings."""
    side = F.struct(*[c for c in sides.columns if c not in ("page_id", "side")])
    both = sides.groupBy("page_id").agg(*[F.get(F.collect_list(F.when(F.col("side") == s, side)), F.lit(0)).alias(s) for s in ("attacker", "defender")])
    data = F.struct(*[c for c in reports.columns if c not in ("page_id", "warnings") and c[:2] not in ("a_", "d_")], "attacker", "defender")
    found = reports.join(both, "page_id").select("page_id", data.alias("data"))
    joined = pages.join(found, "page_id", "left").join(texts, "page_id", "left").join(_warnings_of(warnings, "page_id"), "page_id", "left")
    ok = F.col("data").isNotNull()
    message = F.when(ok, "Report processed").otherwise("No detections")
    return joined.select("page_id", F.to_json(F.struct(
        ok.alias("success"), message.alias("message"), F.coalesce("full_text", F.lit("")).alias("raw_text"), "data",
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))).alias("envelope"))


def session_envelopes(sessions: DataFrame, items: DataFrame, summary: DataFrame, texts: DataFrame, warnings: DataFrame) -> DataFrame:
    """One JSON envelope per session that was sent: message, its text, totals and items in order of their unit value, and its warnings.

    ``summary`` has the totals and whatever else a kind of session has one of.  A session holds at most one row per known item.
    """
    row = F.struct("unit_value", *[c for c in items.columns if c not in ("session_id", "unit_value")])
    lists = items.groupBy("session_id").agg(F.array_sort(F.collect_list(row)).alias("items"))
    said = warnings.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("page_seq", "source", "message")))["message"].alias("warnings"))
    joined = (sessions.join(summary, "session_id", "left").join(lists, "session_id", "left").join(texts, "session_id", "left")
              .join(said, "session_id", "left"))
    n = F.coalesce(F.size("items"), F.lit(0))
    message = F.when(n > 0, F.format_string("%d item types identified", n)).otherwise("No items identified")
    none = F.array().cast(lists.schema["items"].dataType)
    data = F.struct(*[c for c in summary.columns if c not in ("session_id", "n_items")], F.coalesce("items", none).alias("items"))
    return joined.select("session_id", F.to_json(F.struct(
        F.lit(True).alias("success"), message.alias("message"), F.coalesce("raw_text", F.lit("")).alias("raw_text"), data.alias("data"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))).alias("envelope"))


def write_records(records: DataFrame, path: str, partition_by: Column | str | None = None, fmt: str = "parquet", mode: str = "append") -> None:
    """Writes records as parquet or JSON, partitioned by source if asked."""
    writer = records.write.mode(mode).format(fmt)
    (writer.partitionBy(partition_by) if partition_by is not None else writer).save(path)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(run, table, rows) of every finished run under ``path``."""
    schema = "run string, table string, rows bigint"
    try:
        return spark.read.schema(schema).json(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_run(tables: dict[str, DataFrame], path: str, run: str) -> dict[str, int]:
    """Writes the tables of one run, and then its commit with their numbers of rows, which are counted while writing.

    A run that is committed is left as it is, so doing it again changes no file; one that was broken off is written over.
    """
    spark = next(iter(tables.values())).sparkSession
    counts = {r.table: r.rows for r in committed(spark, path).where(F.col("run") == run).collect()}
    if counts:
        return counts
    for name, table in tables.items():
        seen = Observation(name)
        table.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/{name}/run={run}")
        counts[name] = seen.get["rows"]
    commit = spark.createDataFrame([(run, name, n) for name, n in counts.items()], "run string, table string, rows bigint")
    commit.coalesce(1).write.mode("append").json(f"{path}/commits")
    return counts


def read_runs(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table's rows of all committed runs, with their ``run``."""
    runs = [r.run for r in committed(spark, path).where(F.col("table") == table).select("run").distinct().collect()]
    return spark.read.option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/run={r}" for r in runs])
