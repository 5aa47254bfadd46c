"""First, best and top-k rows of a group.

All of these are aggregates or limited windows that reduce on the map side, so one group may hold a
large share of the table without its rows meeting in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def first_by(df: DataFrame, keys: Keys, order: Sequence[Column], payload: Sequence[str]) -> DataFrame:
    """One row per group: the payload of the row that comes first in ``order`` (which must end unique)."""
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                      F.struct(*[F.col(p) for p in payload]).alias("_p"))
    picked = df.groupBy(*keys).agg(F.min(ranked).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r._p.{p}").alias(p) for p in payload])


def first_struct(condition: Column, order: Sequence[Column], payload: dict[str, Column]) -> Column:
    """Aggregate: the payload struct of the first row in ``order`` among those meeting a condition."""
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                      F.struct(*[c.alias(n) for n, c in payload.items()]).alias("_p"))
    return F.min(F.when(condition, ranked))["_p"]


def top_k(df: DataFrame, keys: Keys, order: Sequence[Column], k: int, salt_on: Column, salts: int = 64) -> DataFrame:
    """The first k rows of each group with their ``rank``.

    Ranked within salted parts first and then across the at most k*salts survivors, so a hot group is
    spread over many tasks.
    """
    parts = df.withColumn("_salt", F.pmod(F.hash(salt_on), F.lit(salts)))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    survivors = parts.withColumn("_rank", F.row_number().over(inner)).filter(F.col("_rank") <= k).drop("_rank", "_salt")
    return survivors.withColumn("rank", F.row_number().over(outer)).filter(F.col("rank") <= k)
