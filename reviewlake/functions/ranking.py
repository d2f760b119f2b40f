"""Distributed ranks and running sums.

A window over a whole table, or over a key that holds a third of it, moves its rows into one task.
Instead the rows are range-partitioned by the order once and checkpointed in the shared folder, so that
both passes see the same partitions: one sums each partition, the other adds the sums of the partitions
before it to a running sum inside its own.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with inclusive running sums per key in ``order`` (which should be total within a key).

    Nulls add nothing.  The window over a key's partitions has one row per partition; the window over rows
    never crosses a partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    parts = {n: f"_v{k}" for k, n in enumerate(sums)}
    ranged = df.withColumns({parts[n]: F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    ranged = ranged.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id()).checkpoint()
    by_part = ranged.groupBy(*keys, "_pid").agg(*[F.sum(v).alias(v) for v in parts.values()])
    before = Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_p"),
                             *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_o{v}") for v in parts.values()])
    same = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(offsets, same)
    out = out.withColumns({n: F.col(f"_o{v}") + F.sum(v).over(inside) for n, v in parts.items()})
    return out.select(*[c for c in df.columns if c not in sums], *sums)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based rank over the whole table; every row is kept and no rank is used twice."""
    return running_sums(df, [], order, {name: F.lit(1).cast("bigint")})
