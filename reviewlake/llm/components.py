"""Connected components of an edge table by alternating large and small stars.

Each step keeps one row per edge and needs only a minimum per node, so no neighbourhood is ever
gathered.  Each round is checkpointed in the shared folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, component) with the smallest reachable node, for every linked node
    that is not itself the smallest.  Loops, repeated and reversed links are allowed; a link with a
    null end is ignored; no links give no rows.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    now = edges.select("u", "v").where("u <> v").distinct().checkpoint()
    state = _state(now)
    while True:
        now = _small_star(_large_star(now)).checkpoint()
        after = _state(now)
        if after == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = after
