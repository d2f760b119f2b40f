"""Most frequent items per group, exact, by mergeable heavy-hitter summaries.

Each task keeps at most a bounded number of counters per group (Misra-Gries): a counter is a lower bound
of an item's count, and what a group's counters have lost in all bounds by how much.  The summaries of all
tasks are added.  An item can be among the first N only if its count plus the loss reaches the N-th largest
counter; those items are counted again exactly.  Where the loss itself reaches that counter an unseen item
could be among them, and the group's items are all counted.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Counters per group and task, and counters of a task that are emitted before it goes on.
CAPACITY, TASK_COUNTERS = 1_000, 500_000


def _reduced(counts: dict, capacity: int) -> tuple[dict, int]:
    """At most `capacity` counters, and what each item may have lost."""
    if len(counts) <= capacity:
        return counts, 0
    cut = sorted(counts.values(), reverse=True)[capacity]
    return {k: v - cut for k, v in counts.items() if v > cut}, cut


def _summaries(capacity: int, task_counters: int):
    """(group, item) -> (group, item, n) for each counter and (group, null, loss) for each group."""

    def emitted(held: dict, lost: dict) -> pa.RecordBatch:
        rows = []
        for g, counts in held.items():
            counts, cut = _reduced(counts, capacity)
            rows += [(g, None, lost.get(g, 0) + cut), *((g, k, v) for k, v in counts.items())]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
                                          ["g", "item", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}
        lost: dict[str, int] = {}
        size = 0
        for batch in batches:
            counted = pa.Table.from_batches([batch]).group_by(["g", "item"], use_threads=False).aggregate([([], "count_all")])
            for g, item, n in zip(counted["g"].to_pylist(), counted["item"].to_pylist(), counted["count_all"].to_pylist()):
                counts = held.setdefault(g, {})
                size += item not in counts
                counts[item] = counts.get(item, 0) + n
                if len(counts) > 2 * capacity:
                    held[g], cut = _reduced(counts, capacity)
                    lost[g] = lost.get(g, 0) + cut
                    size += len(held[g]) - len(counts)
            if size > task_counters:
                yield emitted(held, lost)
                held, lost, size = {}, {}, 0
        if held:
            yield emitted(held, lost)

    return run


def most_frequent(df: DataFrame, group: str, item: str, n: int, count: str = "count", rank: str = "rank", capacity: int = CAPACITY, task_counters: int = TASK_COUNTERS) -> DataFrame:
    """(group, item, count, rank) of the ``n`` most frequent items of each group (ties: item ascending), both strings;
    rows with a null group or item do not count.

    The summaries are checkpointed while the frame is built; what is shuffled is in proportion to the counters."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("item")).where("g is not null and item is not null")
    merged = rows.mapInArrow(_summaries(capacity, task_counters), "g string, item string, n long").groupBy("g", "item").agg(F.sum("n").alias("n")).checkpoint()
    lost = merged.where("item is null").select(F.col("g").alias("of"), F.col("n").alias("lost"))
    counters = merged.where("item is not null").join(lost, F.col("g") == F.col("of")).drop("of")
    by_count = Window.partitionBy("g").orderBy(F.desc("n"), F.asc("item"))
    first = lambda d: d.withColumn("r", F.row_number().over(by_count)).where(F.col("r") <= n)
    sure = counters.where("lost = 0").select("g", "item", "n")
    # the N-th largest counter of groups that lost something; without N counters nothing is sure
    floor = first(counters.where("lost > 0")).groupBy("g", "lost").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"))
    floor = lost.where("lost > 0").join(floor.withColumnRenamed("g", "of_g").drop("lost"), F.col("of") == F.col("of_g"), "left")
    floor = floor.select("of", F.when((F.col("m") == n) & (F.col("least") > F.col("lost")), F.col("least")).alias("least"))
    # one recount: the candidates of the groups with a floor, every item of the others
    candidates = counters.join(floor.where("least is not null"), F.col("g") == F.col("of")).where(F.col("n") + F.col("lost") >= F.col("least")).select("g", "item")
    again = rows.join(candidates, ["g", "item"], "left_semi").unionByName(rows.join(floor.where("least is null"), F.col("g") == F.col("of"), "left_semi"))
    exact = sure.unionByName(again.groupBy("g", "item").agg(F.count(F.lit(1)).alias("n")))
    return first(exact).select(F.col("g").alias(group), F.col("item").alias(item), F.col("n").alias(count), F.col("r").alias(rank))
