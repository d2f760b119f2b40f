"""Operator 5: resharding by minimum-cost flow.

The old shards hold blocks of rows.  From their sizes and the new capacities a minimum-cost flow says
how many bytes go from each old shard to each new one, so that the fewest bytes move (staying costs
nothing).  The flow is laid out along the blocks of each old shard: a block inside one part of the flow
moves or stays whole, a block on an edge is split by rows, and a second, small flow evens out what the
edges left over.  Only files of shards that gain or lose rows are rewritten.
"""
from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BLOCK_BYTES = 4 << 20


def min_cost_flow(supply: list[int], demand: list[int], cost: Callable[[int, int], int]) -> list[list[int]]:
    """Units from each source to each sink at the least total cost, by successive shortest paths with
    potentials.  Total supply may not exceed total demand; costs are not negative.
    """
    a, b = len(supply), len(demand)
    source, sink = a + b, a + b + 1
    graph: list[list[list[int]]] = [[] for _ in range(a + b + 2)]  # to, capacity, cost, reverse

    def arc(u: int, v: int, capacity: int, price: int) -> None:
        graph[u].append([v, capacity, price, len(graph[v])])
        graph[v].append([u, 0, -price, len(graph[u]) - 1])

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(b):
            arc(i, a + j, min(s, demand[j]), cost(i, j))
    for j, d in enumerate(demand):
        arc(a + j, sink, d, 0)
    potential = [0] * len(graph)
    left = sum(supply)
    while left:
        distance, via, heap = [None] * len(graph), [None] * len(graph), [(0, source)]
        distance[source] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > distance[u]:
                continue
            for k, (v, capacity, price, _) in enumerate(graph[u]):
                if capacity and (distance[v] is None or d + price + potential[u] - potential[v] < distance[v]):
                    distance[v] = d + price + potential[u] - potential[v]
                    via[v] = (u, k)
                    heapq.heappush(heap, (distance[v], v))
        if distance[sink] is None:
            raise ValueError("the capacities are too small")
        potential = [p + (d if d is not None else 0) for p, d in zip(potential, distance)]
        amount, v = left, sink
        while v != source:
            u, k = via[v]
            amount, v = min(amount, graph[u][k][1]), u
        v = sink
        while v != source:
            u, k = via[v]
            graph[u][k][1] -= amount
            graph[v][graph[u][k][3]][1] += amount
            v = u
        left -= amount
    return [[next((graph[a + j][r][1] for _, r in [(0, e[3])]), 0) for e in graph[i] if (j := e[0] - a) >= 0 and e[0] < a + b] for i in range(a)]


def even_capacities(total: int, n: int) -> list[int]:
    return [total // n + (k < total % n) for k in range(n)]


def _laid_out(rows: DataFrame, flow: list[list[int]], order: list[Column]) -> DataFrame:
    """`rows` with shard replaced: each source's rows, in block order, are laid along its parts of the flow.

    What stays comes first, then the parts for the other shards; a row goes where the middle of its bytes falls.
    """
    by_block = rows.groupBy("shard", "block").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_block.select("shard", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("shard", "block").orderBy(*order, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["shard", "block"])
    middle = F.col("_from") + F.col("_in") + F.col("size") / 2
    target = F.lit(None).cast("int")
    for i, parts in enumerate(flow):
        edge, chosen = 0, None
        ranges = [(j, parts[j]) for j in sorted(range(len(parts)), key=lambda j: (j != i, j)) if parts[j]]
        for j, amount in ranges:
            edge += amount
            chosen = F.when(middle < edge, j) if chosen is None else chosen.when(middle < edge, j)
        if chosen is not None:
            target = F.when(F.col("shard") == i, chosen.otherwise(ranges[-1][0])).otherwise(target)
    return placed.withColumn("shard", target).drop("_in", "_from")


def reshard(rows: DataFrame, old_shard: Column, size: Column, order: list[Column], n_old: int, n_new: int = 16,
            capacities: list[int] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`rows` with columns old_shard, size, shard, slot: old shard k is shard k again where the flow lets it.

    Two flows are solved: the first from the old shards to the capacities (equal ones by default), the second evens
    out what whole rows left over at the edges of the first.  Blocks hold rows of one size class, the largest rows
    first, and what moves is taken from the end, so that the second flow moves small rows and shard sizes end within
    such a row of their capacities.  `order` makes the order inside a block; rows that tie in it are
    interchangeable.  slot counts the rows of a shard from 0 without a gap.

    Only one number for each shard reaches the driver.  Blocks are cut by a hash of the order columns into about
    `block_bytes` each, so an old shard with a third of all rows is many blocks.
    """
    base = rows.withColumn("old_shard", old_shard.cast("int")).withColumn("size", size.cast("long"))
    sizes = {r["s"]: int(r["b"]) for r in base.groupBy(F.col("old_shard").alias("s")).agg(F.sum("size").alias("b")).collect()}
    n_blocks = max(1, -(-max(sizes.values(), default=0) // block_bytes))
    size_class = F.lit(64) - F.length(F.bin("size"))
    block = size_class.cast("long") * n_blocks + F.pmod(F.xxhash64(*order), F.lit(n_blocks))
    placed = shared.stored(base.withColumn("shard", F.col("old_shard")).withColumn("block", block), "reshard")
    capacities = even_capacities(sum(sizes.values()), n_new) if capacities is None else capacities
    for n in (n_old, n_new):
        supply = [sizes.get(k, 0) for k in range(n)]
        placed = shared.stored(_laid_out(placed, min_cost_flow(supply, capacities, lambda i, j: int(i != j)), order), "reshard-placed")
        sizes = {r["shard"]: int(r["b"]) for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()}

    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "block").orderBy(*order, "size")
    return (placed.withColumn("_k", F.row_number().over(within) - 1).join(firsts, ["shard", "block"])
            .withColumn("slot", (F.col("_first") + F.col("_k")).cast("long")).drop("_k", "_first", "block"))


def rewrite_affected(old: DataFrame, placed: DataFrame, keys: list[str], path: str) -> list[int]:
    """Write the full rows of shards that gain or lose rows under `path`/shard=k; return those shards.

    `old` has the rows, `placed` (of `reshard`) their old_shard, shard and slot by `keys`.  The list of
    shards is at most as long as there are shards.
    """
    moved = placed.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    affected = sorted(r["s"] for r in moved.collect())
    if affected:
        to = placed.where(F.col("shard").isin(affected)).select(*keys, "shard", "slot")
        width = shared.shuffle_width(old.sparkSession)
        (old.join(to, keys).repartitionByRange(width, "shard", "slot").sortWithinPartitions("shard", "slot")
         .write.mode("overwrite").partitionBy("shard").parquet(path))
    return affected


def shard_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str = "source", n: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard of every row; the law is `bytes`.

    size is the text's UTF-8 bytes plus 1 (null text: 1).  The old layout keeps each source in one shard.
    Null ids, null sources and repeated rows are placed like any other; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
                       (F.octet_length(text) + 1).cast("long").alias("bytes"), F.pmod(F.crc32(F.coalesce(F.col(group_col), F.lit("")).cast("binary")), F.lit(n)).alias("old"))
    placed = reshard(rows, F.col("old"), F.col("bytes"), [F.col("doc_id"), F.col("text_crc32")], n, n)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
