import itertools
import random
import zlib

from pyspark.sql import functions as F

from reviewlake.llm import flow_reshard as fr
from reviewlake.llm.queries import QUERIES

from .helpers import SF, edge_docs, empty_docs, texts_of


def test_flow_moves_the_fewest_units():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 3)
        supply = [rng.randint(0, 4) for _ in range(n)]
        demand = fr.even_capacities(sum(supply), rng.randint(1, 3))
        price = [[rng.randint(0, 3) for _ in demand] for _ in supply]
        flow = fr.min_cost_flow(supply, demand, lambda i, j: price[i][j])
        assert [sum(r) for r in flow] == supply and all(sum(r[j] for r in flow) <= demand[j] for j in range(len(demand)))
        cost = sum(flow[i][j] * price[i][j] for i in range(n) for j in range(len(demand)))
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        slots = [j for j, d in enumerate(demand) for _ in range(d)]
        least = min(sum(price[i][j] for i, j in zip(units, p)) for p in itertools.permutations(slots)) if len(slots) < 8 else cost
        assert cost == least


def _check(rows, sizes):
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16 for r in rows)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    for found in shards.values():
        assert sorted(r.slot for r in found) == list(range(len(found)))
    total = sum(r.size for r in rows)
    most = max(sizes)
    for k in range(16):
        assert abs(sum(r.size for r in shards.get(k, [])) - total / 16) <= max(most, 1) if len(rows) < 100 else 0.01 * total / 16


def test_query(spark):
    texts = texts_of(spark)
    rows = QUERIES["op5_flow_reshard"](spark, SF).collect()
    want = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == want and len(rows) == len(texts)
    _check(rows, [s for s, _ in want.values()])
    old = {}
    for r in rows:
        old[r.old_shard] = old.get(r.old_shard, 0) + r.size
    moved = sum(r.size for r in rows if r.shard != r.old_shard)
    assert moved <= sum(max(0, s - sum(old.values()) / 16) for s in old.values()) + 16 * max(s for s, _ in want.values())


def test_rewrite_affected_files_only(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("xy").alias("text"))
    placed = fr.reshard(docs, F.when(F.col("doc_id") < 20, 0).when(F.col("doc_id") < 30, 1).otherwise(2), F.lit(3), [F.col("doc_id")], 3, 3, [30, 30, 60])
    affected = fr.rewrite_affected(docs, placed.select("doc_id", "old_shard", "shard", "slot"), ["doc_id"], str(tmp_path / "out"))
    assert affected == [0, 2]
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("shard = 0").count() == 10 and back.where("shard = 2").count() == 20 and back.columns == ["doc_id", "text", "slot", "shard"]
    same = fr.reshard(docs, F.lit(0), F.lit(3), [F.col("doc_id")], 1, 1)
    assert fr.rewrite_affected(docs, same.select("doc_id", "old_shard", "shard", "slot"), ["doc_id"], str(tmp_path / "none")) == []


def test_edges(spark):
    rows = fr.shard_report(edge_docs(spark)).collect()
    assert len(rows) == edge_docs(spark).count()
    _check(rows, [r.size for r in rows])
    assert sum(r.size == 1 for r in rows) == 4
    assert fr.shard_report(empty_docs(spark)).collect() == []
