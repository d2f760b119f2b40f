"""Streaming = batch: the stateful stream operators on a file stream (Trigger.AvailableNow) give the
batch operators' result."""
import os
import uuid

from pyspark.sql import functions as F

from reviewlake.operators import runs as Rn
from reviewlake.plans import base
from reviewlake.plans.fixtures import fixture
from reviewlake.session import scratch_path
from reviewlake.streaming import runs_stream as RS

from .conftest import SF_SMALL


def _run(df, name, mode="append"):
    ck = scratch_path(df.sparkSession, f"test-ck/{name}-{uuid.uuid4().hex}")
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_stream_sequence_equals_batch(spark):
    ev = fixture(spark, SF_SMALL, "fx_run_events").select("run_id", "event_id", "ts")
    src = scratch_path(spark, f"test-src/{uuid.uuid4().hex}")
    # two arrival batches: earlier events first, so per-run order is preserved across micro-batches
    cut = ev.agg(F.expr("percentile_approx(ts, 0.5)").alias("m")).collect()[0].m
    ev.filter(F.col("ts") <= cut).write.parquet(os.path.join(src, "a"))
    ev.filter(F.col("ts") > cut).write.parquet(os.path.join(src, "b"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    got = _run(RS.stream_sequence(stream, idle_ms=None), "seq_stream")
    want = Rn.sequence(ev)
    assert got.select("run_id", "event_id", "seq").exceptAll(want.select("run_id", "event_id", "seq")).count() == 0
    assert got.count() == ev.count()


def test_stream_evolve_triggers_equal_batch(spark):
    reviews = base.st_reviews(spark, SF_SMALL).select("repo", "review_id", "created_at")
    rules = fixture(spark, SF_SMALL, "fx_repo_rules")
    src = scratch_path(spark, f"test-src/{uuid.uuid4().hex}")
    reviews.write.parquet(src)
    stream = spark.readStream.schema(reviews.schema).parquet(src)
    got = _run(RS.stream_evolve_triggers(stream, rules), "trigger_stream")
    want = Rn.evolve_triggers(reviews, rules)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def _arrivals(spark, df, by):
    """``df`` as a stream of two micro-batches, the earlier rows first."""
    src = scratch_path(spark, f"test-src/{uuid.uuid4().hex}")
    cut = df.agg(F.expr(f"percentile_approx({by}, 0.5)").alias("m")).first().m
    df.filter(F.col(by) <= cut).coalesce(1).write.parquet(os.path.join(src, "a"))
    df.filter(F.col(by) > cut).coalesce(1).write.parquet(os.path.join(src, "b"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))


def test_stream_sequence_is_in_total_order_over_arrow_chunks(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        ev = spark.range(200).select(F.lit("r").alias("run_id"), ((F.col("id") * 37) % 200).alias("event_id"),
                                     F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,(id * 37) % 200)").alias("ts"))
        src = scratch_path(spark, f"test-src/{uuid.uuid4().hex}")
        ev.coalesce(1).write.parquet(src)
        got = _run(RS.stream_sequence(spark.readStream.schema(ev.schema).parquet(src), idle_ms=None), "seq_chunks").collect()
        assert sorted((r.event_id, r.seq) for r in got) == [(k, k + 1) for k in range(200)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_stream_fresh_equals_batch(spark):
    ev = fixture(spark, SF_SMALL, "fx_run_events").select("run_id", "seq", "event_id", "ts")
    late = ev.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND")).withColumn("event_id", -F.col("event_id") - 1)
    src = scratch_path(spark, f"test-src/{uuid.uuid4().hex}")
    ev.unionByName(late).orderBy("ts", "event_id").coalesce(1).write.parquet(src)
    # every event arrives again a second later: one of each remains
    stream = spark.readStream.schema(ev.schema).parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    got = _run(RS.stream_fresh(stream, "30 days"), "fresh_stream")
    want = Rn.fresh(ev.unionByName(late))
    key = ["run_id", "seq"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    assert want.where("event_id < 0").count() == 0 and want.count() == ev.count()


def test_stream_run_state_equals_batch(spark):
    tr = fixture(spark, SF_SMALL, "fx_run_transitions")
    got = RS.latest_updates(_run(RS.stream_run_state(_arrivals(spark, tr, "ts")), "state_stream", "update"), "run_id", "events")
    want = Rn.run_state(tr)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_stream_retain_equals_batch(spark):
    ev = fixture(spark, SF_SMALL, "fx_run_events")
    rows = _run(RS.stream_retain(_arrivals(spark, ev, "ts"), 7, idle_ms=None), "retain_stream", "update").collect()
    last = {}
    for r in rows:
        if max(r.newest) >= max(last.get(r.run_id, [0])):
            last[r.run_id] = r.newest
    want = {r.run_id: sorted(r.s) for r in Rn.retain(ev, 7).groupBy("run_id").agg(F.collect_list("seq").alias("s")).collect()}
    assert last == want


def test_streaming_sink_is_read_back(spark):
    from reviewlake.sources.io import read_reviews

    reviews, issues = base.st_reviews(spark, SF_SMALL), base.st_issues(spark, SF_SMALL)
    stream = _arrivals(spark, reviews, "created_at")
    path, ck = scratch_path(spark, f"test-sink/{uuid.uuid4().hex}"), scratch_path(spark, f"test-ck/sink-{uuid.uuid4().hex}")
    q = RS.write_reviews_stream(stream, lambda b: issues.join(b.select("review_id"), "review_id", "left_semi"), path, ck).trigger(availableNow=True).start()
    q.awaitTermination()
    r, i = read_reviews(spark, path + "/batch=*")
    assert r.count() == reviews.count() == r.select("review_id").distinct().count() and i.count() == issues.count()
    assert {"suggestion", "cwe_id", "line_end", "code_snippet"} <= set(i.columns)
