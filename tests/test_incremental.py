"""Batch tables, the incremental measures and the streaming ingest: interrupted and restarted, nothing twice or lost."""
import os
import uuid

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import analytics as A
from reviewlake.operators import incremental as N
from reviewlake.operators import ingest as I
from reviewlake.plans import base
from reviewlake.plans import ingest_queries
from reviewlake.session import scratch_path
from reviewlake.sources import batches, io
from reviewlake.streaming import ingest_stream as S

from .conftest import SF_SMALL


def _fresh(spark, name):
    return scratch_path(spark, f"test-{name}-{uuid.uuid4().hex}")


class Killed(Exception):
    pass


def test_a_batch_appears_whole_or_not_at_all(spark):
    path, schemas = _fresh(spark, "batches"), {"a": "x long", "b": "y string"}
    batches.open_batches(spark, path, schemas)
    one = {"a": spark.range(3).toDF("x"), "b": spark.createDataFrame([("p",)], "y string")}
    read = lambda n: sorted(tuple(r) for r in batches.read_batches(spark, path, n, schemas[n]).collect())
    assert read("a") == read("b") == []

    def kill(table):
        raise Killed(table)

    with pytest.raises(Killed):
        batches.write_batch(spark, path, 0, one, after=kill)
    assert read("a") == read("b") == []  # written, but not committed
    batches.write_batch(spark, path, 0, one)
    batches.write_batch(spark, path, 0, {"a": spark.range(9).toDF("x"), "b": one["b"]})  # committed: stays
    batches.open_batches(spark, path, schemas)
    assert [x for _, x in read("a")] == [0, 1, 2] and [y for _, y in read("b")] == ["p"]


def test_incremental_measures_equal_the_full_ones(spark):
    reviews, issues = base.st_reviews(spark, SF_SMALL).cache(), base.st_issues(spark, SF_SMALL).cache()
    path = _fresh(spark, "state")
    N.open_state(spark, path)
    assert N.overview(spark, path).first().total_reviews == 0
    half = F.pmod(F.crc32("review_id"), F.lit(2)) == 0
    N.add_batch(spark, path, 0, reviews.where(half), issues)  # with issues of reviews that come later
    old = spark.read.parquet(f"{path}/{N.MEASURES}/batch=0").inputFiles()
    N.add_batch(spark, path, 1, reviews.unionByName(reviews), issues)  # the first half again, the rest twice
    assert spark.read.parquet(f"{path}/{N.MEASURES}/batch=0").inputFiles() == old
    snaps = A.snapshot(reviews, issues)
    assert N.overview(spark, path).first() == A.overview(snaps).first()
    want = {r.repo: r.n for r in snaps.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.repo: r.total_reviews for r in N.repo_overview(spark, path).collect()} == want
    total = N.key_counts(spark, path).where("kind = 'categories'").agg(F.sum("n")).first()[0]
    assert total == issues.join(reviews, "review_id").count()


def test_a_batch_reads_no_old_issue(spark):
    reviews, issues = base.st_reviews(spark, SF_SMALL), base.st_issues(spark, SF_SMALL)
    path = _fresh(spark, "state")
    N.open_state(spark, path)
    N.add_batch(spark, path, 0, reviews.limit(5), issues)
    broken = issues.limit(0)  # the issues of the first batch are gone
    N.add_batch(spark, path, 1, reviews.limit(0), broken)
    assert N.overview(spark, path).first().total_reviews == 5


def _run(stream):
    stream.trigger(availableNow=True).start().awaitTermination()


def test_streaming_ingest_killed_between_sinks(spark):
    raw = io.read_webhooks(spark, _source(spark))
    want_events = sorted(r.event_id for r in I.unified_prs(raw).collect())
    want_bad = sorted((r.event_id, r.reason) for r in I.quarantine(raw).collect())
    src = _source(spark)
    stream = io.read_webhooks(spark, src, streaming=True, files_per_batch=1)
    path, checkpoint = _fresh(spark, "ingest"), _fresh(spark, "ingest-checkpoint")
    seen = []

    def kill(table):
        seen.append(table)
        if len(seen) == 5:  # the second sink of the second batch
            raise Killed(table)

    with pytest.raises(Exception, match="Killed"):
        _run(S.ingest_stream(stream, path, checkpoint, after=kill))
    first = {s: S.read_ingested(spark, path, s, raw).select("batch").distinct().collect() for s in (S.EVENTS, S.QUARANTINE, S.COUNTS)}
    assert all([r.batch for r in rows] == [0] for rows in first.values())
    assert os.path.exists(f"{path}/{S.QUARANTINE}/batch=1")  # half of batch 1 is there and not seen
    _run(S.ingest_stream(stream, path, checkpoint))
    events, bad, counts = (S.read_ingested(spark, path, s, raw) for s in (S.EVENTS, S.QUARANTINE, S.COUNTS))
    assert sorted(r.event_id for r in events.collect()) == want_events
    assert sorted((r.event_id, r.reason) for r in bad.collect()) == want_bad
    assert counts.where("reason is null").agg(F.sum("n")).first()[0] == len(want_events)
    assert counts.where("reason is not null").agg(F.sum("n")).first()[0] == len(want_bad)
    assert events.select("batch").distinct().count() == 3
    _run(S.ingest_stream(stream, path, checkpoint))  # nothing new
    assert events.count() == len(want_events)


_SOURCES = {}


def _source(spark):
    """Webhooks of the fixture as JSON files."""
    if "path" not in _SOURCES:
        raw = ingest_queries.webhooks(spark, SF_SMALL)
        path = _fresh(spark, "webhooks")
        raw.select("event_id", "headers", "body").repartition(3).write.json(path)
        _SOURCES["path"] = path
    return _SOURCES["path"]
