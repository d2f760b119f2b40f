"""The review store and the newest issues of a repo: no shuffle of issue texts to meet a few reviews."""
from pyspark.sql import functions as F

from reviewlake.operators import analytics as A
from reviewlake.operators import incremental as N
from reviewlake.sources import batches

REVIEWS = "review_id string, repo string, score int, created_at timestamp_ntz"
ISSUES = "issue_id string, review_id string, pos int, title string"


def test_store_writes_issues_as_they_come(spark, tmp_path):
    """Late and repeated reviews, issues of no review, issues without an id or a review; a batch that is there already."""
    path = str(tmp_path)

    def add(batch, reviews, issues):
        N.add_reviews(spark, path, batch, spark.createDataFrame([(r, "o/a", s, None) for r, s in reviews], REVIEWS), spark.createDataFrame(issues, ISSUES))

    N.open_store(spark, path)
    add(0, [("a", 1), ("b", 2), (None, 3)], [("a1", "a", 1, "x"), (None, "a", 2, "y"), ("b1", "b", 1, "x"), ("o1", "orphan", 1, "x"), ("n1", None, 1, "x")])
    add(1, [("b", 5), ("c", 4), ("c", 4)], [("b2", "b", 1, "late"), ("c1", "c", 1, "x"), ("c1", "c", 1, "x")])
    add(1, [("z", 9)], [("z1", "z", 1, "committed already")])
    add(2, [("orphan", 7), ("d", 8)], [("o2", "orphan", 1, "x"), ("a9", "a", 1, "late")])
    reviews, issues = N.stored_reviews(spark, path)
    assert sorted((r.review_id, r.score) for r in reviews.collect()) == [("a", 1), ("b", 2), ("c", 4), ("d", 8), ("orphan", 7)]
    assert sorted(str(r.issue_id) for r in issues.collect()) == ["None", "a1", "b1", "c1", "c1", "o2"]
    dropped = batches.read_batches(spark, path, "dropped", "review_id string")
    assert sorted((r.batch, r.review_id) for r in dropped.collect()) == [(0, "orphan"), (1, "b"), (2, "a")]


def test_newest_issues_meet_a_small_side(spark):
    reviews = spark.range(20_000).select(F.col("id").cast("string").alias("review_id"), (F.col("id") % 3).cast("string").alias("repo"), F.lit("1").alias("pr_id"),
                                         F.timestamp_seconds("id").alias("created_at"))
    issues = spark.range(40_000).select(F.col("id").cast("string").alias("issue_id"), (F.col("id") % 20_000).cast("string").alias("review_id"), F.lit(1).alias("pos"), F.lit("t").alias("category"))
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "100k")
    try:
        got = A.repo_issues(reviews, issues, 5)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = got.collect()
    finally:
        spark.conf.set(limit, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, plan
    assert sorted((r.repo, r["rank"], r.review_id) for r in rows)[:5] == [("0", 1, "19998"), ("0", 2, "19998"), ("0", 3, "19995"), ("0", 4, "19995"), ("0", 5, "19992")] and len(rows) == 15
