"""Incremental state: the stored reviews arrive in three batches, some of them late and some twice; the measures of
the merged state equal those of all reviews at once."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import incremental as N
from ..session import scratch_path
from . import base
from .registry import register


def _deliver(spark, sf, open_at, add) -> str:
    path = scratch_path(spark, f"incremental-{uuid.uuid4().hex}")
    reviews, issues = base.st_reviews(spark, sf), base.st_issues(spark, sf)
    part = F.pmod(F.crc32("review_id"), F.lit(7))
    # batch 1 delivers some of batch 0 again, batch 2 some of both and some of its own twice
    open_at(spark, path)
    for batch, parts in [(0, [0, 1, 2]), (1, [2, 3, 4]), (2, [0, 4, 5, 6])]:
        r = reviews.where(part.isin(parts))
        if batch == 2:
            r = r.unionByName(reviews.where(part == 6))
        add(spark, path, batch, r, issues.where(part.isin(parts)))
    add(spark, path, 1, reviews, issues)  # a batch that is there already
    return path


def _state(spark, sf) -> str:
    return _deliver(spark, sf, N.open_state, N.add_batch)


_MEASURES = """
count(*) AS total_reviews, coalesce(round(avg(score), 1), 0.0) AS avg_score, coalesce(round(avg(security_score), 1), 0.0) AS avg_security_score,
       CAST(coalesce(sum(total_issues), 0) AS BIGINT) AS total_issues, CAST(coalesce(sum(critical_count), 0) AS BIGINT) AS total_critical,
       CAST(coalesce(sum(security_issues_count), 0) AS BIGINT) AS total_security_issues, CAST(coalesce(sum(ai_slop), 0) AS BIGINT) AS total_ai_slop,
       CAST(sum(CASE WHEN block_merge THEN 1 ELSE 0 END) AS BIGINT) AS blocked_merges,
       CAST(sum(CASE WHEN secret_leak_detected THEN 1 ELSE 0 END) AS BIGINT) AS secret_leaks"""


@register("analytics.incremental_overview", base.oracle_st(f"""
SELECT '*' AS repo, {_MEASURES} FROM st_reviews
UNION ALL SELECT repo, {_MEASURES} FROM st_reviews GROUP BY repo"""))
def _incremental_overview(spark, sf):
    path = _state(spark, sf)
    return N.overview(spark, path).withColumn("repo", F.lit("*")).unionByName(N.repo_overview(spark, path))


@register("analytics.incremental_keys", base.oracle_st("""
SELECT r.repo, 'categories' AS kind, i.category AS key, count(*) AS n FROM st_issues i JOIN st_reviews r ON r.review_id = i.review_id GROUP BY 1, 2, 3
UNION ALL
SELECT r.repo, 'threat_types', i.threat_type, count(*) FROM st_issues i JOIN st_reviews r ON r.review_id = i.review_id
WHERE i.threat_type <> '' GROUP BY 1, 2, 3"""))
def _incremental_keys(spark, sf):
    return N.key_counts(spark, _state(spark, sf))


@register("io.reviews_upsert", base.oracle_st("""
SELECT r.review_id, r.repo, r.score, r.block_merge, count(i.issue_id) AS issues FROM st_reviews r LEFT JOIN st_issues i ON r.review_id = i.review_id GROUP BY 1, 2, 3, 4"""))
def _reviews_upsert(spark, sf):
    reviews, issues = N.stored_reviews(spark, _deliver(spark, sf, N.open_store, N.add_reviews))
    counts = issues.groupBy("review_id").agg(F.count("issue_id").alias("issues"))
    return reviews.join(counts, "review_id", "left").select("review_id", "repo", "score", "block_merge", F.coalesce("issues", F.lit(0)).cast("long").alias("issues"))
