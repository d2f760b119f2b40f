"""Stored review tables derived from the fixtures, in both dialects.

``st_issues``: fx_issues after severity synonyms and the slop cap (no critical prefix, no
short-circuit: the flagship contract).  ``st_reviews``: fx_reviews plus the derived counters the
store keeps (security score, block flag, slop count).  The Spark side is built with the library's
operators; the DuckDB side is written independently in SQL.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings
from .fixtures import FX_SQL, fixture, oracle_with

ISSUE_COLS = ["issue_id", "review_id", "pos", "severity", "category", "title", "description",
              "file_path", "line_number", "owasp_id", "threat_type"]
REVIEW_COLS = ["review_id", "repo", "pr_id", "platform", "author", "score", "security_score",
               "block_merge", "approval", "ai_slop", "created_at", "target_branch"]


def st_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixture(spark, sf_dir, "fx_issues")
    return findings.cap_slop(findings.normalize_severity(raw, "raw_severity")).select(*ISSUE_COLS)


def st_reviews_rollup(spark: SparkSession, sf_dir: str, issues: DataFrame | None = None) -> DataFrame:
    """Reviews with every per-review counter (the analytics snapshot before maps)."""
    issues = st_issues(spark, sf_dir) if issues is None else issues
    reviews = fixture(spark, sf_dir, "fx_reviews")
    rolled = findings.review_rollup(reviews, issues)
    return (rolled
            .withColumn("block_merge", findings.block_merge(F.col("model_block_merge"), F.col("critical_count")))
            .withColumn("approval", F.col("approval_recommended"))
            .withColumn("ai_slop", F.col("ai_slop_count")))


def st_reviews(spark: SparkSession, sf_dir: str, issues: DataFrame | None = None) -> DataFrame:
    return st_reviews_rollup(spark, sf_dir, issues).select(*REVIEW_COLS)


# ---------------------------------------------------------------------------------------------
# DuckDB side
# ---------------------------------------------------------------------------------------------

ST_SQL = {
    "st_issues": """
SELECT issue_id, review_id, pos,
       CASE WHEN category = 'ai_slop' AND s0 IN ('critical', 'high') THEN 'medium' ELSE s0 END AS severity,
       category, title, description, file_path, line_number, owasp_id, threat_type
FROM (SELECT *, CASE lower(raw_severity) WHEN 'information' THEN 'info' WHEN 'minor' THEN 'low'
                                          WHEN 'major' THEN 'high' ELSE lower(raw_severity) END AS s0
      FROM fx_issues) x""",
    "st_roll": """
SELECT review_id, count(*) AS n,
       sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS n_critical,
       sum(CASE WHEN severity = 'high' THEN 1 ELSE 0 END) AS n_high,
       sum(CASE WHEN severity = 'medium' THEN 1 ELSE 0 END) AS n_medium,
       sum(CASE WHEN severity = 'low' THEN 1 ELSE 0 END) AS n_low,
       sum(CASE WHEN severity = 'info' THEN 1 ELSE 0 END) AS n_info,
       sum(CASE WHEN category = 'ai_slop' THEN 1 ELSE 0 END) AS n_slop,
       sum(CASE WHEN category = 'security' THEN 1 ELSE 0 END) AS n_sec,
       sum(CASE WHEN category = 'security'
                THEN CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END
                ELSE 0 END) AS pen,
       bool_or(coalesce(threat_type = 'secret_leak', false)) AS secret
FROM st_issues GROUP BY review_id""",
    "st_reviews": """
SELECT v.review_id, v.repo, v.pr_id, v.platform, v.author, v.score,
       CAST(CASE WHEN coalesce(r.n_sec, 0) = 0 THEN 10 ELSE greatest(0, 10 - r.pen) END AS INT) AS security_score,
       (v.model_block_merge OR coalesce(r.n_critical, 0) > 0) AS block_merge,
       v.approval_recommended AS approval,
       CAST(coalesce(r.n_slop, 0) AS BIGINT) AS ai_slop,
       v.created_at, v.target_branch,
       CAST(coalesce(r.n, 0) AS BIGINT) AS total_issues,
       CAST(coalesce(r.n_critical, 0) AS BIGINT) AS critical_count,
       CAST(coalesce(r.n_high, 0) AS BIGINT) AS high_count,
       CAST(coalesce(r.n_medium, 0) AS BIGINT) AS medium_count,
       CAST(coalesce(r.n_low, 0) AS BIGINT) AS low_count,
       CAST(coalesce(r.n_info, 0) AS BIGINT) AS info_count,
       CAST(coalesce(r.n_sec, 0) AS BIGINT) AS security_issues_count,
       coalesce(r.secret, false) AS secret_leak_detected
FROM fx_reviews v LEFT JOIN st_roll r ON v.review_id = r.review_id""",
}
ST_ORDER = ["st_issues", "st_roll", "st_reviews"]


def oracle_st(body: str, *extra_fx: str) -> str:
    """DuckDB text with fx_reviews, fx_issues, the stored views and ``body``."""
    ctes = ",\n".join(f"{n} AS ({ST_SQL[n].strip()})" for n in ST_ORDER)
    body = body.strip()
    if body[:4].upper() == "WITH":
        inner = "WITH " + ctes + ",\n" + body[4:].lstrip()
    else:
        inner = "WITH " + ctes + "\n" + body
    return oracle_with(inner, "fx_reviews", "fx_issues", *extra_fx)


assert "fx_issues" in FX_SQL
