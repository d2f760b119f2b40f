"""analytics.* and join.repo_issues over the stored review tables (fixtures fx_reviews, fx_issues,
fx_file_results, fx_file_issues, fx_attempts)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ts_text
from ..operators import analytics as A
from . import base
from .fixtures import fixture, oracle_with
from .registry import register

TS = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def _ts(c: str) -> str:
    return TS.format(c=c)


def _snaps(spark, sf):
    return base.st_reviews_rollup(spark, sf)


def _newest(spark, sf, n):
    """The newest n reviews with their counters (block flag from the model and critical issues)."""
    rolled = A.newest_snapshots(fixture(spark, sf, "fx_reviews"), base.st_issues(spark, sf), n)
    return rolled.withColumn("block_merge", F.col("model_block_merge") | (F.col("critical_count") > 0))


# ---------------------------------------------------------------- flagship

def repo_overview(spark, sf):
    """Per-repository overview (the flagship)."""
    s = _snaps(spark, sf)
    return s.groupBy("repo").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.round(F.avg("score"), 1).alias("avg_score"),
        F.round(F.avg("security_score"), 1).alias("avg_security_score"),
        F.sum("total_issues").cast("bigint").alias("issues"),
        F.sum("critical_count").cast("bigint").alias("critical"),
        F.count_if(F.col("block_merge")).alias("blocked"))


REPO_OVERVIEW_SQL = oracle_with("""
WITH j AS (
  SELECT review_id, category,
         CASE WHEN category = 'ai_slop' AND s0 IN ('critical', 'high') THEN 'medium' ELSE s0 END AS severity
  FROM (SELECT review_id, category,
               CASE lower(raw_severity) WHEN 'information' THEN 'info' WHEN 'minor' THEN 'low'
                                        WHEN 'major' THEN 'high' ELSE lower(raw_severity) END AS s0
        FROM fx_issues) i),
r AS (
  SELECT review_id, count(*) AS n,
         sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS crit,
         sum(CASE WHEN category = 'security'
                  THEN CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END
                  ELSE 0 END) AS pen,
         sum(CASE WHEN category = 'security' THEN 1 ELSE 0 END) AS nsec
  FROM j GROUP BY review_id)
SELECT v.repo,
       count(*) AS reviews,
       round(avg(v.score), 1) AS avg_score,
       round(avg(CASE WHEN coalesce(r.nsec, 0) = 0 THEN 10 ELSE greatest(0, 10 - r.pen) END), 1) AS avg_security_score,
       CAST(sum(coalesce(r.n, 0)) AS BIGINT) AS issues,
       CAST(sum(coalesce(r.crit, 0)) AS BIGINT) AS critical,
       CAST(sum(CASE WHEN v.model_block_merge OR coalesce(r.crit, 0) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS blocked
FROM fx_reviews v LEFT JOIN r ON v.review_id = r.review_id
GROUP BY v.repo
""", "fx_reviews", "fx_issues")
register("analytics.repo_overview", REPO_OVERVIEW_SQL)(repo_overview)


# ---------------------------------------------------------------- snapshots

def _map_text(c: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


@register("analytics.snapshot", base.oracle_st(f"""
WITH c AS (SELECT review_id, string_agg(category || '=' || n, ';' ORDER BY category) AS t
           FROM (SELECT review_id, category, count(*) AS n FROM st_issues GROUP BY 1, 2) x GROUP BY 1),
t AS (SELECT review_id, string_agg(threat_type || '=' || n, ';' ORDER BY threat_type) AS t
      FROM (SELECT review_id, threat_type, count(*) AS n FROM st_issues WHERE threat_type <> '' GROUP BY 1, 2) x GROUP BY 1)
SELECT r.review_id, r.repo, r.score, r.security_score, r.total_issues, r.critical_count, r.high_count, r.secret_leak_detected,
       {_ts('r.created_at')} AS created_at, coalesce(c.t, '') AS categories, coalesce(t.t, '') AS threat_types
FROM st_reviews r LEFT JOIN c ON r.review_id = c.review_id LEFT JOIN t ON r.review_id = t.review_id"""))
def _snapshot(spark, sf):
    out = A.snapshot(base.st_reviews(spark, sf), base.st_issues(spark, sf))
    return out.select("review_id", "repo", "score", "security_score", "total_issues", "critical_count", "high_count", "secret_leak_detected",
                      ts_text(F.col("created_at")).alias("created_at"), _map_text("categories").alias("categories"),
                      _map_text("threat_types").alias("threat_types"))


@register("analytics.overview", base.oracle_st("""
SELECT count(*) AS total_reviews,
       coalesce(round(avg(score), 1), 0.0) AS avg_score,
       coalesce(round(avg(security_score), 1), 0.0) AS avg_security_score,
       CAST(coalesce(sum(total_issues), 0) AS BIGINT) AS total_issues,
       CAST(coalesce(sum(critical_count), 0) AS BIGINT) AS total_critical,
       CAST(coalesce(sum(security_issues_count), 0) AS BIGINT) AS total_security_issues,
       CAST(coalesce(sum(ai_slop), 0) AS BIGINT) AS total_ai_slop,
       CAST(sum(CASE WHEN block_merge THEN 1 ELSE 0 END) AS BIGINT) AS blocked_merges,
       CAST(sum(CASE WHEN secret_leak_detected THEN 1 ELSE 0 END) AS BIGINT) AS secret_leaks
FROM st_reviews"""))
def _overview(spark, sf):
    return A.overview(_snaps(spark, sf))


@register("analytics.score_trend", base.oracle_st(f"""
SELECT {_ts('created_at')} AS created_at, review_id, score, security_score, pr_id
FROM st_reviews ORDER BY created_at DESC, review_id DESC LIMIT 50"""))
def _score_trend(spark, sf):
    return A.score_trend(_newest(spark, sf, 50), 50).withColumn("created_at", ts_text(F.col("created_at")))


@register("analytics.top_categories", base.oracle_st("""
SELECT category, count(*) AS count FROM st_issues GROUP BY category ORDER BY count DESC, category LIMIT 10"""))
def _top_categories(spark, sf):
    return A.top_categories(base.st_issues(spark, sf), 10)


@register("analytics.owasp_distribution", base.oracle_st("""
SELECT owasp_id, count(DISTINCT review_id) AS reviews FROM st_issues
WHERE owasp_id IS NOT NULL AND owasp_id <> '' GROUP BY owasp_id"""))
def _owasp_distribution(spark, sf):
    return A.owasp_distribution(_snaps(spark, sf))


@register("analytics.threat_totals", base.oracle_st("""
SELECT threat_type, count(*) AS issues FROM st_issues
WHERE threat_type IS NOT NULL AND threat_type <> '' GROUP BY threat_type"""))
def _threat_totals(spark, sf):
    return A.threat_totals(base.st_issues(spark, sf))


@register("analytics.security_breakdown", base.oracle_st("""
SELECT CAST(sum(CASE WHEN secret_leak_detected THEN 1 ELSE 0 END) AS BIGINT) AS total_secret_leaks,
       coalesce(round(avg(security_score), 1), 0.0) AS avg_security_score
FROM st_reviews"""))
def _security_breakdown(spark, sf):
    return A.security_breakdown(_snaps(spark, sf))


@register("analytics.author_stats", base.oracle_st("""
SELECT author, count(*) AS reviews, round(avg(score), 1) AS avg_score,
       CAST(sum(total_issues) AS BIGINT) AS total_issues,
       CAST(sum(CASE WHEN block_merge THEN 1 ELSE 0 END) AS BIGINT) AS blocked
FROM st_reviews WHERE author IS NOT NULL AND author <> ''
GROUP BY author ORDER BY reviews DESC, author LIMIT 20"""))
def _author_stats(spark, sf):
    return A.author_stats(_snaps(spark, sf), 20)


RECENT_COLS = ["review_id", "repo", "pr_id", "author", "platform", "score", "security_score",
               "total_issues", "critical_count", "block_merge"]


@register("analytics.recent_reviews", base.oracle_st(f"""
SELECT review_id, repo, pr_id, author, platform, score, security_score, total_issues, critical_count,
       block_merge, {_ts('created_at')} AS created_at
FROM st_reviews ORDER BY created_at DESC, review_id DESC LIMIT 20"""))
def _recent_reviews(spark, sf):
    return (A.recent_reviews(_newest(spark, sf, 20), 20)
            .select(*RECENT_COLS, ts_text(F.col("created_at")).alias("created_at")))


# ---------------------------------------------------------------- per repo, all history

@register("join.repo_issues", base.oracle_st(f"""
SELECT issue_id, review_id, repo, pr_id, review_ts, category, severity, rank FROM (
  SELECT i.issue_id, i.review_id, r.repo, r.pr_id, {_ts('r.created_at')} AS review_ts, i.category, i.severity,
         row_number() OVER (PARTITION BY r.repo ORDER BY r.created_at DESC, r.review_id DESC, i.pos, i.issue_id) AS rank
  FROM st_issues i JOIN st_reviews r ON r.review_id = i.review_id) t
WHERE rank <= 200"""))
def _repo_issues(spark, sf):
    out = A.repo_issues(base.st_reviews(spark, sf), base.st_issues(spark, sf), 200)
    return out.select("issue_id", "review_id", "repo", "pr_id", ts_text(F.col("review_ts")).alias("review_ts"),
                      "category", "severity", F.col("rank"))


@register("analytics.repo_reviews", base.oracle_st(f"""
SELECT review_id, repo, score, {_ts('created_at')} AS created_at, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, review_id DESC) AS rank FROM st_reviews) t
WHERE rank <= 50"""))
def _repo_reviews(spark, sf):
    out = A.repo_reviews(base.st_reviews(spark, sf), 50)
    return out.select("review_id", "repo", "score", ts_text(F.col("created_at")).alias("created_at"), "rank")


@register("analytics.repo_review_count", base.oracle_st("""
SELECT repo, count(*) AS cnt FROM st_reviews GROUP BY repo"""))
def _repo_review_count(spark, sf):
    return A.repo_review_count(base.st_reviews(spark, sf))


def _freq_sql(keys: str, where: str, n: int | None) -> str:
    order = ", ".join(k.strip() for k in keys.split(","))
    inner = f"""SELECT r.repo, {', '.join('i.' + k.strip() for k in keys.split(','))}, count(*) AS cnt
      FROM st_issues i JOIN st_reviews r ON r.review_id = i.review_id {where}
      GROUP BY r.repo, {', '.join('i.' + k.strip() for k in keys.split(','))}"""
    if n is None:
        return base.oracle_st(inner)
    return base.oracle_st(f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY cnt DESC, {order}) AS rank FROM ({inner}) g) t
WHERE rank <= {n}""")


register("analytics.category_frequency", _freq_sql("category", "", 20))(
    lambda spark, sf: A.category_frequency(base.st_reviews(spark, sf), base.st_issues(spark, sf), 20))
register("analytics.owasp_frequency", _freq_sql("owasp_id", "WHERE i.owasp_id IS NOT NULL AND i.owasp_id <> ''", 20))(
    lambda spark, sf: A.owasp_frequency(base.st_reviews(spark, sf), base.st_issues(spark, sf), 20))
register("analytics.file_frequency", _freq_sql("file_path, category", "WHERE i.file_path IS NOT NULL", 20))(
    lambda spark, sf: A.file_frequency(base.st_reviews(spark, sf), base.st_issues(spark, sf), 20))
register("analytics.severity_distribution", _freq_sql("severity", "", None))(
    lambda spark, sf: A.severity_distribution(base.st_reviews(spark, sf), base.st_issues(spark, sf)))
register("analytics.threat_frequency", _freq_sql("threat_type", "WHERE i.threat_type IS NOT NULL AND i.threat_type <> ''", 20))(
    lambda spark, sf: A.threat_frequency(base.st_reviews(spark, sf), base.st_issues(spark, sf), 20))


# ---------------------------------------------------------------- per-review report tables

AREA_SQL = """CASE lower(category)
  WHEN 'security' THEN 'Security' WHEN 'injection' THEN 'Security' WHEN 'broken_auth' THEN 'Security'
  WHEN 'sensitive_data' THEN 'Security' WHEN 'xxe' THEN 'Security' WHEN 'broken_access' THEN 'Security'
  WHEN 'misconfig' THEN 'Security' WHEN 'xss' THEN 'Security' WHEN 'deserialization' THEN 'Security'
  WHEN 'vulnerable_deps' THEN 'Security' WHEN 'insufficient_logging' THEN 'Security' WHEN 'secret_leak' THEN 'Security'
  WHEN 'bugs' THEN 'Reliability' WHEN 'bug' THEN 'Reliability' WHEN 'performance' THEN 'Reliability'
  WHEN 'reliability' THEN 'Reliability' WHEN 'compilation' THEN 'Reliability'
  ELSE 'Maintainability' END"""


@register("analytics.severity_type_matrix", base.oracle_st(f"""
WITH c AS (
  SELECT review_id, {AREA_SQL} AS area,
         sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS critical,
         sum(CASE WHEN severity = 'high' THEN 1 ELSE 0 END) AS high,
         sum(CASE WHEN severity = 'medium' THEN 1 ELSE 0 END) AS medium
  FROM st_issues WHERE severity IN ('critical', 'high', 'medium') GROUP BY 1, 2),
g AS (SELECT r.review_id, a.area FROM st_reviews r,
      (SELECT 'Security' AS area UNION ALL SELECT 'Reliability' UNION ALL SELECT 'Maintainability') a)
SELECT g.review_id, g.area,
       CAST(coalesce(c.critical, 0) AS BIGINT) AS critical, CAST(coalesce(c.high, 0) AS BIGINT) AS high,
       CAST(coalesce(c.medium, 0) AS BIGINT) AS medium,
       CAST(coalesce(c.critical, 0) + coalesce(c.high, 0) + coalesce(c.medium, 0) AS BIGINT) AS total
FROM g LEFT JOIN c ON g.review_id = c.review_id AND g.area = c.area"""))
def _severity_type_matrix(spark, sf):
    return A.severity_type_matrix(base.st_reviews(spark, sf), base.st_issues(spark, sf))


SEV_RANK_SQL = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END"


@register("analytics.risk_areas", base.oracle_st(f"""
SELECT review_id, area, count(*) AS issues,
       CASE min(r) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' END
         AS worst_severity
FROM (SELECT review_id, {AREA_SQL} AS area, {SEV_RANK_SQL} AS r FROM st_issues) x
GROUP BY review_id, area"""))
def _risk_areas(spark, sf):
    return A.risk_areas(base.st_issues(spark, sf))


@register("analytics.risk_level", base.oracle_st("""
SELECT review_id, CASE WHEN critical_count > 0 THEN 'HIGH' WHEN high_count > 0 THEN 'MEDIUM'
                       WHEN medium_count > 0 THEN 'LOW' ELSE 'NONE' END AS risk_level
FROM st_reviews"""))
def _risk_level(spark, sf):
    return A.risk_level(_snaps(spark, sf)).select("review_id", "risk_level")


@register("analytics.debt_hours", base.oracle_st("""
SELECT r.review_id, round(coalesce(d.c, 0) / 100.0, 1) AS debt_hours
FROM st_reviews r LEFT JOIN (
  SELECT review_id, sum(CASE severity WHEN 'critical' THEN 200 WHEN 'high' THEN 100 WHEN 'medium' THEN 50
                                      WHEN 'low' THEN 15 ELSE 0 END) AS c
  FROM st_issues GROUP BY review_id) d ON r.review_id = d.review_id"""))
def _debt_hours(spark, sf):
    return A.debt_hours(base.st_reviews(spark, sf), base.st_issues(spark, sf))


@register("analytics.score_band", base.oracle_st("""
SELECT review_id, score,
       CASE WHEN score >= 8 THEN 'brightgreen' WHEN score >= 6 THEN 'yellow' WHEN score >= 4 THEN 'orange' ELSE 'red' END
         AS score_color,
       CASE WHEN score >= 8 THEN '✅' WHEN score >= 6 THEN '⚠️' ELSE '❌' END AS score_icon,
       CASE WHEN score >= 8 THEN '🟢' WHEN score >= 5 THEN '🟡' ELSE '🔴' END AS cli_icon
FROM st_reviews"""))
def _score_band(spark, sf):
    return A.score_band(base.st_reviews(spark, sf)).select("review_id", "score", "score_color", "score_icon", "cli_icon")


@register("analytics.file_breakdown", base.oracle_st("""
SELECT review_id, CASE WHEN file_path <> '' THEN file_path END AS file, count(*) AS issues,
       CAST(sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical,
       CAST(sum(CASE WHEN severity = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS high,
       CAST(sum(CASE WHEN severity = 'medium' THEN 1 ELSE 0 END) AS BIGINT) AS medium,
       CAST(sum(CASE WHEN severity = 'low' THEN 1 ELSE 0 END) AS BIGINT) AS low,
       CAST(sum(CASE WHEN severity = 'info' THEN 1 ELSE 0 END) AS BIGINT) AS info
FROM st_issues GROUP BY 1, 2"""))
def _file_breakdown(spark, sf):
    return A.file_breakdown(base.st_issues(spark, sf))


@register("analytics.important_issues", base.oracle_st("""
SELECT review_id, pos, issue_id, severity, title, rank,
       row_number() OVER (PARTITION BY review_id, lower(coalesce(description, '')) ORDER BY pos) > 1
         AS repeated_description
FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY pos) AS rank
      FROM st_issues WHERE severity IN ('critical', 'high')) t"""))
def _important_issues(spark, sf):
    return A.important_issues(base.st_issues(spark, sf)).select(
        "review_id", "pos", "issue_id", "severity", "title", "rank", "repeated_description")


@register("analytics.section_issues", base.oracle_st("""
SELECT review_id, pos, issue_id, section, rank FROM (
  SELECT review_id, pos, issue_id, 'security' AS section, row_number() OVER (PARTITION BY review_id ORDER BY pos) AS rank
  FROM st_issues WHERE category = 'security') a
UNION ALL
SELECT review_id, pos, issue_id, section, rank FROM (
  SELECT review_id, pos, issue_id, 'ai_slop' AS section, row_number() OVER (PARTITION BY review_id ORDER BY pos) AS rank
  FROM st_issues WHERE category = 'ai_slop') b"""))
def _section_issues(spark, sf):
    return A.section_issues(base.st_issues(spark, sf)).select("review_id", "pos", "issue_id", "section", "rank")


@register("analytics.inline_comments", base.oracle_st("""
SELECT review_id, pos, file_path, line_number AS line,
       CASE severity WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' WHEN 'low' THEN '🔵'
                     WHEN 'info' THEN 'ℹ️' END
       || ' **' || upper(severity) || ': ' || title || '**' || chr(10) || chr(10) || description
       || chr(10) || chr(10) || '*Category: ' || category || '*' AS body
FROM st_issues WHERE file_path IS NOT NULL AND file_path <> '' AND line_number IS NOT NULL AND line_number <> 0"""))
def _inline_comments(spark, sf):
    return A.inline_comments(base.st_issues(spark, sf))


@register("analytics.issue_table", base.oracle_st("""
SELECT review_id, row_number() OVER (PARTITION BY review_id ORDER BY pos) AS idx, upper(severity) AS severity,
       CASE WHEN file_path <> '' THEN file_path ELSE '-' END AS file,
       CASE WHEN line_number IS NOT NULL AND line_number <> 0 THEN CAST(line_number AS VARCHAR) ELSE '-' END AS line,
       title
FROM st_issues"""))
def _issue_table(spark, sf):
    return A.issue_table(base.st_issues(spark, sf))


# ---------------------------------------------------------------- project review

STREAK_SQL = """
vis AS (SELECT *, sum(CASE WHEN is_error THEN 0 ELSE 1 END)
                  OVER (PARTITION BY project ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island
        FROM fx_file_results WHERE NOT skipped),
cnt AS (SELECT *, sum(CASE WHEN is_error THEN 1 ELSE 0 END)
                  OVER (PARTITION BY project, island ORDER BY pos ROWS UNBOUNDED PRECEDING) AS errs FROM vis),
brk AS (SELECT project, min(pos) AS break_pos FROM cnt WHERE errs = 5 GROUP BY project),
kept AS (SELECT f.*, b.break_pos FROM fx_file_results f LEFT JOIN brk b ON f.project = b.project)"""


def _results(spark, sf):
    return fixture(spark, sf, "fx_file_results")


def _file_issues(spark, sf):
    return fixture(spark, sf, "fx_file_issues")


@register("analytics.error_streak", oracle_with(f"WITH {STREAK_SQL} SELECT project, break_pos FROM brk", "fx_file_results"))
def _error_streak(spark, sf):
    return A.error_streak(_results(spark, sf), 5)


@register("analytics.project_summary", oracle_with(f"""
WITH {STREAK_SQL},
tot AS (SELECT project, count(*) AS total_files FROM fx_file_results GROUP BY project),
rev AS (SELECT project, file FROM kept WHERE NOT skipped AND NOT is_error),
ic AS (SELECT i.project, count(*) AS total_issues,
              sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS critical,
              sum(CASE WHEN severity = 'high' THEN 1 ELSE 0 END) AS high,
              sum(CASE WHEN severity = 'medium' THEN 1 ELSE 0 END) AS medium,
              sum(CASE WHEN severity = 'low' THEN 1 ELSE 0 END) AS low
       FROM fx_file_issues i SEMI JOIN rev ON i.project = rev.project AND i.file = rev.file GROUP BY i.project),
s AS (SELECT project,
             CAST(sum(CASE WHEN NOT skipped AND NOT is_error THEN 1 ELSE 0 END) AS BIGINT) AS reviewed,
             CAST(sum(CASE WHEN skipped THEN 1 ELSE 0 END) AS BIGINT) AS skipped_files,
             CAST(sum(CASE WHEN is_error THEN 1 ELSE 0 END) AS BIGINT) AS errors,
             coalesce(round(avg(CASE WHEN NOT skipped AND NOT is_error THEN score END), 1), 0.0) AS avg_score,
             max(break_pos) AS break_pos
      FROM kept GROUP BY project)
SELECT t.project, t.total_files, s.reviewed, s.skipped_files, s.errors, s.avg_score, s.break_pos,
       CAST(coalesce(ic.total_issues, 0) AS BIGINT) AS total_issues, CAST(coalesce(ic.critical, 0) AS BIGINT) AS critical,
       CAST(coalesce(ic.high, 0) AS BIGINT) AS high, CAST(coalesce(ic.medium, 0) AS BIGINT) AS medium,
       CAST(coalesce(ic.low, 0) AS BIGINT) AS low,
       CASE WHEN s.break_pos IS NOT NULL THEN 'failed' WHEN s.errors > s.reviewed THEN 'failed' ELSE 'done' END AS status
FROM tot t LEFT JOIN s ON t.project = s.project LEFT JOIN ic ON t.project = ic.project""",
                                                    "fx_file_results", "fx_file_issues"))
def _project_summary(spark, sf):
    return A.project_status(A.project_summary(_results(spark, sf), _file_issues(spark, sf), 5))


@register("analytics.project_status", oracle_with(f"""
WITH {STREAK_SQL}
SELECT project,
       CASE WHEN max(break_pos) IS NOT NULL THEN 'failed'
            WHEN sum(CASE WHEN is_error THEN 1 ELSE 0 END) > sum(CASE WHEN NOT skipped AND NOT is_error THEN 1 ELSE 0 END)
            THEN 'failed' ELSE 'done' END AS status
FROM kept GROUP BY project""", "fx_file_results"))
def _project_status(spark, sf):
    return A.project_status(A.project_summary(_results(spark, sf), None, 5)).select("project", "status")


@register("analytics.provider_fallback", oracle_with("""
SELECT file_id, arg_min(provider, attempt) FILTER (WHERE ok) AS provider,
       CAST(coalesce(min(attempt) FILTER (WHERE ok) + 1, count(*)) AS INT) AS tries,
       CASE WHEN bool_or(ok) THEN 'ok' ELSE 'error' END AS outcome
FROM fx_attempts GROUP BY file_id""", "fx_attempts"))
def _provider_fallback(spark, sf):
    return A.provider_fallback(fixture(spark, sf, "fx_attempts"))


REVIEWED_SQL = STREAK_SQL + """,
n AS (SELECT project, file, count(*) AS total_issues FROM fx_file_issues GROUP BY project, file),
reviewed AS (SELECT k.project, k.pos, k.file, k.score, CAST(coalesce(n.total_issues, 0) AS BIGINT) AS total_issues
             FROM kept k LEFT JOIN n ON k.project = n.project AND k.file = n.file
             WHERE NOT k.skipped AND NOT k.is_error)"""


def _reviewed(spark, sf):
    kept = A.kept_results(_results(spark, sf), 5)
    return A.file_issue_counts(kept, _file_issues(spark, sf)).select("project", "pos", "file", "score", "total_issues")


@register("analytics.worst_files", oracle_with(f"""
WITH {REVIEWED_SQL}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score, pos) AS rank FROM reviewed) t
WHERE rank <= 5""", "fx_file_results", "fx_file_issues"))
def _worst_files(spark, sf):
    return A.worst_files(_reviewed(spark, sf), 5)


@register("analytics.clean_files", oracle_with(f"""
WITH {REVIEWED_SQL}
SELECT * FROM reviewed WHERE total_issues = 0""", "fx_file_results", "fx_file_issues"))
def _clean_files(spark, sf):
    return A.clean_files(_reviewed(spark, sf))


@register("analytics.important_project_issues", oracle_with(f"""
WITH {REVIEWED_SQL}
SELECT i.project, i.file, i.pos, i.severity, i.title, r.pos AS file_pos,
       row_number() OVER (PARTITION BY i.project ORDER BY {SEV_RANK_SQL.replace('severity', 'i.severity')}, r.pos, i.pos) AS idx
FROM fx_file_issues i JOIN reviewed r ON i.project = r.project AND i.file = r.file
WHERE i.severity IN ('critical', 'high')""", "fx_file_results", "fx_file_issues"))
def _important_project_issues(spark, sf):
    out = A.important_project_issues(_file_issues(spark, sf), _reviewed(spark, sf))
    return out.select("project", "file", "pos", "severity", "title", "file_pos", "idx")


@register("analytics.project_security_score", oracle_with(f"""
WITH {REVIEWED_SQL},
c AS (SELECT i.project, count(*) AS security_like FROM fx_file_issues i
      SEMI JOIN reviewed r ON i.project = r.project AND i.file = r.file
      WHERE lower(i.category) IN ('security', 'injection', 'broken_auth', 'sensitive_data', 'xss', 'secret_leak')
      GROUP BY i.project),
p AS (SELECT DISTINCT project FROM fx_file_results)
SELECT p.project, CAST(coalesce(c.security_like, 0) AS BIGINT) AS security_like,
       CAST(greatest(0, 10 - 2 * coalesce(c.security_like, 0)) AS INT) AS security_score
FROM p LEFT JOIN c ON p.project = c.project""", "fx_file_results", "fx_file_issues"))
def _project_security_score(spark, sf):
    reviewed = _reviewed(spark, sf)
    issues = _file_issues(spark, sf).join(reviewed.select("project", "file"), ["project", "file"], "left_semi")
    projects = _results(spark, sf).select("project").distinct()
    return A.project_security_score(projects, issues)


@register("analytics.progress", oracle_with(f"""
WITH {STREAK_SQL},
tot AS (SELECT project, count(*) AS total FROM fx_file_results GROUP BY project),
n AS (SELECT project, file, count(*) AS total_issues FROM fx_file_issues GROUP BY project, file)
SELECT k.project, k.pos,
       CAST(round(count(*) OVER w * 100.0 / t.total, 0) AS INT) AS pct,
       round(avg(CASE WHEN NOT k.skipped AND NOT k.is_error THEN k.score END) OVER w, 1) AS avg_now,
       CAST(sum(CASE WHEN NOT k.skipped AND NOT k.is_error THEN coalesce(n.total_issues, 0) ELSE 0 END) OVER w AS BIGINT)
         AS issues_now
FROM kept k JOIN tot t ON k.project = t.project LEFT JOIN n ON k.project = n.project AND k.file = n.file
WINDOW w AS (PARTITION BY k.project ORDER BY k.pos ROWS UNBOUNDED PRECEDING)""", "fx_file_results", "fx_file_issues"))
def _progress(spark, sf):
    n = _file_issues(spark, sf).groupBy("project", "file").agg(F.count(F.lit(1)).alias("total_issues"))
    return A.progress(_results(spark, sf), n, 5).select("project", "pos", "pct", "avg_now", "issues_now")
