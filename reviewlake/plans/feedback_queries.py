"""feedback.*: per-repo pattern reports over the whole history."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import ts_text
from ..operators import analytics as A
from ..operators import feedback as Fb
from . import base
from .fixtures import fixture
from .registry import register

WINDOW_SQL = """
WITH iw AS (SELECT i.*, r.repo, r.pr_id, r.created_at AS review_ts FROM st_issues i JOIN st_reviews r ON r.review_id = i.review_id),
rw AS (SELECT * FROM st_reviews)"""


def fb_oracle(body: str, *extra: str) -> str:
    b = body.strip()
    if b[:4].upper() == "WITH":
        b = "," + b[4:]
    else:
        b = "\n" + b
    return base.oracle_st(WINDOW_SQL + b, *extra)


def _win(spark, sf):
    return Fb.feedback_window(base.st_reviews(spark, sf), base.st_issues(spark, sf))


@register("feedback.window", fb_oracle(f"""
SELECT * FROM (
  SELECT 'issue' AS kind, repo, issue_id AS id, strftime(review_ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,
         row_number() OVER (PARTITION BY repo ORDER BY review_ts DESC, review_id DESC, pos, issue_id) AS rank FROM iw) i WHERE rank <= 200
UNION ALL
SELECT * FROM (
  SELECT 'review' AS kind, repo, review_id AS id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS ts,
         row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, review_id DESC) AS rank FROM rw) r WHERE rank <= 100"""))
def _window(spark, sf):
    """The newest 200 issues and 100 reviews of each repo."""
    iw, rw = Fb.feedback_window(base.st_reviews(spark, sf), base.st_issues(spark, sf), 200, 100)
    return (iw.select(F.lit("issue").alias("kind"), "repo", F.col("issue_id").alias("id"),
                      ts_text(F.col("review_ts")).alias("ts"), "rank")
            .unionByName(rw.select(F.lit("review").alias("kind"), "repo", F.col("review_id").alias("id"),
                                   ts_text(F.col("created_at")).alias("ts"), "rank")))


@register("feedback.category_frequency", fb_oracle(
    "SELECT repo, coalesce(category, 'general') AS category, count(*) AS count FROM iw GROUP BY 1, 2"))
def _category_frequency(spark, sf):
    return Fb.category_frequency(_win(spark, sf)[0])


@register("feedback.severity_distribution", fb_oracle(
    "SELECT repo, coalesce(severity, 'info') AS severity, count(*) AS count FROM iw GROUP BY 1, 2"))
def _severity_distribution(spark, sf):
    return Fb.severity_distribution(_win(spark, sf)[0])


@register("feedback.owasp_frequency", fb_oracle(
    "SELECT repo, owasp_id, count(*) AS count FROM iw WHERE owasp_id IS NOT NULL AND owasp_id <> '' GROUP BY 1, 2"))
def _owasp_frequency(spark, sf):
    return Fb.owasp_frequency(_win(spark, sf)[0])


@register("feedback.threat_frequency", fb_oracle(
    "SELECT repo, threat_type, count(*) AS count FROM iw WHERE threat_type IS NOT NULL AND threat_type <> '' GROUP BY 1, 2"))
def _threat_frequency(spark, sf):
    return Fb.threat_frequency(_win(spark, sf)[0])


@register("feedback.file_hotspots", fb_oracle("""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY count DESC, file_path, category) AS rank FROM (
    SELECT repo, file_path, coalesce(category, 'general') AS category, count(*) AS count
    FROM iw WHERE file_path IS NOT NULL AND file_path <> '' GROUP BY 1, 2, 3) g) t
WHERE rank <= 15"""))
def _file_hotspots(spark, sf):
    return Fb.file_hotspots(_win(spark, sf)[0], 15)


PARENT_SQL = """
  CASE WHEN p NOT LIKE '%/%' THEN '.'
       ELSE coalesce(nullif(regexp_extract(p, '^(.*)/[^/]*$', 1), ''), '/') END"""


@register("feedback.directory_hotspots", fb_oracle(f"""
WITH d AS (
  SELECT repo, {PARENT_SQL} AS directory
  FROM (SELECT repo, regexp_replace(regexp_replace(regexp_replace(regexp_replace(file_path, '/+', '/', 'g'),
                                                                  '(^|/)(\\./)+', '\\1', 'g'), '/\\.$', ''), '(.)/$', '\\1')
               AS p
        FROM iw WHERE file_path IS NOT NULL AND file_path <> '') x)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY count DESC, directory) AS rank FROM (
    SELECT repo, directory, count(*) AS count FROM d WHERE directory <> '.' AND directory <> '' GROUP BY 1, 2) g) t
WHERE rank <= 10"""))
def _directory_hotspots(spark, sf):
    return Fb.directory_hotspots(_win(spark, sf)[0], 10)


STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _strip(x: str) -> str:
    return STRIP.format(x=x)


TITLE_SQL = ("regexp_replace(" + _strip(
    "regexp_replace(" + _strip("regexp_replace(coalesce(title, ''), '(CRITICAL:\\s*)', '', 'g')")
    + ", '\\s*\\(.*?\\)\\s*', ' ', 'g')") + ", '(?i)line \\d+', 'line N', 'g')")


@register("feedback.recurring_titles", fb_oracle(f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY count DESC, title_pattern) AS rank FROM (
    SELECT repo, title_pattern, count(*) AS count FROM (SELECT repo, {TITLE_SQL} AS title_pattern FROM iw) x
    WHERE title_pattern <> '' GROUP BY 1, 2) g) t
WHERE rank <= 10"""))
def _recurring_titles(spark, sf):
    return Fb.recurring_titles(_win(spark, sf)[0], 10)


@register("feedback.review_stats", fb_oracle("""
SELECT repo, count(*) AS total_reviews, round(avg(score), 1) AS avg_score,
       round(avg(security_score), 1) AS avg_security_score,
       round(sum(CASE WHEN block_merge THEN 1 ELSE 0 END) / count(*) * 100, 1) AS block_rate
FROM rw GROUP BY repo"""))
def _review_stats(spark, sf):
    return Fb.review_stats(_win(spark, sf)[1])


def _list_text(c: str, *fields: str):
    return F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws("|", *[x[f].cast("string") for f in fields])), ";"), F.lit(""))


def _list_sql(keys: str, where: str = "true", n: int | None = None) -> str:
    names = [k.split(" AS ")[-1] for k in re.split(r", (?!')", keys)]
    text = " || '|' || ".join([*names, "CAST(c AS VARCHAR)"])
    return f"""(SELECT repo, string_agg({text}, ';' ORDER BY r) AS t FROM (
      SELECT *, row_number() OVER (PARTITION BY repo ORDER BY c DESC, {', '.join(names)}) AS r
      FROM (SELECT repo, {keys}, count(*) AS c FROM iw2 WHERE {where} GROUP BY ALL) g) h {f'WHERE r <= {n}' if n else ''} GROUP BY repo)"""


@register("feedback.report", fb_oracle(f"""
WITH d AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(file_path, '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g'), '/\\.$', ''),
                                    '(.)/$', '\\1') AS p FROM iw),
iw2 AS (SELECT *, {PARENT_SQL} AS directory, {TITLE_SQL} AS title_pattern FROM d),
st AS (SELECT repo, count(*) AS total_reviews, round(avg(score), 1) AS avg_score, round(avg(security_score), 1) AS avg_security_score,
              round(sum(CASE WHEN block_merge THEN 1 ELSE 0 END) / count(*) * 100, 1) AS block_rate FROM rw GROUP BY repo)
SELECT st.*, CAST(coalesce(n.c, 0) AS BIGINT) AS total_issues_analyzed, coalesce(a.t, '') AS category_frequency, coalesce(s.t, '') AS severity_distribution,
       coalesce(o.t, '') AS owasp_frequency, coalesce(h.t, '') AS threat_type_frequency, coalesce(f.t, '') AS file_hotspots,
       coalesce(e.t, '') AS directory_hotspots, coalesce(t.t, '') AS top_recurring_titles
FROM st LEFT JOIN (SELECT repo, count(*) AS c FROM iw GROUP BY repo) n ON st.repo = n.repo
LEFT JOIN {_list_sql("coalesce(category, 'general') AS category")} a ON st.repo = a.repo
LEFT JOIN (SELECT repo, string_agg(severity || '=' || c, ';' ORDER BY severity) AS t FROM (SELECT repo, severity, count(*) AS c FROM iw GROUP BY 1, 2) x GROUP BY repo) s
  ON st.repo = s.repo
LEFT JOIN {_list_sql("owasp_id", "owasp_id <> ''")} o ON st.repo = o.repo
LEFT JOIN {_list_sql("threat_type", "threat_type <> ''")} h ON st.repo = h.repo
LEFT JOIN {_list_sql("file_path, coalesce(category, 'general') AS category", "file_path <> ''", Fb.REPORT_FILES)} f ON st.repo = f.repo
LEFT JOIN {_list_sql("directory", "file_path <> '' AND directory <> '.' AND directory <> ''", Fb.REPORT_DIRECTORIES)} e ON st.repo = e.repo
LEFT JOIN {_list_sql("title_pattern", "title_pattern <> ''", Fb.REPORT_TITLES)} t ON st.repo = t.repo"""))
def _report(spark, sf):
    """Nested lists leave as text in their order."""
    r = Fb.report(base.st_reviews(spark, sf), base.st_issues(spark, sf))
    severity = F.array_join(F.transform(F.array_sort(F.map_entries("severity_distribution")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return r.select("repo", "review_stats.*", "total_issues_analyzed", F.coalesce(severity, F.lit("")).alias("severity_distribution"),
                    *[_list_text(c, *f).alias(c) for c, f in {
                        "category_frequency": ["category", "count"], "owasp_frequency": ["owasp_id", "count"], "threat_type_frequency": ["threat_type", "count"],
                        "file_hotspots": ["file_path", "category", "count"], "directory_hotspots": ["directory", "count"],
                        "top_recurring_titles": ["title_pattern", "count"]}.items()])


def _counts(spark, sf):
    return A.repo_review_count(base.st_reviews(spark, sf))


@register("feedback.should_evolve", base.oracle_st("""
SELECT c.repo, c.cnt, r.filename IS NOT NULL AS has_rule,
       CASE WHEN c.cnt = 0 THEN false WHEN r.filename IS NULL THEN c.cnt >= 3 ELSE c.cnt % 10 = 0 END AS should_evolve
FROM (SELECT repo, count(*) AS cnt FROM st_reviews GROUP BY repo) c
LEFT JOIN fx_repo_rules r ON replace(replace(c.repo, '/', '_'), '\\', '_') || '.md' = r.filename""", "fx_repo_rules"))
def _should_evolve(spark, sf):
    return Fb.should_evolve(_counts(spark, sf), fixture(spark, sf, "fx_repo_rules"), 10)


@register("feedback.evolve_decision", fb_oracle("""
SELECT c.repo, c.cnt, CAST(coalesce(a.n, 0) AS BIGINT) AS total_issues_analyzed,
       CASE WHEN c.cnt = 0 OR coalesce(a.n, 0) < 3 THEN 'skipped' ELSE 'ready' END AS status,
       CASE WHEN c.cnt = 0 THEN 'no_review_data' WHEN coalesce(a.n, 0) < 3 THEN 'insufficient_data' END AS reason
FROM (SELECT repo, count(*) AS cnt FROM st_reviews GROUP BY repo) c
LEFT JOIN (SELECT repo, count(*) AS n FROM iw GROUP BY repo) a ON c.repo = a.repo"""))
def _evolve_decision(spark, sf):
    iw, _ = _win(spark, sf)
    analyzed = iw.groupBy("repo").agg(F.count(F.lit(1)).alias("total_issues_analyzed"))
    return Fb.evolve_decision(_counts(spark, sf), analyzed, force=False)


@register("feedback.rule_key", base.oracle_st("""
SELECT DISTINCT repo, replace(replace(repo, '/', '_'), '\\', '_') AS rule_key FROM st_reviews"""))
def _rule_key(spark, sf):
    return base.st_reviews(spark, sf).select("repo", Fb.rule_key(F.col("repo")).alias("rule_key")).distinct()


@register("feedback.evolution_request", fb_oracle("""
SELECT r.repo, CAST(coalesce(n.c, 0) AS BIGINT) AS issues,
       'text of security.md' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'text of compilation.md' || chr(10) || chr(10) || '---' || chr(10)
       || chr(10) || 'text of best-practices.md' AS base_rules
FROM (SELECT DISTINCT repo FROM st_reviews) r LEFT JOIN (SELECT repo, count(*) AS c FROM iw GROUP BY repo) n ON r.repo = n.repo"""))
def _evolution_request(spark, sf):
    rep = Fb.report(base.st_reviews(spark, sf), base.st_issues(spark, sf))
    out = Fb.evolution_request(rep, fixture(spark, sf, "fx_rules"))
    return out.select("repo", F.get_json_object("report_json", "$.total_issues_analyzed").cast("bigint").alias("issues"), "base_rules")
