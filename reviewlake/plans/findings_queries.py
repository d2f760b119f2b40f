"""findings.*: model response text -> reviews and issues.

Spark builds the response text from fx_reviews + fx_issues ('Here is my review: {json} end', with
'no json here' for review_id % 19 = 0 and '{bad json}' for % 23 = 0); the oracles read the same
columns straight from the fixtures, so the whole parse -> normalise -> validate path is checked.
Some responses have wrong types and shapes, by the review id: issues is a text (% 43 = 0), a list of
texts (% 61), or one issue with a numeric title (% 67); the score is null (% 47) or 7.5 (% 53); the
approval is "maybe" (% 41).
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as Fd
from .fixtures import fixture, oracle_with
from .registry import register

ISSUE_JSON_FIELDS = ["severity", "title", "description", "file_path", "line_number", "category", "owasp_id", "threat_type"]


def responses(spark, sf):
    """fx_responses: one model response per review (plus the reviewed file name for file mode)."""
    rev = fixture(spark, sf, "fx_reviews")
    iss = fixture(spark, sf, "fx_issues").withColumnRenamed("raw_severity", "severity")
    per = (iss.groupBy("review_id")
           .agg(F.array_sort(F.collect_list(F.struct("pos", *ISSUE_JSON_FIELDS))).alias("_i"))
           .select("review_id", F.transform("_i", lambda x: F.struct(*[x[f].alias(f) for f in ISSUE_JSON_FIELDS]))
                   .alias("issues")))
    j = rev.join(per, "review_id", "left")
    rid = F.col("review_id").cast("bigint")
    issues_json = (F.when(rid % 43 == 0, F.lit('"none"')).when(rid % 61 == 0, F.lit('["x"]'))
                   .when(rid % 67 == 0, F.lit('[{"severity":"low","title":5,"description":"d"}]'))
                   .otherwise(F.to_json(F.coalesce(F.col("issues"), F.array()))))
    score_json = F.when(rid % 47 == 0, F.lit("null")).when(rid % 53 == 0, F.lit("7.5")).otherwise(F.col("score").cast("string"))
    approval_json = F.when(rid % 41 == 0, F.lit('"maybe"')).otherwise(F.col("approval_recommended").cast("string"))
    body = F.concat(F.lit('{"summary":"summary '), F.col("review_id"), F.lit('","score":'), score_json, F.lit(',"issues":'), issues_json,
                    F.lit(',"approval_recommended":'), approval_json, F.lit(',"block_merge":'), F.col("model_block_merge").cast("string"), F.lit("}"))
    text = (F.when(rid % 19 == 0, F.lit("no json here")).when(rid % 23 == 0, F.lit("{bad json}"))
            .otherwise(F.concat(F.lit("Here is my review: "), body, F.lit(" end"))))
    return j.select("review_id", "platform", text.alias("response"),
                    F.concat(F.lit("src/review"), F.col("review_id"), F.lit(".py")).alias("file"))


def _parsed(spark, sf, mode="pr"):
    return Fd.parse_response(responses(spark, sf), mode=mode)


def _norm_issues(spark, sf):
    return Fd.cap_slop(Fd.normalize_severity(Fd.explode_issues(_parsed(spark, sf))))


def _pr(spark, sf):
    return Fd.review_responses(responses(spark, sf), "pr")


# ----------------------------------------------------------------------- oracle building blocks

STATUS_SQL = """CASE WHEN CAST(review_id AS BIGINT) % 19 = 0 THEN 'no_json'
            WHEN CAST(review_id AS BIGINT) % 23 = 0 THEN 'malformed' ELSE 'ok' END"""
SEV_SQL = """CASE lower(raw_severity) WHEN 'information' THEN 'info' WHEN 'minor' THEN 'low'
                                   WHEN 'major' THEN 'high' ELSE lower(raw_severity) END"""
SC_FLAG = "(severity = 'critical' AND lower(coalesce(category, '')) IN ('compilation', 'syntax'))"
RID = "CAST(review_id AS BIGINT)"
# the issues as the responses return them
RAW_CTE = f"""
raw AS (SELECT review_id, pos, raw_severity, title, description, file_path, line_number, category, owasp_id, threat_type
        FROM fx_issues WHERE {STATUS_SQL} = 'ok' AND {RID} % 43 <> 0 AND {RID} % 61 <> 0 AND {RID} % 67 <> 0
        UNION ALL
        SELECT review_id, 1, 'low', '5', 'd', NULL, NULL, NULL, NULL, NULL
        FROM fx_reviews WHERE {STATUS_SQL} = 'ok' AND {RID} % 43 <> 0 AND {RID} % 61 <> 0 AND {RID} % 67 = 0)"""
# why a response is invalid
FAIL_SQL = f"""CASE WHEN {STATUS_SQL} <> 'ok' THEN NULL WHEN {RID} % 43 = 0 THEN 'issues_not_list' WHEN {RID} % 61 = 0 THEN 'issue_not_object'
            WHEN {RID} % 47 = 0 OR {RID} % 53 = 0 THEN 'bad_score' WHEN {RID} % 41 = 0 THEN 'bad_approval'
            WHEN {RID} % 67 = 0 THEN 'bad_title' END"""
PR_CTES = f"""
{RAW_CTE.strip()},
resp AS (SELECT *, {STATUS_SQL} AS parse_status, {FAIL_SQL} AS fail FROM fx_reviews),
norm AS (SELECT review_id, pos, category, file_path, line_number, owasp_id, threat_type, title AS title0,
                description AS desc0, s0 AS severity0,
                CASE WHEN category = 'ai_slop' AND s0 IN ('critical', 'high') THEN 'medium' ELSE s0 END AS severity
         FROM (SELECT *, {SEV_SQL} AS s0 FROM raw) i),
marked AS (SELECT *,
  CASE WHEN severity = 'critical' AND NOT (starts_with(coalesce(desc0, ''), 'CRITICAL') OR starts_with(coalesce(desc0, ''), '🚨')
            OR starts_with(coalesce(desc0, ''), '❌') OR starts_with(coalesce(desc0, ''), 'critical'))
       THEN '🚨 CRITICAL: ' || coalesce(desc0, '') ELSE desc0 END AS description,
  CASE WHEN severity = 'critical' AND NOT (starts_with(coalesce(title0, ''), 'CRITICAL') OR starts_with(coalesce(title0, ''), '🚨')
            OR starts_with(coalesce(title0, ''), '❌'))
       THEN 'CRITICAL: ' || coalesce(title0, '') ELSE title0 END AS title
  FROM norm),
sc_issues AS (SELECT * FROM (SELECT *, bool_or({SC_FLAG}) OVER (PARTITION BY review_id) AS sc FROM marked) x
              WHERE NOT sc OR {SC_FLAG}),
pr_issues AS (SELECT * FROM sc_issues WHERE review_id NOT IN (SELECT review_id FROM resp WHERE fail IS NOT NULL)),
pr_roll AS (SELECT review_id, count(*) AS n,
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
       bool_or(coalesce(threat_type = 'secret_leak', false)) AS secret,
       string_agg(DISTINCT CASE WHEN owasp_id <> '' THEN owasp_id END, ',' ORDER BY CASE WHEN owasp_id <> '' THEN owasp_id END)
         AS hits
  FROM pr_issues GROUP BY review_id),
pr_reviews AS (
  SELECT r.review_id, r.platform, r.parse_status, r.fail,
         CASE WHEN r.fail IS NOT NULL THEN 0 WHEN r.parse_status = 'no_json' THEN 7 WHEN r.parse_status = 'malformed' THEN 5 ELSE r.score END AS score,
         CASE WHEN r.fail IS NOT NULL THEN true WHEN r.parse_status = 'ok' THEN r.model_block_merge ELSE false END AS stated_block,
         CASE WHEN r.fail IS NOT NULL THEN '🚨 Review failed: validation error' WHEN r.parse_status = 'no_json' THEN 'no json here' WHEN r.parse_status = 'malformed' THEN 'Failed to parse AI response'
              ELSE 'summary ' || r.review_id END AS summary0,
         CASE WHEN r.fail IS NOT NULL THEN false WHEN r.parse_status = 'no_json' THEN true WHEN r.parse_status = 'malformed' THEN false ELSE r.approval_recommended END
           AS approval_recommended,
         CAST(coalesce(p.n, 0) AS BIGINT) AS total_issues, CAST(coalesce(p.n_critical, 0) AS BIGINT) AS critical_count,
         CAST(coalesce(p.n_high, 0) AS BIGINT) AS high_count, CAST(coalesce(p.n_medium, 0) AS BIGINT) AS medium_count,
         CAST(coalesce(p.n_low, 0) AS BIGINT) AS low_count, CAST(coalesce(p.n_info, 0) AS BIGINT) AS info_count,
         CAST(coalesce(p.n_slop, 0) AS BIGINT) AS ai_slop_count, CAST(coalesce(p.n_sec, 0) AS BIGINT) AS security_issues_count,
         CAST(CASE WHEN coalesce(p.n_sec, 0) = 0 THEN 10 ELSE greatest(0, 10 - p.pen) END AS INT) AS security_score,
         coalesce(p.secret, false) AS secret_leak_detected, coalesce(p.hits, '') AS owasp_hits
  FROM resp r LEFT JOIN pr_roll p ON r.review_id = p.review_id),
pr_final AS (SELECT *, (stated_block OR critical_count > 0) AS block_merge FROM pr_reviews)"""


def pr_oracle(body: str) -> str:
    return oracle_with("WITH " + PR_CTES.strip() + ",\n" + body.strip()[4:].lstrip() if body.strip()[:4].upper() == "WITH"
                       else "WITH " + PR_CTES.strip() + "\n" + body, "fx_reviews", "fx_issues")


# ----------------------------------------------------------------------- queries

@register("findings.extract_json", oracle_with(f"SELECT review_id, {STATUS_SQL} AS parse_status FROM fx_reviews", "fx_reviews"))
def _extract_json(spark, sf):
    return Fd.extract_json(responses(spark, sf)).select("review_id", "parse_status")


@register("findings.explode_issues", pr_oracle("""
SELECT review_id, pos, raw_severity AS severity, title, description, file_path, line_number, category, owasp_id, threat_type FROM raw"""))
def _explode_issues(spark, sf):
    e = Fd.explode_issues(_parsed(spark, sf))
    return e.select("review_id", "pos", "severity", "title", "description", "file_path",
                    F.col("line_number").try_cast("int").alias("line_number"), "category", "owasp_id", "threat_type")


@register("findings.defaults", oracle_with(f"""
SELECT review_id,
       CASE s WHEN 'no_json' THEN 'no json here' WHEN 'malformed' THEN 'Failed to parse AI response'
              ELSE 'summary ' || review_id END AS summary,
       CASE s WHEN 'no_json' THEN '7' WHEN 'malformed' THEN '5'
              ELSE CASE WHEN {RID} % 47 = 0 THEN '7' WHEN {RID} % 53 = 0 THEN '7.5' ELSE CAST(score AS VARCHAR) END END AS score,
       CASE s WHEN 'no_json' THEN true WHEN 'malformed' THEN false ELSE {RID} % 41 = 0 OR approval_recommended END AS approval_recommended,
       CASE s WHEN 'ok' THEN model_block_merge ELSE false END AS stated_block,
       CASE WHEN fail IN ('issues_not_list', 'bad_score', 'bad_approval') THEN fail
            WHEN fail IS NULL OR s <> 'ok' THEN NULL
            WHEN {RID} % 47 = 0 OR {RID} % 53 = 0 THEN 'bad_score' WHEN {RID} % 41 = 0 THEN 'bad_approval' END AS response_failure
FROM (SELECT *, {STATUS_SQL} AS s, {FAIL_SQL} AS fail FROM fx_reviews) r""", "fx_reviews"))
def _defaults(spark, sf):
    p = _parsed(spark, sf)
    return p.select("review_id", "summary", F.col("score_text").alias("score"), "approval_recommended", "stated_block", "response_failure")


@register("findings.normalize_severity", pr_oracle(f"SELECT review_id, pos, {SEV_SQL} AS severity FROM raw"))
def _normalize_severity(spark, sf):
    return Fd.normalize_severity(Fd.explode_issues(_parsed(spark, sf))).select("review_id", "pos", "severity")


@register("findings.cap_slop", pr_oracle("SELECT review_id, pos, severity FROM norm"))
def _cap_slop(spark, sf):
    return _norm_issues(spark, sf).select("review_id", "pos", "severity")


@register("findings.mark_critical", pr_oracle("SELECT review_id, pos, title, description FROM marked"))
def _mark_critical(spark, sf):
    return Fd.mark_critical(_norm_issues(spark, sf)).select("review_id", "pos", "title", "description")


@register("findings.default_path", pr_oracle("""
SELECT review_id, pos, CASE WHEN file_path IS NULL OR file_path = '' THEN 'src/review' || review_id || '.py'
                            ELSE file_path END AS file_path
FROM raw"""))
def _default_path(spark, sf):
    p = _parsed(spark, sf, "file")
    e = p.select("review_id", "file", F.posexplode_outer("raw_issues").alias("pos0", "i")).where("i.is_object").select(
        "review_id", "file", (F.col("pos0") + 1).cast("int").alias("pos"), F.col("i.file_path").alias("file_path"))
    return Fd.default_path(e, "file").select("review_id", "pos", "file_path")


@register("findings.short_circuit", pr_oracle("SELECT review_id, pos, severity, category FROM sc_issues"))
def _short_circuit(spark, sf):
    return Fd.short_circuit(Fd.mark_critical(_norm_issues(spark, sf))).select("review_id", "pos", "severity", "category")


@register("findings.validate", pr_oracle("SELECT review_id, fail AS failure_reason, CAST(score AS INT) AS score FROM pr_reviews"))
def _validate(spark, sf):
    reviews, _ = _pr(spark, sf)
    return reviews.select("review_id", "failure_reason", "score")


@register("findings.review_mode", pr_oracle(f"""
SELECT review_id, 'pr' AS mode, total_issues, block_merge, score FROM pr_final
UNION ALL
SELECT r.review_id, 'file' AS mode, CAST(coalesce(n.n, 0) AS BIGINT) AS total_issues, r.stated_block AS block_merge, r.score
FROM pr_reviews r LEFT JOIN (SELECT review_id, count(*) AS n FROM norm GROUP BY review_id) n ON r.review_id = n.review_id AND r.fail IS NULL"""))
def _review_mode(spark, sf):
    resp = responses(spark, sf)
    pr, _ = Fd.review_responses(resp, "pr")
    fm, _ = Fd.review_responses(resp, "file")
    cols = ["review_id", "total_issues", "block_merge", "score"]
    return (pr.select(*cols).withColumn("mode", F.lit("pr"))
            .unionByName(fm.select(*cols).withColumn("mode", F.lit("file"))))


ROLL_COLS = ["review_id", "total_issues", "critical_count", "high_count", "medium_count", "low_count", "info_count",
             "ai_slop_count", "security_issues_count"]


@register("findings.rollup", pr_oracle(f"""
SELECT {', '.join(ROLL_COLS)}, ai_slop_count > 0 AS ai_slop_detected FROM pr_reviews"""))
def _rollup(spark, sf):
    reviews, _ = _pr(spark, sf)
    return reviews.select(*ROLL_COLS, "ai_slop_detected")


@register("findings.security_score", pr_oracle("SELECT review_id, security_score FROM pr_reviews"))
def _security_score(spark, sf):
    return _pr(spark, sf)[0].select("review_id", "security_score")


@register("findings.secret_flag", pr_oracle("SELECT review_id, secret_leak_detected FROM pr_reviews"))
def _secret_flag(spark, sf):
    return _pr(spark, sf)[0].select("review_id", "secret_leak_detected")


@register("findings.owasp_hits", pr_oracle("SELECT review_id, owasp_hits FROM pr_reviews"))
def _owasp_hits(spark, sf):
    # the sorted id set leaves as comma-joined text
    return _pr(spark, sf)[0].select("review_id", F.array_join("owasp_hits", ",").alias("owasp_hits"))


@register("findings.block_merge", pr_oracle("SELECT review_id, block_merge FROM pr_final"))
def _block_merge(spark, sf):
    return _pr(spark, sf)[0].select("review_id", "block_merge")


@register("findings.critical_summary", pr_oracle("""
WITH crit AS (
  SELECT review_id, count(*) AS n,
         string_agg(k || '. ' || coalesce(title, 'Unknown issue') || ' - ' || coalesce(description, '')
                    || '...' || chr(10), '' ORDER BY pos) AS items
  FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY pos) AS k FROM pr_issues WHERE severity = 'critical') c
  GROUP BY review_id)
SELECT r.review_id,
       CASE WHEN c.n IS NULL THEN r.summary0
            ELSE '🚨 CRITICAL ERRORS FOUND (' || CAST(c.n AS VARCHAR) || '):' || chr(10) || c.items || chr(10) || r.summary0 END
         AS summary
FROM pr_reviews r LEFT JOIN crit c ON r.review_id = c.review_id"""))
def _critical_summary(spark, sf):
    return _pr(spark, sf)[0].select("review_id", "summary")


STATUS_BODY = """
SELECT review_id, CASE WHEN block_merge THEN 'failure' ELSE 'success' END AS state,
       CASE WHEN block_merge THEN 'Critical issues found - merge blocked'
            WHEN score >= 8 THEN 'Code quality: ' || CAST(score AS VARCHAR) || '/10'
            ELSE 'Review complete: ' || CAST(score AS VARCHAR) || '/10' END AS status_message,
       CASE WHEN block_merge THEN 'BLOCKED' WHEN score >= 8 THEN 'APPROVED' ELSE 'REVIEW NEEDED' END AS verdict,
       platform
FROM pr_final"""


@register("findings.status", pr_oracle(f"SELECT review_id, state, status_message, verdict FROM ({STATUS_BODY}) s"))
def _status(spark, sf):
    return Fd.status(_pr(spark, sf)[0]).select("review_id", "state", "status_message", "verdict")


@register("findings.platform_status", pr_oracle(f"""
SELECT review_id, platform, state,
       CASE WHEN platform = 'gitlab' AND state = 'failure' THEN 'failed'
            WHEN platform = 'bitbucket' AND state = 'success' THEN 'SUCCESSFUL'
            WHEN platform = 'bitbucket' AND state = 'failure' THEN 'FAILED'
            ELSE state END AS platform_state
FROM ({STATUS_BODY}) s"""))
def _platform_status(spark, sf):
    return Fd.platform_status(Fd.status(_pr(spark, sf)[0])).select("review_id", "platform", "state", "platform_state")


@register("findings.security_view", pr_oracle("""
SELECT review_id, count(*) AS vulnerabilities_found,
       CAST(sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical_count,
       CAST(sum(CASE WHEN severity = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS high_count
FROM pr_issues WHERE category = 'security' GROUP BY review_id"""))
def _security_view(spark, sf):
    _, issues = _pr(spark, sf)
    return Fd.security_view(issues)[1]
