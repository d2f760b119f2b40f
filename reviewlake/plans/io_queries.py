"""io.*: every reader/writer round-trips data derived from the driver tables through a scratch folder
under ``spark.checkpoint.dir`` (shared storage on a cluster)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import ts_text
from ..operators import analytics as A
from ..sources import io as IO
from ..sources.tables import read_table
from ..session import scratch_path
from . import base
from .analytics_queries import STREAK_SQL
from .fixtures import fixture, oracle_with
from .ingest_queries import ev_oracle, webhooks
from .registry import register


def _scratch(spark, name):
    return scratch_path(spark, f"io/{name}/{uuid.uuid4().hex}")


@register("io.webhooks", ev_oracle("""
SELECT review_id AS event_id,
       CASE WHEN rid % 11 = 0 OR rid % 29 = 0 THEN ''
            ELSE CASE p0 WHEN 'github' THEN 'X-GitHub-Event' WHEN 'gitlab' THEN 'X-Gitlab-Event' WHEN 'bitbucket' THEN 'X-Event-Key' ELSE 'X-VSS-ActivityId' END
       END AS headers,
       rid % 29 <> 0 AND rid % 31 <> 0 AS whole_body
FROM (SELECT review_id, rid, platform AS p0 FROM ev0) e"""))
def _webhooks(spark, sf):
    path = _scratch(spark, "webhooks")
    IO.write_webhooks(webhooks(spark, sf), path)
    back = IO.read_webhooks(spark, path)
    return back.select("event_id", F.array_join(F.array_sort(F.map_keys("headers")), ",").alias("headers"),
                       (F.expr("try_parse_json(body)").isNotNull() & ~F.col("body").contains("zen")).alias("whole_body"))


@register("io.reviews_write", base.oracle_st("""
SELECT r.repo, count(DISTINCT r.review_id) AS reviews, count(i.issue_id) AS issues,
       CAST(coalesce(sum(CAST('0x' || substr(md5(i.issue_id), 1, 8) AS BIGINT)), 0) AS BIGINT) AS issues_hash
FROM st_reviews r LEFT JOIN st_issues i ON r.review_id = i.review_id GROUP BY r.repo"""))
def _reviews_write(spark, sf):
    path = _scratch(spark, "reviews")
    IO.write_reviews(base.st_reviews(spark, sf), base.st_issues(spark, sf), path, mode="overwrite")
    r, i = IO.read_reviews(spark, path)
    ids = i.join(r.select("review_id", "repo"), "review_id").groupBy("repo").agg(
        F.count(F.lit(1)).alias("issues"), F.sum(F.conv(F.substring(F.md5("issue_id"), 1, 8), 16, 10).cast("long")).alias("issues_hash"))
    return r.groupBy("repo").agg(F.count(F.lit(1)).alias("reviews")).join(ids, "repo", "left").fillna(0, ["issues", "issues_hash"])


@register("io.reviews_read", base.oracle_st("""
SELECT review_id, repo, pr_id, platform, author, score, security_score, block_merge, approval, ai_slop,
       strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, target_branch FROM st_reviews"""))
def _reviews_read(spark, sf):
    path = _scratch(spark, "reviews")
    IO.write_reviews(base.st_reviews(spark, sf), base.st_issues(spark, sf), path, mode="overwrite")
    r, _ = IO.read_reviews(spark, path)
    return r.withColumn("created_at", ts_text(F.col("created_at")))


@register("io.files", """
SELECT doc_id, source, octet_length(encode(coalesce(text, '') || chr(10))) AS size_bytes, md5(coalesce(text, '') || chr(10)) AS text_md5 FROM documents""")
def _files(spark, sf):
    """documents written as a source tree (a folder per source and document), scanned back whole."""
    path = _scratch(spark, "tree")
    docs = read_table(spark, sf, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    IO.write_tree(docs, path, ["source", "doc_id"])
    found = IO.read_files(spark, path)
    part = lambda k: F.regexp_extract("path", f"/{k}=([^/]*)/", 1)
    return found.select(part("doc_id").cast("bigint").alias("doc_id"), part("source").alias("source"), "size_bytes", F.md5("text").alias("text_md5"))


@register("io.rules", oracle_with("SELECT filename, content FROM fx_rules UNION ALL SELECT filename, content FROM fx_repo_rules",
                                  "fx_rules", "fx_repo_rules"))
def _rules(spark, sf):
    path = _scratch(spark, "rules")
    docs = fixture(spark, sf, "fx_rules").unionByName(fixture(spark, sf, "fx_repo_rules"))
    # one folder per document: filename=<name>/part-*.txt; read back as whole texts
    docs.repartition("filename").write.partitionBy("filename").text(path)
    return IO.read_rules(spark, path)


@register("io.ignore_file", oracle_with("""
SELECT p.project, i.pattern FROM (SELECT DISTINCT project FROM fx_files) p CROSS JOIN fx_ignore i""", "fx_files", "fx_ignore"))
def _ignore_file(spark, sf):
    """Per-project ignore files (with comments and blank lines) written as text; proj0 has none and
    inherits the default patterns."""
    path = _scratch(spark, "ignore")
    pats = fixture(spark, sf, "fx_ignore")
    projects = fixture(spark, sf, "fx_files").select("project").distinct()
    raw = (projects.filter(F.col("project") != "proj0").withColumn("_k", F.lit(1))
           .join(F.broadcast(pats.withColumn("_k", F.lit(1))), "_k")
           .select("project", F.concat(F.lit("  "), F.col("pattern"), F.lit("\t")).alias("value")))
    extra = projects.select("project", F.lit("# comment").alias("value")).unionByName(
        projects.select("project", F.lit("   ").alias("value")))
    raw.unionByName(extra).write.partitionBy("project").text(path)
    own = IO.read_ignore(spark, path)
    return IO.effective_ignore(own, pats, projects)


@register("io.events", oracle_with("""
SELECT run_id, event_id, seq, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, level, step, message,
       CASE WHEN event_id % 3 = 0 THEN 'event=' || CAST(event_id AS VARCHAR) || ';step=' || step END AS meta FROM fx_run_events""", "fx_run_events"))
def _events(spark, sf):
    path = _scratch(spark, "events")
    meta = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("event"), F.col("event_id").cast("string"), F.lit("step"), F.col("step")))
    IO.write_events(fixture(spark, sf, "fx_run_events").withColumn("meta", meta), path)
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return IO.read_events(spark, path).withColumn("ts", ts_text(F.col("ts"))).withColumn("meta", flat)


@register("io.report_json", oracle_with(f"""
WITH {STREAK_SQL},
st AS (SELECT project, CASE WHEN max(break_pos) IS NOT NULL THEN 'failed'
              WHEN sum(CASE WHEN is_error THEN 1 ELSE 0 END) > sum(CASE WHEN NOT skipped AND NOT is_error THEN 1 ELSE 0 END) THEN 'failed' ELSE 'done' END AS status
       FROM kept GROUP BY project)
SELECT st.project, st.status, count(*) AS results, CAST(sum(k.score) AS BIGINT) AS scores FROM st JOIN kept k ON st.project = k.project GROUP BY st.project, st.status""",
                                        "fx_file_results"))
def _report_json(spark, sf):
    path = _scratch(spark, "report")
    results = fixture(spark, sf, "fx_file_results")
    summary = A.project_status(A.project_summary(results, fixture(spark, sf, "fx_file_issues")))
    IO.write_report(summary, results, path)
    head, rows = IO.read_report(spark, path)
    per = rows.groupBy("project").agg(F.count(F.lit(1)).alias("results"), F.sum("score").alias("scores"))
    return head.select("project", "status").join(per, "project")
