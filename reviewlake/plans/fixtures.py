"""Deterministic fixture views derived from the driver tables.

Each fixture is one portable SQL text (Spark SQL and DuckDB accept both).  Table names are
``{placeholders}``: Spark binds them to DataFrames read from ``sf_dir`` (``spark.sql(text, t=df)``),
the oracle side binds them to the pre-registered DuckDB views.  A fixture is *input*; the operators
under test are DataFrame functions in ``reviewlake.operators`` and never appear here.
"""
from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import read_table

FX_SQL: dict[str, str] = {}
FX_DEPS: dict[str, list[str]] = {}

FX_SQL["fx_reviews"] = """
SELECT CAST(o_orderkey AS STRING) AS review_id,
       'org' || CAST(o_custkey % 5 AS STRING) || '/repo' || CAST(o_custkey % 25 AS STRING) AS repo,
       CAST(o_custkey AS STRING) AS pr_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'bitbucket' ELSE 'azure' END AS platform,
       CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'dev' || CAST(o_custkey % 40 AS STRING) END AS author,
       CAST(o_orderkey % 11 AS INT) AS score,
       (o_orderkey % 13 = 0) AS model_block_merge,
       (o_orderkey % 3 <> 0) AS approval_recommended,
       CASE o_custkey % 6 WHEN 0 THEN 'main' WHEN 1 THEN 'master' WHEN 2 THEN 'develop' WHEN 3 THEN 'preprod'
                          WHEN 4 THEN 'production' ELSE 'feature/x' END AS target_branch,
       o_orderdate AS created_at
FROM {orders}
"""

FX_SQL["fx_issues"] = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-'
         || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) AS issue_id,
       CAST(l_orderkey AS STRING) AS review_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS pos,
       CASE l_partkey % 8 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'high' WHEN 2 THEN 'Major' WHEN 3 THEN 'medium'
                          WHEN 4 THEN 'minor' WHEN 5 THEN 'low' WHEN 6 THEN 'information' ELSE 'info' END AS raw_severity,
       CASE l_suppkey % 10 WHEN 0 THEN 'security' WHEN 1 THEN 'performance' WHEN 2 THEN 'bugs' WHEN 3 THEN 'ai_slop'
                           WHEN 4 THEN 'compilation' WHEN 5 THEN 'best_practices' WHEN 6 THEN 'style'
                           WHEN 7 THEN 'injection' WHEN 8 THEN 'general' ELSE 'syntax' END AS category,
       CASE l_linenumber % 4 WHEN 0 THEN 'CRITICAL: SQL Injection (user input) at line ' || CAST(l_partkey % 50 AS STRING)
                             WHEN 1 THEN 'Missing await keyword'
                             WHEN 2 THEN 'Unused import (os) Line ' || CAST(l_partkey % 50 AS STRING)
                             ELSE 'Magic number' END AS title,
       'part ' || CAST(l_partkey % 12 AS STRING) AS description,
       CASE l_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'main.py'
            ELSE 'src/mod' || CAST(l_suppkey % 6 AS STRING) || '/file' || CAST(l_partkey % 20 AS STRING) || '.py' END AS file_path,
       CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_linenumber * 10 AS INT) END AS line_number,
       CASE WHEN l_suppkey % 10 = 0 THEN 'A0' || CAST(1 + l_linenumber % 9 AS STRING)
            WHEN l_suppkey % 10 = 7 THEN 'A10' WHEN l_suppkey % 10 = 1 THEN '' ELSE NULL END AS owasp_id,
       CASE WHEN l_suppkey % 10 = 0 AND l_partkey % 5 = 0 THEN 'secret_leak'
            WHEN l_suppkey % 10 = 7 THEN 'injection' WHEN l_suppkey % 10 = 2 THEN '' ELSE NULL END AS threat_type
FROM {lineitem}
"""

FX_SQL["fx_run_events"] = """
SELECT 'run' || CAST(user_id AS STRING) AS run_id,
       event_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq,
       ts,
       CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS level,
       CASE WHEN event_id % 23 = 0 THEN 'console_banner'
            WHEN event_type = 'view' THEN 'console_header'
            WHEN event_type = 'click' THEN 'step_1_file'
            WHEN event_type = 'purchase' THEN 'step_' || CAST(2 + event_id % 4 AS STRING)
            WHEN event_type = 'signup' THEN 'summary'
            WHEN event_id % 5 = 0 THEN 'adapter' ELSE 'error' END AS step,
       CASE WHEN event_id % 29 = 0 THEN '  ' WHEN event_id % 31 = 0 THEN '------------------------'
            WHEN event_type = 'purchase' THEN '✅ done' ELSE event_type END AS message
FROM {events}
"""

# run state transitions carried by events: a signup completes the run, an error fails it
FX_SQL["fx_run_transitions"] = """
SELECT 'run' || CAST(user_id AS STRING) AS run_id, event_id, ts,
       CASE WHEN user_id % 3 = 0 THEN NULL WHEN event_type = 'signup' THEN 'completed' WHEN event_type = 'error' THEN 'error' END AS transition,
       CASE WHEN event_id % 5 <> 0 THEN 'github' END AS platform, CAST(user_id AS STRING) AS pr_id,
       CASE WHEN event_id % 2 = 0 THEN 'PR ' || CAST(event_id AS STRING) END AS title, 'dev' || CAST(user_id % 7 AS STRING) AS author,
       'feature/' || CAST(user_id AS STRING) AS source_branch, 'main' AS target_branch, 'org/repo' || CAST(user_id % 5 AS STRING) AS repo,
       CASE WHEN event_type = 'signup' THEN CAST(CAST(floor(value) AS BIGINT) % 11 AS INT) END AS score,
       CASE WHEN event_type = 'signup' THEN CAST(event_id % 7 AS INT) END AS issues,
       CASE WHEN event_type = 'signup' THEN CAST(event_id % 3 AS INT) END AS critical,
       CASE WHEN event_type = 'error' THEN 'failed: ' || props END AS error
FROM {events}
"""

FX_SQL["fx_files"] = """
SELECT 'proj' || CAST(p_partkey % 4 AS STRING) AS project,
       CASE p_partkey % 10
         WHEN 0 THEN 'src/app/mod' WHEN 1 THEN 'src/Migrations/m' WHEN 2 THEN 'tests/unit/t'
         WHEN 3 THEN 'node_modules/x/y' WHEN 4 THEN 'config/settings' WHEN 5 THEN 'src/api/Program'
         WHEN 6 THEN 'web/ui/page' WHEN 7 THEN 'lib/core' WHEN 8 THEN 'docs/readme' ELSE 'build/out' END
       || CAST(p_partkey AS STRING)
       || CASE p_size % 9 WHEN 0 THEN '.py' WHEN 1 THEN '.cs' WHEN 2 THEN '.ts' WHEN 3 THEN '.json' WHEN 4 THEN '.JS'
                          WHEN 5 THEN '.md' WHEN 6 THEN '.spec.ts' WHEN 7 THEN '' ELSE '.go' END AS rel_path,
       CAST((p_partkey * 37) % 60000 AS BIGINT) AS size_bytes,
       p_partkey AS doc_id
FROM {part}
"""

FX_SQL["fx_ignore"] = """
SELECT 'node_modules/' AS pattern UNION ALL SELECT '*.md' UNION ALL SELECT 'build/*'
UNION ALL SELECT 'docs/' UNION ALL SELECT 'src/Migrations' UNION ALL SELECT 'mod?.py'
"""

FX_SQL["fx_file_results"] = """
SELECT 'proj' || CAST(p_partkey % 4 AS STRING) AS project,
       CAST(floor(p_partkey / 4) AS BIGINT) AS pos,
       'f' || CAST(p_partkey AS STRING) AS file,
       (CAST(floor(p_partkey / 4) AS BIGINT) % 43 = 42) AS skipped,
       (CAST(floor(p_partkey / 4) AS BIGINT) % 43 <> 42 AND (p_partkey % 4 < 2 OR (p_partkey % 4 = 2 AND p_size % 5 > 1))
         AND CAST(floor(p_partkey / 4) AS BIGINT) % 50 BETWEEN 40 AND 45) AS is_error,
       CAST(p_size % 11 AS INT) AS score
FROM {part}
"""

# issues of project files: only even-numbered files get issues (odd ones are clean files)
FX_SQL["fx_file_issues"] = """
SELECT 'proj' || CAST((l_partkey - l_partkey % 2) % 4 AS STRING) AS project,
       'f' || CAST(l_partkey - l_partkey % 2 AS STRING) AS file,
       CAST(row_number() OVER (PARTITION BY l_partkey - l_partkey % 2
                               ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS pos,
       CASE l_suppkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
       CASE l_orderkey % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'XSS' WHEN 2 THEN 'style' WHEN 3 THEN 'bugs' ELSE 'performance' END AS category,
       'issue ' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS title
FROM {lineitem}
"""

FX_SQL["fx_attempts"] = """
SELECT p_partkey AS file_id, a.attempt, a.provider, ((p_partkey + a.attempt * a.attempt) % 5 > 2) AS ok
FROM {part} CROSS JOIN (SELECT 0 AS attempt, 'groq' AS provider UNION ALL SELECT 1, 'openai' UNION ALL SELECT 2, 'anthropic') a
"""

FX_SQL["fx_rules"] = """
SELECT filename, 'text of ' || filename AS content FROM (
  SELECT 'security.md' AS filename UNION ALL SELECT 'compilation.md' UNION ALL SELECT 'performance.md'
  UNION ALL SELECT 'best-practices.md' UNION ALL SELECT 'dotnet-fundamentals.md' UNION ALL SELECT 'linter.md'
  UNION ALL SELECT 'README.md' UNION ALL SELECT 'owasp-top10.md'
  UNION ALL SELECT 'python-security.md' UNION ALL SELECT 'python-compilation.md' UNION ALL SELECT 'python-performance.md'
  UNION ALL SELECT 'python-best-practices.md' UNION ALL SELECT 'go-security.md' UNION ALL SELECT 'go-compilation.md'
  UNION ALL SELECT 'javascript-security.md' UNION ALL SELECT 'shell-security.md' UNION ALL SELECT 'shell-performance.md') t
"""

# repo rule documents: one per repo whose key ends in 0
FX_SQL["fx_repo_rules"] = """
SELECT DISTINCT replace(repo, '/', '_') || '.md' AS filename,
       'repo rules of ' || repo AS content
FROM {fx_reviews}
WHERE substring(replace(repo, '/', '_'), length(replace(repo, '/', '_')), 1) = '0'
"""
FX_DEPS["fx_repo_rules"] = ["fx_reviews"]

FX_SQL["fx_rule_requests"] = """
SELECT r.review_id, r.repo,
       CASE CAST(r.pr_id AS BIGINT) % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'javascript'
                                        WHEN 3 THEN 'shell' ELSE NULL END AS language,
       f.focus_pos, f.focus
FROM {fx_reviews} r CROSS JOIN (
  SELECT 0 AS focus_pos, 'compilation' AS focus UNION ALL SELECT 1, 'Security' UNION ALL SELECT 2, 'bugs'
  UNION ALL SELECT 3, 'best_practices' UNION ALL SELECT 4, 'code_quality' UNION ALL SELECT 5, 'unknown') f
"""
FX_DEPS["fx_rule_requests"] = ["fx_reviews"]

FX_SQL["fx_owasp_docs"] = """
SELECT doc_id,
       '# Title CWE-' || CAST(doc_id % 90 + 10 AS STRING) || chr(10) || 'intro' || chr(10)
       || CASE doc_id % 3 WHEN 0 THEN '## Description' || chr(10) WHEN 1 THEN '## Overview' || chr(10) ELSE '' END
       || coalesce(text, '') || chr(10) || '### Sub CWE-79 and CWE-79' || chr(10)
       || '## How to Prevent' || chr(10) || 'see CWE-' || CAST(doc_id % 7 + 1 AS STRING) AS raw_md
FROM {documents}
"""

# OWASP update runs: ten category fetches per update; every update with id % 9 = 4 fails completely
FX_SQL["fx_owasp_fetches"] = """
SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS update_id,
       'A' || lpad(CAST(p_partkey % 10 + 1 AS STRING), 2, '0') AS code,
       (p_size % 4 <> 0 AND CAST(floor(p_partkey / 10) AS BIGINT) % 9 <> 4) AS ok
FROM {part}
"""

FX_SQL["fx_secret_lines"] = """
SELECT CAST(l_orderkey AS STRING) AS file_id, l_linenumber AS line_no,
       CASE l_partkey % 12 WHEN 0 THEN 'password = "hunter' || CAST(l_partkey AS STRING) || '"'
         WHEN 1 THEN 'api_key: "k' || CAST(l_suppkey AS STRING) || '"'
         WHEN 2 THEN '# TODO: implement this' WHEN 3 THEN 'except Exception:'
         WHEN 4 THEN 'q = f"SELECT * FROM t WHERE id={{x}}"' WHEN 5 THEN 'element.innerHTML = userInput;'
         WHEN 6 THEN 'hashlib.md5(pw)' ELSE 'x = ' || CAST(l_partkey AS STRING) END AS content
FROM {lineitem}
"""

# Spark-only: one file section per document (the DuckDB side never needs the diff text)
FX_SPARK_ONLY = {"fx_diffs"}
FX_SQL["fx_diffs"] = """
SELECT doc_id, concat('--- a/src/doc', doc_id, '.py', chr(10), '+++ b/src/doc', doc_id, '.py', chr(10),
  '@@ -1,', CAST(size(filter(transform(split(text, chr(10)), (x, i) -> i % 3), m -> m <> 0)) AS STRING),
  ' +1,', CAST(size(filter(transform(split(text, chr(10)), (x, i) -> i % 3), m -> m <> 1)) AS STRING), ' @@', chr(10),
  array_join(transform(split(text, chr(10)), (x, i) -> concat(CASE i % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END, x)), chr(10))) AS diff
FROM {documents}
"""

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _placeholders(sql: str) -> list[str]:
    import string

    return [f for _, f, _, _ in string.Formatter().parse(sql) if f]


_ROW_NUMBER = re.compile(r"row_number\(\) OVER \([^()]*\)")


def _numbered(sql: str, binds: dict[str, DataFrame]) -> tuple[str, dict[str, DataFrame]]:
    """The same rows with the row numbers of a one-table text counted on the table's own columns.

    In one SELECT Spark computes all the texts first and sends them through the window's shuffle and sort; numbers
    from a frame below leave only the columns that the texts are made of."""
    if len(binds) != 1:
        return sql, binds
    (name, frame), = binds.items()
    for k, window in enumerate(dict.fromkeys(_ROW_NUMBER.findall(sql))):
        sql, frame = sql.replace(window, f"_number{k}"), frame.withColumn(f"_number{k}", F.expr(window))
    return sql, {name: frame}


#: Staged fixtures of this process: (application, folder, name) -> path.
_STAGED: dict[tuple[str, str, str], str] = {}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Fixture ``name`` over the driver tables in ``sf_dir``: input tables, as a store would hold them.

    Written once per application to the shared scratch folder and read from there, so that queries read tables and
    do not build them again."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        sql = FX_SQL[name]
        binds = {}
        for ph in _placeholders(sql):
            binds[ph] = fixture(spark, sf_dir, ph) if ph.startswith("fx_") else read_table(spark, sf_dir, ph)
        sql, binds = _numbered(sql, binds)
        path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
        spark.sql(sql, **binds).write.option("compression", "zstd").parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


def oracle_with(body: str, *names: str) -> str:
    """DuckDB text: ``WITH`` the named fixtures (and their dependencies) then ``body``."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in FX_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = []
    for n in order:
        sql = FX_SQL[n]
        binds = {ph: ph for ph in _placeholders(sql)}
        ctes.append(f"{n} AS ({sql.format(**binds).strip()})")
    body = body.strip()
    if not ctes:
        return body
    if body[:4].upper() == "WITH":
        # the body brings CTEs of its own: append them after the fixtures
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body
