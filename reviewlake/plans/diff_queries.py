"""diff.*: unified diffs built from ``documents`` (one file section and one hunk per document,
lines marked ``+``/``-``/space by position mod 3).  The oracles need no diff text: the expected
counts and numbers follow from line positions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as D
from .fixtures import fixture, oracle_with
from .registry import register


def _single(spark, sf):
    return fixture(spark, sf, "fx_diffs").select(F.col("doc_id").alias("pr"), "diff")


def _multi(spark, sf):
    """Multi-file PRs: pr = floor(doc_id / 3), sections joined in doc_id order."""
    d = fixture(spark, sf, "fx_diffs").withColumn("pr", F.floor(F.col("doc_id") / 3).cast("bigint"))
    return d.groupBy("pr").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "diff"))), lambda x: x["diff"]), "\n").alias("diff"))


# hand-written diffs by part number, besides those of the documents: two sections with a new file and two hunks,
# a deleted file, a renamed one with numbers above 2^31, a hunk cut short, no diff at all, and files without hunks
PLANTED = """
SELECT -p_partkey - 1 AS pr, CASE p_partkey % 6
  WHEN 0 THEN concat_ws(chr(10), 'diff --git a/n.py b/n.py', 'new file mode 100644', '--- /dev/null', '+++ b/n.py', '@@ -0,0 +1,2 @@', '+a', '+b',
                        'diff --git a/m.ts b/m.ts', '--- a/m.ts', '+++ b/m.ts', '@@ -1 +1,2 @@', ' x', '+y', '@@ -9 +10 @@', '-p', '+q')
  WHEN 1 THEN concat_ws(chr(10), '--- a/old.go', '+++ /dev/null', '@@ -1,2 +0,0 @@', '-a', '-b')
  WHEN 2 THEN concat_ws(chr(10), '--- a/from.js', '+++ b/to.js', '@@ -12345678901 +12345678901 @@', '-a', '+b')
  WHEN 3 THEN concat_ws(chr(10), '--- a/x.py', '+++ b/x.py', '@@ -1,5 +1,5 @@', ' a', '+b')
  WHEN 5 THEN concat_ws(chr(10), 'diff --git a/p.py b/q.py', 'similarity index 100%', 'rename from p.py', 'rename to q.py',
                        'diff --git a/i.png b/i.png', 'new file mode 100644', 'Binary files /dev/null and b/i.png differ')
  ELSE '' END AS diff
FROM {part}"""
PLANTED_FILES_SQL = """
planted AS (
  SELECT -p.p_partkey - 1 AS pr, f.* FROM part p JOIN (VALUES
    (0, 1, 'n.py', 2, 0, true, false, 1), (0, 2, 'm.ts', 2, 1, false, false, 2), (1, 1, 'old.go', 0, 2, false, true, 1),
    (2, 1, 'to.js', 1, 1, false, false, 1), (5, 1, 'q.py', 0, 0, false, false, 0), (5, 2, 'i.png', 0, 0, true, false, 0)) AS f(kind, file_idx, path, additions, deletions, is_new, is_deleted, hunks) ON p.p_partkey % 6 = f.kind)"""


def _planted(spark, sf):
    from ..sources.tables import read_table
    return spark.sql(PLANTED, part=read_table(spark, sf, "part"))


def _classified(df):
    return D.diff_lines_all(df)


# per-document line positions i (1-based) and kinds, DuckDB side
LINES_SQL = """
lines AS (
  SELECT doc_id, i, x,
         CASE (i - 1) % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'context' END AS type
  FROM (SELECT doc_id, unnest(s) AS x, unnest(generate_series(1, len(s))) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) d) u),
counts AS (
  SELECT doc_id,
         CAST(sum(CASE WHEN (i - 1) % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS additions,
         CAST(sum(CASE WHEN (i - 1) % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS deletions,
         CAST(sum(CASE WHEN (i - 1) % 3 <> 0 THEN 1 ELSE 0 END) AS INT) AS src_len,
         CAST(sum(CASE WHEN (i - 1) % 3 <> 1 THEN 1 ELSE 0 END) AS INT) AS tgt_len
  FROM lines GROUP BY doc_id)"""


@register("diff.files", oracle_with(f"""
WITH {LINES_SQL},
{PLANTED_FILES_SQL.strip()}
SELECT doc_id AS pr, CAST(1 AS BIGINT) AS file_idx, 'src/doc' || CAST(doc_id AS VARCHAR) || '.py' AS path,
       additions, deletions, false AS is_new, false AS is_deleted, CAST(1 AS BIGINT) AS hunks
FROM counts
UNION ALL SELECT pr, file_idx, path, additions, deletions, is_new, is_deleted, hunks FROM planted"""))
def _files(spark, sf):
    return D.diff_files(_single(spark, sf).unionByName(_planted(spark, sf)))


@register("diff.hunks", oracle_with(f"""
WITH {LINES_SQL}
SELECT doc_id AS pr, CAST(1 AS BIGINT) AS file_idx, CAST(1 AS BIGINT) AS hunk_idx, 1 AS src_start, src_len,
       1 AS tgt_start, tgt_len
FROM counts"""))
def _hunks(spark, sf):
    return D.diff_hunks(_classified(_single(spark, sf)))


@register("diff.lines", oracle_with(f"""
WITH {LINES_SQL}
SELECT doc_id AS pr, CAST(1 AS BIGINT) AS file_idx, CAST(1 AS BIGINT) AS hunk_idx, type,
       CAST(1 + CASE WHEN type = 'added'
                     THEN count(*) FILTER (WHERE (i - 1) % 3 <> 1) OVER w
                     ELSE count(*) FILTER (WHERE (i - 1) % 3 <> 0) OVER w END AS INT) AS line_number,
       x AS content, 'src/doc' || CAST(doc_id AS VARCHAR) || '.py' AS path
FROM lines
WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def _lines(spark, sf):
    c = _classified(_single(spark, sf))
    return D.diff_lines(c).select("pr", "file_idx", "hunk_idx", "type",
                                         F.col("line_number").cast("int").alias("line_number"), "content", "path")


MULTI_SQL = LINES_SQL + """,
per_pr AS (SELECT CAST(floor(doc_id / 3) AS BIGINT) AS pr, doc_id, additions, deletions FROM counts)"""


@register("diff.summary", oracle_with(f"""
WITH {MULTI_SQL},
{PLANTED_FILES_SQL.strip()}
SELECT pr, count(*) AS files_count, CAST(sum(additions) AS BIGINT) AS total_additions,
       CAST(sum(deletions) AS BIGINT) AS total_deletions
FROM per_pr GROUP BY pr
UNION ALL
SELECT -p.p_partkey - 1, count(f.pr), CAST(coalesce(sum(f.additions), 0) AS BIGINT), CAST(coalesce(sum(f.deletions), 0) AS BIGINT)
FROM part p LEFT JOIN planted f ON f.pr = -p.p_partkey - 1 GROUP BY p.p_partkey"""))
def _summary(spark, sf):
    prs = _multi(spark, sf).unionByName(_planted(spark, sf))
    return D.diff_summary(D.diff_files(prs), prs)


@register("diff.net_change", oracle_with(f"""
WITH {MULTI_SQL}
SELECT pr, count(*) AS files_count, CAST(sum(additions) AS BIGINT) AS total_additions,
       CAST(sum(deletions) AS BIGINT) AS total_deletions,
       CAST(sum(additions) - sum(deletions) AS BIGINT) AS net_change,
       string_agg('src/doc' || CAST(doc_id AS VARCHAR) || '.py', ',' ORDER BY doc_id) AS paths
FROM per_pr GROUP BY pr"""))
def _net_change(spark, sf):
    prs = _multi(spark, sf)
    return D.net_change(D.diff_files(prs), prs).withColumn("paths", F.array_join("paths", ","))


@register("diff.changed_paths", oracle_with(f"""
WITH {MULTI_SQL}
SELECT pr, string_agg('src/doc' || CAST(doc_id AS VARCHAR) || '.py', ',' ORDER BY doc_id) AS paths
FROM per_pr GROUP BY pr"""))
def _changed_paths(spark, sf):
    prs = _multi(spark, sf)
    return D.changed_paths(D.diff_files(prs), prs).withColumn("paths", F.array_join("paths", ","))


@register("diff.extension_stats", oracle_with(f"""
WITH {MULTI_SQL}
SELECT pr, 'py' AS ext, count(*) AS count FROM per_pr GROUP BY pr
UNION ALL
SELECT pr, split_part(path, '.', 2), count(*) FROM (WITH {PLANTED_FILES_SQL.strip()} SELECT * FROM planted) p GROUP BY ALL"""))
def _extension_stats(spark, sf):
    return D.extension_stats(D.diff_files(_multi(spark, sf).unionByName(_planted(spark, sf))))


@register("diff.is_diff", oracle_with(r"""
SELECT doc_id, 'document' AS kind, coalesce(regexp_matches(text, '^\s*(diff --git|--- a/|\+\+\+ b/|@@)'), false) AS is_diff
FROM documents
UNION ALL
SELECT doc_id, 'diff' AS kind, true AS is_diff FROM documents"""))
def _is_diff(spark, sf):
    docs = fixture(spark, sf, "fx_diffs").select("doc_id", F.lit("diff").alias("kind"), D.is_diff(F.col("diff")).alias("is_diff"))
    from ..sources.tables import read_table
    raw = read_table(spark, sf, "documents").select("doc_id", F.lit("document").alias("kind"),
                                                    D.is_diff(F.col("text")).alias("is_diff"))
    return raw.unionByName(docs)


@register("diff.assemble", oracle_with(f"""
WITH {LINES_SQL},
patch AS (
  SELECT d.doc_id, CAST(floor(d.doc_id / 3) AS BIGINT) AS pr,
         '@@ -1,' || CAST(c.src_len AS VARCHAR) || ' +1,' || CAST(c.tgt_len AS VARCHAR) || ' @@' || chr(10)
         || array_to_string(list_transform(string_split(d.text, chr(10)),
                lambda x, i: CASE (i - 1) % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END || x), chr(10)) AS p
  FROM documents d JOIN counts c ON d.doc_id = c.doc_id)
SELECT pr, md5(string_agg('--- a/src/doc' || CAST(doc_id AS VARCHAR) || '.py' || chr(10) || '+++ b/src/doc'
                          || CAST(doc_id AS VARCHAR) || '.py' || chr(10) || p, chr(10) ORDER BY doc_id)) AS diff_md5
FROM patch GROUP BY pr"""))
def _assemble(spark, sf):
    # per-file patches (the text from the hunk header on) and file names, then reassembled per PR
    d = fixture(spark, sf, "fx_diffs")
    patches = d.select(F.floor(F.col("doc_id") / 3).cast("bigint").alias("pr"), F.col("doc_id").alias("file_idx"),
                       F.concat(F.lit("src/doc"), F.col("doc_id").cast("string"), F.lit(".py")).alias("filename"),
                       F.expr("substr(diff, instr(diff, concat(chr(10), '@@')) + 1)").alias("patch"))
    return D.assemble_diff(patches).select("pr", F.md5("diff").alias("diff_md5"))


@register("diff.parse_errors", """
SELECT doc_id AS pr, 'hunk_too_short' AS error, 0 AS files_count, 0 AS total_additions, 0 AS total_deletions FROM documents
UNION ALL SELECT -doc_id - 1, 'hunk_without_file_header', 0, 0, 0 FROM documents
UNION ALL SELECT 1000000000 + doc_id, 'hunk_too_long', 0, 0, 0 FROM documents
UNION ALL SELECT 2000000000 + doc_id, 'bad_hunk_header', 0, 0, 0 FROM documents""")
def _parse_errors(spark, sf):
    """Every document's diff with the stated source length overstated (hunk too short), the same sections without file
    headers (GitLab shape), a hunk whose target runs over before its source is met, and a number beyond 64 bits."""
    d = fixture(spark, sf, "fx_diffs")
    overstated = d.select(F.col("doc_id").alias("pr"),
                          F.regexp_replace("diff", r"@@ -1,(\d+) ", "@@ -1,9$1 ").alias("diff"))
    headless = d.select((-F.col("doc_id") - 1).alias("pr"),
                        F.regexp_replace("diff", r"^--- [^\n]*\n\+\+\+ [^\n]*\n", "").alias("diff"))
    head = F.concat(F.lit("--- a/x\n+++ b/x\n"), F.lit("@@ -1,2 +1,1 @@\n+a\n+b\n c\n d"))
    over = d.select((F.col("doc_id") + 1_000_000_000).alias("pr"), head.alias("diff"))
    huge = d.select((F.col("doc_id") + 2_000_000_000).alias("pr"), F.regexp_replace("diff", r"@@ -1,", "@@ -99999999999999999999,").alias("diff"))
    return D.diff_errors(D.diff_lines_all(overstated.unionByName(headless).unionByName(over).unionByName(huge)))
