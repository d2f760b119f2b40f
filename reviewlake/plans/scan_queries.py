"""scan.*: deterministic pattern scans over fx_secret_lines, whole documents and the diff corpus."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators import scan as S
from ..operators.align import replaced_keywords
from ..sources.tables import read_table
from .diff_queries import LINES_SQL
from .fixtures import fixture, oracle_with
from .base import oracle_st
from .registry import register


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lines(spark, sf):
    """Planted source lines plus every line of every document."""
    planted = fixture(spark, sf, "fx_secret_lines").select(
        F.lit("lines").alias("source"), F.col("file_id").alias("id"), F.col("line_no").cast("bigint").alias("line_no"),
        "content")
    docs = S.split_lines(read_table(spark, sf, "documents").select("doc_id", "text")).select(
        F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("id"),
        F.col("line_no").cast("bigint").alias("line_no"), "content")
    return planted.unionByName(docs)


LINES_ORACLE = """
src AS (
  SELECT 'lines' AS source, file_id AS id, CAST(line_no AS BIGINT) AS line_no, content FROM fx_secret_lines
  UNION ALL
  SELECT 'documents', CAST(doc_id AS VARCHAR), CAST(k AS BIGINT), content FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS content,
           unnest(generate_series(1, len(string_split(text, chr(10))))) AS k FROM documents) d)"""


def _pack_oracle(pack) -> str:
    parts = []
    for rule_id, regex, sev, cat, thr in pack:
        t = "CAST(NULL AS VARCHAR)" if thr is None else _lit(thr)
        parts.append(f"SELECT source, id, line_no, content, {_lit(rule_id)} AS rule_id, {_lit(sev)} AS severity, "
                     f"{_lit(cat)} AS category, {t} AS threat_type FROM src WHERE regexp_matches(content, {_lit(regex)})")
    return oracle_with("WITH " + LINES_ORACLE.strip() + "\nSELECT source, id, line_no, rule_id, severity, category, threat_type FROM ("
                       + "\nUNION ALL\n".join(parts) + ") m", "fx_secret_lines")


def _pack_query(pack):
    def build(spark, sf):
        return S.scan(_lines(spark, sf), pack).select("source", "id", "line_no", "rule_id", "severity", "category",
                                                       "threat_type")
    return build


register("scan.secret_leaks", _pack_oracle(S.SECRET_PACK))(_pack_query(S.SECRET_PACK))
register("scan.injection", _pack_oracle(S.INJECTION_PACK))(_pack_query(S.INJECTION_PACK))
register("scan.slop", _pack_oracle(S.SLOP_PACK))(_pack_query(S.SLOP_PACK))


@register("scan.line_style", oracle_with("WITH " + LINES_ORACLE.strip() + """
SELECT source, id, line_no, rule, 'low' AS severity FROM (
  SELECT source, id, line_no, 'line_too_long' AS rule FROM src WHERE length(content) > 120
  UNION ALL
  SELECT source, id, line_no, 'trailing_whitespace' FROM src WHERE regexp_matches(content, '[ \\t]+\\z')
  UNION ALL
  SELECT source, id, line_no, 'mixed_indentation' FROM src WHERE regexp_matches(content, '^(\\t+ +| +\\t+)')) x""",
                                         "fx_secret_lines"))
def _line_style(spark, sf):
    return S.line_style(_lines(spark, sf)).select("source", "id", "line_no", "rule", "severity")


# changes that lose a keyword (by part number), besides those of the documents
PLANTED_DIFF = """
SELECT -p_partkey - 1 AS pr, concat('--- a/k.py', chr(10), '+++ b/k.py', chr(10), '@@ -1,2 +1,2 @@', chr(10),
  CASE p_partkey % 3 WHEN 0 THEN concat('-await call(x)', chr(10), '+call(x)') WHEN 1 THEN concat('-static var n = 1', chr(10), '+var n = 1')
                     ELSE concat('-return 1', chr(10), '+return 2') END, chr(10), ' y') AS diff FROM {part}"""


@register("scan.removed_keywords", oracle_with(f"""
WITH {LINES_SQL},
planted AS (SELECT -p_partkey - 1 AS doc_id, unnest(['removed', 'added']) AS type,
                   unnest(CASE p_partkey % 3 WHEN 0 THEN ['await call(x)', 'call(x)'] WHEN 1 THEN ['static var n = 1', 'var n = 1']
                                             ELSE ['return 1', 'return 2'] END) AS x FROM part),
kw AS (SELECT doc_id, type, unnest(regexp_split_to_array(x, '[^A-Za-z0-9_]+')) AS keyword
       FROM (SELECT doc_id, type, x FROM lines UNION ALL SELECT * FROM planted) a WHERE type IN ('added', 'removed'))
SELECT doc_id AS pr, CAST(1 AS BIGINT) AS file_idx, CAST(1 AS BIGINT) AS hunk_idx, keyword,
       count(*) FILTER (WHERE type = 'removed') AS removed, count(*) FILTER (WHERE type = 'added') AS added
FROM kw WHERE keyword IN ({', '.join(_lit(k) for k in S.KEYWORDS)})
GROUP BY doc_id, keyword
HAVING count(*) FILTER (WHERE type = 'removed') > 0 AND count(*) FILTER (WHERE type = 'added') = 0"""))
def _removed_keywords(spark, sf):
    d = fixture(spark, sf, "fx_diffs").select(F.col("doc_id").alias("pr"), "diff")
    d = d.unionByName(spark.sql(PLANTED_DIFF, part=read_table(spark, sf, "part")))
    lines = D.diff_lines(D.diff_lines_all(d))
    return S.removed_keywords(lines)


# two lines that moved, one rewritten without its keyword, one rewritten with it, one removed, one added
REPLACED_DIFF = """
SELECT -p_partkey - 1 AS pr, concat_ws(chr(10), '--- a/r.js', '+++ b/r.js', '@@ -1,6 +1,6 @@',
  '-  const moved = 1;', concat('-  let r = await load(', p_partkey, ', x);'), concat('-  return keep(', p_partkey, ');'),
  concat('+  let r = load(', p_partkey, ', x);'), concat('+  return keep(', p_partkey, ' + 1);'), '+  const moved = 1;', ' ctx', '-  function gone()', ' end', '+  var fresh;') AS diff
FROM {part}"""


@register("scan.replaced_keywords", """
SELECT -p_partkey - 1 AS pr, CAST(1 AS BIGINT) AS file_idx, CAST(1 AS BIGINT) AS hunk_idx, CAST(2 AS BIGINT) AS line_number, CAST(1 AS BIGINT) AS new_line_number,
       'await' AS keyword, CAST(1 AS BIGINT) AS lost FROM part""")
def _replaced_keywords(spark, sf):
    d = spark.sql(REPLACED_DIFF, part=read_table(spark, sf, "part"))
    return replaced_keywords(D.diff_lines(D.diff_lines_all(d)), S.KEYWORDS)


@register("scan.duplicate_blocks", oracle_with("""
WITH l AS (SELECT doc_id, k, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS n FROM (
             SELECT doc_id, unnest(string_split(text, chr(10))) AS content,
                    unnest(generate_series(1, len(string_split(text, chr(10))))) AS k FROM documents) d),
ne AS (SELECT * FROM l WHERE n <> ''),
b AS (SELECT doc_id, n || chr(10) || lead(n, 1) OVER w || chr(10) || lead(n, 2) OVER w || chr(10) || lead(n, 3) OVER w AS blk
      FROM ne WINDOW w AS (PARTITION BY doc_id ORDER BY k))
SELECT md5(blk) AS block_md5, count(*) AS occurrences, count(DISTINCT doc_id) AS docs
FROM b WHERE blk IS NOT NULL GROUP BY md5(blk) HAVING count(*) > 1"""))
def _duplicate_blocks(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    return S.duplicate_blocks(S.split_lines(docs), 4)


@register("scan.copied_blocks", oracle_with("""
WITH RECURSIVE l AS (SELECT doc_id, k, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS n FROM (
             SELECT doc_id, unnest(string_split(text, chr(10))) AS content,
                    unnest(generate_series(1, len(string_split(text, chr(10))))) AS k FROM documents) d),
ne AS (SELECT doc_id, k, n, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS j FROM l WHERE n <> ''),
g AS (SELECT doc_id, j, md5(b) AS h FROM (SELECT doc_id, j, n || chr(10) || lead(n, 1) OVER w || chr(10) || lead(n, 2) OVER w || chr(10) || lead(n, 3) OVER w AS b
      FROM ne WINDOW w AS (PARTITION BY doc_id ORDER BY j)) x WHERE b IS NOT NULL),
pick AS (SELECT DISTINCT a.doc_id, arg_min(b.j, b.h || lpad(CAST(1000000000 - b.j AS VARCHAR), 10, '0')) AS j
         FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.j BETWEEN a.j AND a.j + 3
         JOIN (SELECT doc_id, max(j) AS last FROM g GROUP BY doc_id) z ON z.doc_id = a.doc_id
         WHERE a.j + 3 <= last OR a.j = 0 GROUP BY a.doc_id, a.j),
p AS (SELECT DISTINCT g.doc_id, g.j, g.h FROM pick JOIN g ON g.doc_id = pick.doc_id AND g.j = pick.j),
f AS (SELECT h, min(doc_id) AS of_doc FROM p GROUP BY h HAVING count(*) > 1),
o AS (SELECT p.h, f.of_doc, min(p.j) AS of_j FROM p JOIN f ON p.h = f.h AND p.doc_id = f.of_doc GROUP BY p.h, f.of_doc),
m AS (SELECT p.doc_id, p.j, o.of_doc, o.of_j - p.j AS apart FROM p JOIN o ON p.h = o.h WHERE p.doc_id <> o.of_doc OR p.j <> o.of_j),
grow(doc_id, of_doc, apart, a, b, step) AS (
  SELECT doc_id, of_doc, apart, j, j + 3, 0 FROM m
  UNION ALL
  SELECT w.doc_id, w.of_doc, w.apart, w.a - CASE WHEN up.j IS NULL THEN 0 ELSE 1 END, w.b + CASE WHEN dn.j IS NULL THEN 0 ELSE 1 END, w.step + 1
  FROM grow w
  LEFT JOIN (SELECT x.doc_id, x.j, y.doc_id AS of_doc, y.j - x.j AS apart FROM ne x JOIN ne y ON x.n = y.n) up
    ON up.doc_id = w.doc_id AND up.j = w.a - 1 AND up.of_doc = w.of_doc AND up.apart = w.apart
  LEFT JOIN (SELECT x.doc_id, x.j, y.doc_id AS of_doc, y.j - x.j AS apart FROM ne x JOIN ne y ON x.n = y.n) dn
    ON dn.doc_id = w.doc_id AND dn.j = w.b + 1 AND dn.of_doc = w.of_doc AND dn.apart = w.apart
  WHERE w.step < 3),
r AS (SELECT DISTINCT doc_id, of_doc, apart, a, b FROM grow WHERE step = 3),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, of_doc, apart ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id, of_doc, apart ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM r) x),
s AS (SELECT doc_id, of_doc, apart, min(a) AS a, max(b) AS b FROM i GROUP BY doc_id, of_doc, apart, island)
SELECT s.doc_id, min(e.k) AS first_line, max(e.k) AS last_line, s.b - s.a + 1 AS lines, s.of_doc AS of_doc_id, min(t.k) AS of_first_line, max(t.k) AS of_last_line,
       md5(string_agg(e.n, chr(10) ORDER BY e.j)) AS block_md5
FROM s JOIN ne e ON e.doc_id = s.doc_id AND e.j BETWEEN s.a AND s.b JOIN ne t ON t.doc_id = s.of_doc AND t.j = e.j + s.apart
GROUP BY s.doc_id, s.of_doc, s.apart, s.a, s.b"""))
def _copied_blocks(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    return S.copied_blocks(S.split_lines(docs))


@register("rules.severity_guidelines", oracle_st("""
SELECT repo AS document, CAST(6 + row_number() OVER (PARTITION BY repo ORDER BY title) - 1 AS INT) AS i,
       regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS issue,
       CASE min(r) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' END AS severity
FROM (SELECT v.repo, i.title, CASE i.severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END AS r
      FROM st_issues i JOIN st_reviews v ON i.review_id = v.review_id) x
GROUP BY repo, title"""))
def _severity_guidelines(spark, sf):
    """Guideline tables written per repo from its recurring issue titles and worst severities, parsed back."""
    from .base import st_issues, st_reviews
    from ..functions import dims

    i = st_issues(spark, sf).join(st_reviews(spark, sf).select("review_id", "repo"), "review_id")
    worst = (i.groupBy("repo", "title").agg(F.min(dims.severity_rank(F.col("severity"))).alias("r"))
             .withColumn("sev", F.element_at(F.array(*[F.lit(s) for s in dims.SEVERITIES]), F.col("r") + 1)))
    table = worst.groupBy("repo").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("title", "sev"))),
        lambda x: F.concat(F.lit("| "), x["title"], F.lit(" | **"), F.upper(x["sev"]), F.lit("** |"))), "\n").alias("rows"))
    docs = table.select(F.col("repo").alias("document"), F.concat(
        F.lit("# Rules\n\n## Severity Guidelines\n\n| Issue | Severity |\n|-------|----------|\n"), F.col("rows"),
        F.lit("\n\n## Other\n| not | a guideline |")).alias("content"))
    return S.severity_guidelines(docs)
