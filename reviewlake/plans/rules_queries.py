"""rules.*: rule catalogue, resolution, coverage and OWASP extraction (fx_rules, fx_repo_rules,
fx_rule_requests, fx_owasp_docs, fx_owasp_fetches)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import rules as R
from .fixtures import fixture, oracle_with
from .registry import register

CATS = dims.RULE_CATEGORIES
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

CATALOG_SQL = """
cat AS (SELECT filename,
               CASE WHEN contains(stem, '-') THEN split_part(stem, '-', 1) END AS language,
               CASE WHEN contains(stem, '-') THEN substring(stem, strpos(stem, '-') + 1) ELSE stem END AS category
        FROM (SELECT filename, regexp_replace(filename, '\\.md$', '') AS stem
              FROM (SELECT filename FROM fx_rules UNION ALL SELECT filename FROM fx_repo_rules) r) x)"""


def _rules(spark, sf):
    return fixture(spark, sf, "fx_rules")


def _catalog(spark, sf):
    """Base and language documents and those of the repos in the data."""
    return R.catalog(_rules(spark, sf).unionByName(fixture(spark, sf, "fx_repo_rules")))


@register("rules.catalog", oracle_with(f"WITH {CATALOG_SQL} SELECT * FROM cat", "fx_rules", "fx_repo_rules"))
def _catalog_q(spark, sf):
    return _catalog(spark, sf)


@register("rules.filter", oracle_with(f"""
WITH {CATALOG_SQL} SELECT * FROM cat WHERE lower(coalesce(language, '')) = 'python'
                                       AND lower(coalesce(category, '')) IN ('security', 'performance', 'compilation')""",
                                      "fx_rules", "fx_repo_rules"))
def _filter(spark, sf):
    c = _catalog(spark, sf)
    return (R.filter_rules(c, language="Python", category="SECURITY")
            .unionByName(R.filter_rules(c, language="python", category="Performance"))
            .unionByName(R.filter_rules(c, language="PYTHON", category="compilation")))


NAME_SQL = """CASE CAST(review_id AS BIGINT) % 4 WHEN 0 THEN 'security.md' WHEN 1 THEN '../security.md'
                  WHEN 2 THEN 'python-security.md' ELSE 'missing.md' END"""


@register("rules.get", oracle_with(f"""
SELECT q.review_id, q.name, r.content
FROM (SELECT review_id, {NAME_SQL} AS name FROM fx_reviews) q
LEFT JOIN fx_rules r ON r.filename = q.name AND NOT (contains(q.name, '/') OR contains(q.name, '\\') OR contains(q.name, '..'))""",
                                   "fx_reviews", "fx_rules"))
def _get(spark, sf):
    reqs = fixture(spark, sf, "fx_reviews").select("review_id", F.expr(NAME_SQL).alias("name"))
    return R.get_rule(reqs, _rules(spark, sf)).select("review_id", "name", "content")


@register("rules.repo_rule", oracle_with("""
SELECT r.repo, rr.content AS repo_rule
FROM (SELECT DISTINCT repo FROM fx_reviews) r LEFT JOIN fx_repo_rules rr ON rr.filename = replace(r.repo, '/', '_') || '.md'""",
                                         "fx_reviews", "fx_repo_rules"))
def _repo_rule(spark, sf):
    repos = fixture(spark, sf, "fx_reviews").select("repo").distinct()
    return R.repo_rule(repos, fixture(spark, sf, "fx_repo_rules"))


FOCUS_VALUES = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in dims.FOCUS_RULE_FILES.items()) + ") AS m(area, base)"


RESOLVE_CTES = f"""fp AS (SELECT q.review_id, q.focus_pos AS o, lower(q.focus) AS area, m.base, q.language
            FROM fx_rule_requests q JOIN {FOCUS_VALUES} ON lower(q.focus) = m.area),
fp2 AS (SELECT fp.*, l.filename AS lf, l.content AS lc, b.filename AS bf, b.content AS bc
        FROM fp LEFT JOIN fx_rules l ON l.filename = fp.language || '-' || replace(fp.base, '.md', '') || '.md'
                LEFT JOIN fx_rules b ON b.filename = fp.base),
parts AS (
  SELECT review_id, o, coalesce(lf, bf) AS file,
         CASE WHEN lf IS NOT NULL THEN chr(10) || '## Rules for ' || upper(language) || ': ' || upper(area) || chr(10) || lc
              ELSE chr(10) || '## Rules for: ' || upper(area) || chr(10) || bc END AS part
  FROM fp2 WHERE coalesce(lf, bf) IS NOT NULL
  UNION ALL
  SELECT DISTINCT q.review_id, -1, 'repo/' || replace(q.repo, '/', '_') || '.md',
         chr(10) || '## REPO-SPECIFIC RULES for ' || q.repo || chr(10) || rr.content
  FROM fx_rule_requests q JOIN fx_repo_rules rr ON rr.filename = replace(q.repo, '/', '_') || '.md'
  UNION ALL
  SELECT DISTINCT q.review_id, 1048576, 'owasp-top10.md', chr(10) || '## OWASP Top 10 Rules' || chr(10) || w.content
  FROM fx_rule_requests q JOIN fx_rules w ON w.filename = 'owasp-top10.md' WHERE lower(q.focus) = 'security'),
resolved AS (SELECT r.review_id, coalesce(string_agg(p.file, ',' ORDER BY p.o), '') AS files,
       coalesce({STRIP.format(x="string_agg(p.part, chr(10) || chr(10) ORDER BY p.o)")}, '') AS content
FROM (SELECT DISTINCT review_id FROM fx_rule_requests) r LEFT JOIN parts p ON r.review_id = p.review_id
GROUP BY r.review_id)"""


@register("rules.resolve", oracle_with(f"WITH {RESOLVE_CTES} SELECT * FROM resolved", "fx_rule_requests", "fx_rules", "fx_repo_rules"))
def _resolve(spark, sf):
    out = R.resolve(fixture(spark, sf, "fx_rule_requests"), _rules(spark, sf), fixture(spark, sf, "fx_repo_rules"))
    return out.withColumn("files", F.array_join("files", ","))


MISSING_SQL = f"""
missing AS (SELECT DISTINCT language, category, language || '-' || category || '.md' AS filename
            FROM (SELECT language, replace(lower(focus), '_', '-') AS category FROM fx_rule_requests
                  WHERE language IS NOT NULL AND language <> '') x
            WHERE category IN ({', '.join(repr(c) for c in CATS)})
              AND language || '-' || category || '.md' NOT IN (SELECT filename FROM fx_rules))"""


@register("rules.missing", oracle_with(f"WITH {MISSING_SQL} SELECT * FROM missing", "fx_rule_requests", "fx_rules"))
def _missing(spark, sf):
    return R.missing_rules(fixture(spark, sf, "fx_rule_requests"), _catalog(spark, sf))


@register("rules.coverage", oracle_with(
    "SELECT language, " + ", ".join(
        f"(language || '-{c}.md') IN (SELECT filename FROM fx_rules) AS \"{c}\"" for c in CATS)
    + " FROM (SELECT DISTINCT language FROM fx_rule_requests WHERE language IS NOT NULL) l",
    "fx_rule_requests", "fx_rules"))
def _coverage(spark, sf):
    langs = fixture(spark, sf, "fx_rule_requests").filter(F.col("language").isNotNull()).select("language").distinct()
    return R.coverage(langs, _catalog(spark, sf))


@register("rules.generation_request", oracle_with(f"""
WITH {MISSING_SQL}
SELECT m.language, m.category, coalesce(n.name, upper(substring(m.language, 1, 1)) || lower(substring(m.language, 2))) AS display_name,
       coalesce(b.content, '') AS base_rules
FROM missing m LEFT JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in dims.LANGUAGE_DISPLAY.items())}) AS n(code, name) ON m.language = n.code
LEFT JOIN fx_rules b ON b.filename = CASE m.category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in R.GENERATION_BASE.items())} END""",
                                                     "fx_rule_requests", "fx_rules"))
def _generation_request(spark, sf):
    miss = R.missing_rules(fixture(spark, sf, "fx_rule_requests"), _catalog(spark, sf))
    return R.generation_request(miss, _rules(spark, sf))


SECTIONS_SQL = f"""
d AS (SELECT doc_id, {STRIP.format(x="raw_md")} AS t FROM fx_owasp_docs),
l AS (SELECT doc_id, unnest(s) AS line, unnest(generate_series(0, len(s) - 1)) AS i
      FROM (SELECT doc_id, regexp_split_to_array(t, '\\r\\n|\\r|\\n') AS s FROM d) x),
m AS (SELECT *, CASE WHEN starts_with(st, '## Description') OR starts_with(st, '## Overview') THEN 'start'
                     WHEN starts_with(st, '## ') THEN 'end' END AS mk
      FROM (SELECT *, {STRIP.format(x="line")} AS st FROM l) y),
s AS (SELECT *, last_value(mk IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM m),
agg AS (SELECT doc_id,
               {STRIP.format(x="coalesce(string_agg(CASE WHEN mk IS NULL AND state = 'start' THEN line END, chr(10) ORDER BY i), '')")}
                 AS dsc,
               {STRIP.format(x="coalesce(string_agg(CASE WHEN i >= 2 THEN line END, chr(10) ORDER BY i), '')")} AS fb
        FROM s GROUP BY doc_id)"""


@register("rules.owasp_sections", oracle_with(f"""
WITH {SECTIONS_SQL}
SELECT a.doc_id, CASE WHEN dsc <> '' THEN dsc ELSE fb END AS description,
       array_to_string(list_sort(list_distinct(regexp_extract_all(o.raw_md, 'CWE-\\d+'))), ',') AS cwes
FROM agg a JOIN fx_owasp_docs o ON a.doc_id = o.doc_id""", "fx_owasp_docs"))
def _owasp_sections(spark, sf):
    return R.owasp_sections(fixture(spark, sf, "fx_owasp_docs")).withColumn("cwes", F.array_join("cwes", ","))


UPDATED = "2024-01-01 00:00 UTC"
_SEVERITY_ROWS = "".join(f"| {c} — {t} | {s} |\n" for c, t, s in R.OWASP_DEFAULT_SEVERITY)
_CODES = "(VALUES " + ", ".join(f"({i}, '{c}', '{t}')" for i, (_, c, t) in enumerate(dims.OWASP_CATEGORIES)) + ") AS k(i, code, title)"


@register("rules.owasp_document", oracle_with(f"""
WITH {SECTIONS_SQL},
sec AS (SELECT CAST(floor(a.doc_id / 10) AS BIGINT) AS edition, k.code,
               array_to_string(list_sort(list_distinct(regexp_extract_all(o.raw_md, 'CWE-\\d+'))), ', ') AS cwes, k.title,
               CASE WHEN dsc <> '' THEN dsc ELSE fb END AS description
        FROM agg a JOIN fx_owasp_docs o ON a.doc_id = o.doc_id JOIN {_CODES} ON a.doc_id % 10 = k.i)
SELECT edition, count(*) AS sections, md5('{R.OWASP_HEADER.format(updated=UPDATED).replace("'", "''")}'
  || string_agg('### ' || code || ' — ' || title || chr(10) || chr(10)
                || CASE WHEN cwes <> '' THEN '**Related CWEs:** ' || cwes || chr(10) || chr(10) ELSE '' END || description,
                chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY code)
  || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Severity Guidelines' || chr(10) || chr(10)
  || '| OWASP Category | Default Severity |' || chr(10) || '|----------------|-----------------|' || chr(10) || '{_SEVERITY_ROWS}') AS document_md5
FROM sec GROUP BY edition""", "fx_owasp_docs"))
def _owasp_document(spark, sf):
    """Ten documents per edition (doc_id / 10), mapped to A01..A10 by doc_id % 10."""
    sec = R.owasp_sections(fixture(spark, sf, "fx_owasp_docs"))
    codes = {i: c for i, (_, c, _) in enumerate(dims.OWASP_CATEGORIES)}
    titles = {c: t for _, c, t in dims.OWASP_CATEGORIES}
    code = dims.lookup(codes, (F.col("doc_id") % 10).cast("int"))
    sec = (sec.withColumn("edition", F.floor(F.col("doc_id") / 10).cast("bigint")).withColumn("code", code)
           .withColumn("section", R.section_text(F.col("code"), dims.lookup(titles, F.col("code")), F.col("cwes"),
                                                 F.col("description"))))
    return R.owasp_document(sec, UPDATED).select("edition", "sections", F.md5("document").alias("document_md5"))


@register("rules.owasp_update_log", oracle_with("""
WITH per AS (SELECT update_id, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS fetched, 10 AS total,
                    CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS errors
             FROM fx_owasp_fetches GROUP BY update_id),
kept AS (SELECT update_id, row_number() OVER (ORDER BY update_id DESC) AS age FROM per WHERE fetched > 0
         ORDER BY update_id DESC LIMIT 50)
SELECT p.*, CASE WHEN p.fetched = 0 THEN 'failed' ELSE 'updated' END AS status, k.age, k.age IS NOT NULL AS kept
FROM per p LEFT JOIN kept k ON p.update_id = k.update_id""", "fx_owasp_fetches"))
def _owasp_update_log(spark, sf):
    return R.update_log(fixture(spark, sf, "fx_owasp_fetches"), 50)
