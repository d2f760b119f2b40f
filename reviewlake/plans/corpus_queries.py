"""corpus.*: project file inventories (fx_files, fx_ignore, documents)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import corpus as C
from ..sources.tables import read_table
from .fixtures import fixture, oracle_with
from .registry import register


def _files(spark, sf):
    return fixture(spark, sf, "fx_files")


def _vals(d: dict, a: str, b: str) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in d.items())
    return f"(VALUES {rows}) AS m({a}, {b})"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


# DuckDB: file name and Python-style suffix of fx_files.rel_path
SUFFIX_CTE = """
fs AS (SELECT *, regexp_extract(rel_path, '[^/]*$') AS name,
              regexp_extract(regexp_extract(rel_path, '[^/]*$'), '^.+(\\.[^.]+)$', 1) AS sfx
       FROM fx_files)"""


@register("corpus.language", oracle_with(f"""
WITH {SUFFIX_CTE}
SELECT fs.project, fs.rel_path, m.language
FROM fs LEFT JOIN {_vals(dims.EXTENSION_LANGUAGE, 'ext', 'language')} ON lower(substring(fs.sfx, 2)) = m.ext""", "fx_files"))
def _language(spark, sf):
    return C.with_language(_files(spark, sf)).select("project", "rel_path", "language")


@register("corpus.language_auto", oracle_with(f"""
WITH {SUFFIX_CTE}
SELECT fs.project, fs.rel_path, coalesce(m.language, 'auto') AS language
FROM fs LEFT JOIN {_vals(dims.PROJECT_EXTENSION_LANGUAGE, 'ext', 'language')} ON lower(fs.sfx) = m.ext""", "fx_files"))
def _language_auto(spark, sf):
    return C.with_language_auto(_files(spark, sf)).select("project", "rel_path", "language")


@register("corpus.dominant_language", oracle_with(f"""
WITH {SUFFIX_CTE},
v AS (SELECT fs.project, m.language, count(*) AS files, min(fs.doc_id) AS first_pos
      FROM fs JOIN {_vals(dims.EXTENSION_LANGUAGE, 'ext', 'language')} ON lower(substring(fs.sfx, 2)) = m.ext
      WHERE lower(fs.name) NOT IN ({', '.join(f"'{x}'" for x in dims.CONFIG_FILE_NAMES)})
      GROUP BY fs.project, m.language)
SELECT project, language, files FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY files DESC, first_pos) AS r FROM v) t WHERE r = 1""",
                                                   "fx_files"))
def _dominant_language(spark, sf):
    return C.dominant_language(_files(spark, sf).withColumn("pos", F.col("doc_id")))


@register("corpus.language_resolve", oracle_with(f"""
WITH {SUFFIX_CTE}
SELECT fs.project, fs.rel_path,
       coalesce(CASE WHEN a.language IS NOT NULL AND a.language <> 'auto' THEN a.language END, d.language, 'auto') AS language
FROM fs LEFT JOIN {_vals(dims.PROJECT_EXTENSION_LANGUAGE, 'ext', 'language').replace(' AS m(', ' AS a(')}
          ON lower(fs.sfx) = a.ext
        LEFT JOIN {_vals(dims.EXTENSION_LANGUAGE, 'ext', 'language').replace(' AS m(', ' AS d(')}
          ON lower(substring(fs.sfx, 2)) = d.ext""", "fx_files"))
def _language_resolve(spark, sf):
    f = _files(spark, sf)
    return f.select("project", "rel_path", C.resolve_language(C.language_auto_of(F.col("rel_path")),
                                                              C.language_of(F.col("rel_path"))).alias("language"))


@register("corpus.language_name", oracle_with(f"""
WITH {SUFFIX_CTE},
l AS (SELECT DISTINCT coalesce(m.language, 'auto') AS language
      FROM fs LEFT JOIN {_vals(dims.PROJECT_EXTENSION_LANGUAGE, 'ext', 'language')} ON lower(fs.sfx) = m.ext)
SELECT l.language, coalesce(n.name, upper(substring(l.language, 1, 1)) || lower(substring(l.language, 2))) AS name
FROM l LEFT JOIN {_vals(dims.LANGUAGE_DISPLAY, 'code', 'name').replace(' AS m(', ' AS n(')} ON l.language = n.code""",
                                               "fx_files"))
def _language_name(spark, sf):
    langs = _files(spark, sf).select(C.language_auto_of(F.col("rel_path")).alias("language")).distinct()
    return langs.select("language", C.language_name(F.col("language")).alias("name"))


@register("corpus.supported_languages", oracle_with(f"""
WITH {SUFFIX_CTE},
s AS (SELECT DISTINCT language FROM {_vals(dims.EXTENSION_LANGUAGE, 'ext', 'language')}),
c AS (SELECT m.language, count(*) AS files
      FROM fs JOIN {_vals(dims.EXTENSION_LANGUAGE, 'ext', 'language')} ON lower(substring(fs.sfx, 2)) = m.ext GROUP BY 1)
SELECT s.language, CAST(coalesce(c.files, 0) AS BIGINT) AS files FROM s LEFT JOIN c ON s.language = c.language""",
                                                      "fx_files"))
def _supported_languages(spark, sf):
    """Every supported language with the number of corpus files written in it."""
    used = (C.with_language(_files(spark, sf)).filter(F.col("language").isNotNull())
            .groupBy("language").agg(F.count(F.lit(1)).alias("files")))
    return C.supported_languages(spark).join(F.broadcast(used), "language", "left").fillna(0, ["files"])


CLASSIFY_SQL = f"""
CASE WHEN list_has_any(string_split(lower(rel_path), '/'), {_list(dims.AUTO_GENERATED_DIRS)})
          OR {' OR '.join(f"contains(lower(rel_path), '{s}')" for s in dims.AUTO_GENERATED_SUBSTRINGS)} THEN 'auto_generated'
     WHEN list_has_any(string_split(lower(rel_path), '/'), {_list(dims.TEST_PARTS)})
          OR {' OR '.join(f"ends_with(lower(rel_path), '{s}')" for s in dims.TEST_SUFFIXES)} THEN 'test'
     WHEN lower(name) IN ({', '.join(f"'{x}'" for x in dims.BOILERPLATE_NAMES)}) THEN 'boilerplate'
     WHEN lower(sfx) IN ({', '.join(f"'{x}'" for x in dims.CONFIG_EXTENSIONS)}) THEN 'config'
     ELSE 'source' END"""


@register("corpus.classify", oracle_with(f"""
WITH {SUFFIX_CTE}
SELECT project, rel_path, {CLASSIFY_SQL} AS category FROM fs""", "fx_files"))
def _classify(spark, sf):
    return C.classify(_files(spark, sf)).select("project", "rel_path", "category")


IGNORED_CTE = """
pp AS (SELECT project, rel_path, unnest(string_split(rel_path, '/')) AS part,
              unnest(generate_series(1, len(string_split(rel_path, '/')))) AS k,
              len(string_split(rel_path, '/')) AS nparts
       FROM fx_files),
pat AS (SELECT pattern, rtrim(pattern, '/') AS p, ends_with(pattern, '/') AS is_dir FROM fx_ignore),
hit AS (
  SELECT DISTINCT pp.project, pp.rel_path FROM pp JOIN pat ON NOT contains(pat.p, '/')
    AND pp.part GLOB pat.p AND (pp.k < pp.nparts OR NOT pat.is_dir)
  UNION
  SELECT DISTINCT f.project, f.rel_path FROM fx_files f JOIN pat ON contains(pat.p, '/')
    AND (f.rel_path GLOB pat.p OR f.rel_path GLOB pat.p || '/**' OR (pat.is_dir AND f.rel_path GLOB pat.p || '*')))"""


@register("corpus.ignored", oracle_with(f"""
WITH {IGNORED_CTE}
SELECT f.project, f.rel_path, h.rel_path IS NOT NULL AS ignored
FROM fx_files f LEFT JOIN hit h ON f.project = h.project AND f.rel_path = h.rel_path""", "fx_files", "fx_ignore"))
def _ignored(spark, sf):
    return C.flag_ignored(_files(spark, sf), fixture(spark, sf, "fx_ignore")).select("project", "rel_path", "ignored")


@register("corpus.skip_dirs", oracle_with(f"""
SELECT project, rel_path FROM fx_files
WHERE NOT list_has_any(string_split(rel_path, '/'), {_list(dims.SKIP_DIRS)})""", "fx_files"))
def _skip_dirs(spark, sf):
    return C.drop_skip_dirs(_files(spark, sf)).select("project", "rel_path")


ELIGIBLE_WHERE = f"lower(sfx) IN ({', '.join(repr(x) for x in dims.REVIEW_EXTENSIONS)})"


@register("corpus.eligible", oracle_with(f"""
WITH {SUFFIX_CTE}
SELECT project, rel_path, size_bytes FROM fs WHERE {ELIGIBLE_WHERE}""", "fx_files"))
def _eligible(spark, sf):
    return C.eligible(_files(spark, sf)).select("project", "rel_path", "size_bytes")


PLAN_CTE = f"""{SUFFIX_CTE}, {IGNORED_CTE},
plan AS (
  SELECT fs.project, fs.rel_path AS file, coalesce(m.language, 'auto') AS language, fs.size_bytes AS size,
         {CLASSIFY_SQL.replace('rel_path', 'fs.rel_path').replace('lower(name)', 'lower(fs.name)').replace('lower(sfx)', 'lower(fs.sfx)')}
           AS category
  FROM fs LEFT JOIN {_vals(dims.PROJECT_EXTENSION_LANGUAGE, 'ext', 'language')} ON lower(fs.sfx) = m.ext
  WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.project = fs.project AND h.rel_path = fs.rel_path)
    AND {ELIGIBLE_WHERE.replace('sfx', 'fs.sfx')})"""


def _plan(spark, sf):
    return C.review_plan(_files(spark, sf), fixture(spark, sf, "fx_ignore"))


@register("corpus.plan", oracle_with(f"""
WITH {PLAN_CTE},
ign AS (SELECT project, count(*) AS ignored_by_reviewignore FROM hit GROUP BY project)
SELECT p.*, CAST(coalesce(i.ignored_by_reviewignore, 0) AS BIGINT) AS ignored_by_reviewignore
FROM plan p LEFT JOIN ign i ON p.project = i.project""", "fx_files", "fx_ignore"))
def _plan_q(spark, sf):
    plan, counts = _plan(spark, sf)
    return plan.join(counts, "project", "left").fillna(0, ["ignored_by_reviewignore"])


PLAN_EXCLUDE = ["test", "auto_generated"]


@register("corpus.plan_counts", oracle_with(f"""
WITH {PLAN_CTE}
SELECT project, 'category' AS kind, category AS key, count(*) AS files, CAST(NULL AS BIGINT) AS size_bytes,
       CAST(NULL AS BIGINT) AS est_seconds FROM plan GROUP BY project, category
UNION ALL
SELECT project, 'language', language, count(*), NULL, NULL FROM plan
WHERE category NOT IN ('test', 'auto_generated') GROUP BY project, language
UNION ALL
SELECT project, 'total', NULL, count(*), CAST(sum(size) AS BIGINT),
       CAST(10 * sum(CASE WHEN category NOT IN ('test', 'auto_generated') THEN 1 ELSE 0 END) AS BIGINT)
FROM plan GROUP BY project""", "fx_files", "fx_ignore"))
def _plan_counts(spark, sf):
    plan, _ = _plan(spark, sf)
    return C.plan_counts(plan, PLAN_EXCLUDE, 10)


@register("corpus.exclude_categories", oracle_with(f"""
WITH {PLAN_CTE}
SELECT project, category, count(*) AS skipped FROM plan WHERE category IN ('test', 'auto_generated')
GROUP BY project, category""", "fx_files", "fx_ignore"))
def _exclude_categories(spark, sf):
    plan, _ = _plan(spark, sf)
    return C.exclude_categories(plan, PLAN_EXCLUDE)[1]


@register("corpus.cap_files", oracle_with("""
SELECT project, rel_path, rank FROM (
  SELECT project, rel_path, row_number() OVER (PARTITION BY project ORDER BY rel_path) AS rank FROM fx_files) t
WHERE rank <= 100""", "fx_files"))
def _cap_files(spark, sf):
    return C.cap_files(_files(spark, sf), 100).select("project", "rel_path", "rank")


@register("corpus.prepare_text", oracle_with("""
SELECT f.project, f.rel_path,
       CASE WHEN length(regexp_replace(coalesce(d.text, ''), '^\\s+|\\s+$', '', 'g')) = 0 THEN 'empty' ELSE 'ready' END
         AS status,
       CASE WHEN length(regexp_replace(coalesce(d.text, ''), '^\\s+|\\s+$', '', 'g')) = 0 THEN NULL
            ELSE false END AS truncated,
       CASE WHEN length(regexp_replace(coalesce(d.text, ''), '^\\s+|\\s+$', '', 'g')) = 0 THEN NULL
            ELSE length(d.text) END AS code_chars,
       CASE WHEN length(regexp_replace(coalesce(d.text, ''), '^\\s+|\\s+$', '', 'g')) = 0 THEN NULL
            ELSE length(d.text) - length(replace(d.text, chr(10), '')) + 1 END
         AS lines
FROM fx_files f LEFT JOIN documents d ON f.doc_id = d.doc_id""", "fx_files"))
def _prepare_text(spark, sf):
    files = _files(spark, sf).join(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "left")
    out = C.prepare_text(files)
    return out.select("project", "rel_path", "status", "truncated", F.length("code").alias("code_chars"), "lines")
