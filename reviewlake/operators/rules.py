"""Rule-document corpus: catalogue, lookup, priority resolution, coverage, OWASP extraction.

Base and language rule documents form a small dimension (languages x six categories plus a few
general files), repo-specific rules grow with the number of repositories; both are joined by plain
equi-joins whose physical strategy is left to AQE and its size checks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.markdown import fenced_spans, in_spans
from ..functions.text import py_strip, truthy
from .feedback import rule_key


def catalog(rules: DataFrame) -> DataFrame:
    """filename -> (language, category): stem split at the first '-'; no dash -> language NULL."""
    stem = F.regexp_replace(F.col("filename"), r"\.md$", "")
    has_dash = stem.contains("-")
    parts = F.split(stem, "-", 2)
    return rules.select(
        "filename",
        F.when(has_dash, parts[0]).alias("language"),
        F.when(has_dash, parts[1]).otherwise(stem).alias("category"))


def filter_rules(cat: DataFrame, language: str | None = None, category: str | None = None) -> DataFrame:
    out = cat
    if language:
        out = out.filter(F.lower(F.coalesce("language", F.lit(""))) == language.lower())
    if category:
        out = out.filter(F.lower(F.coalesce("category", F.lit(""))) == category.lower())
    return out


def valid_rule_name(name: Column) -> Column:
    return ~(name.contains("/") | name.contains("\\") | name.contains(".."))


def get_rule(requests: DataFrame, rules: DataFrame, name_col: str = "name") -> DataFrame:
    """Content by exact file name; path-like names are rejected (NULL)."""
    r = rules.select(F.col("filename").alias("_f"), F.col("content").alias("_c"))
    j = requests.join(r, (F.col(name_col) == F.col("_f")) & valid_rule_name(F.col(name_col)), "left")
    return j.withColumn("content", F.col("_c")).drop("_f", "_c")


def repo_rule(repos: DataFrame, repo_rules: DataFrame) -> DataFrame:
    """Current repo-specific rule per repo (or NULL); ``repo_rules.filename`` is the rule key + '.md'."""
    rr = repo_rules.select(F.col("filename").alias("_f"), F.col("content").alias("repo_rule"))
    return repos.join(rr, F.concat(rule_key(F.col("repo")), F.lit(".md")) == F.col("_f"), "left").drop("_f")


def resolve(requests: DataFrame, rules: DataFrame, repo_rules: DataFrame, key: str = "review_id") -> DataFrame:
    """Per request (key, repo, language, focus_pos, focus): ordered used-file list and content.

    Order: repo rule, then per focus (in order, duplicates kept) the language rule else the base
    rule, then the OWASP document when ``security`` is a focus.  Unknown focus areas and empty repo or
    OWASP documents are skipped.

    Requests with the same repo, language and focus list have the same rules, so only distinct lists are
    resolved; the text of a list is put together once and joined to its requests last.
    """
    areas = F.transform(F.array_sort(F.collect_list(F.struct(F.col("focus_pos").alias("p"), F.lower(F.coalesce("focus", F.lit(""))).alias("a")))),
                        lambda x: x["a"])
    reqs = requests.groupBy(key, "repo").agg(F.max("language").alias("language"), areas.alias("areas"))
    reqs = reqs.withColumn("_id", F.md5(F.to_json(F.struct("repo", "language", "areas"))))
    lists = reqs.groupBy("_id").agg(F.first("repo").alias("repo"), F.first("language").alias("language"), F.first("areas").alias("areas"))

    docs = rules.select("filename", "content")
    f = lists.select("_id", "language", F.posexplode("areas").alias("o", "_area"))
    f = f.withColumn("_base", dims.lookup(dims.FOCUS_RULE_FILES, F.col("_area"))).filter(F.col("_base").isNotNull())
    f = f.withColumn("_lang_file", F.when(truthy(F.col("language")), F.concat(
        F.col("language"), F.lit("-"), F.regexp_replace("_base", r"\.md$", ""), F.lit(".md"))))
    # which documents exist is settled on names alone
    f = f.join(docs.select(F.col("filename").alias("_lf")), F.col("_lang_file") == F.col("_lf"), "left")
    f = f.withColumn("file", F.coalesce("_lf", "_base"))
    title = F.when(F.col("_lf").isNotNull(), F.concat(F.lit("\n## Rules for "), F.upper("language"), F.lit(": "), F.upper("_area"), F.lit("\n"))) \
        .otherwise(F.concat(F.lit("\n## Rules for: "), F.upper("_area"), F.lit("\n")))
    named = f.select("_id", "o", "file", title.alias("title"))
    owasp = lists.filter(F.array_contains("areas", "security")).select(
        "_id", F.lit(1 << 20).alias("o"), F.lit("owasp-top10.md").alias("file"), F.lit("\n## OWASP Top 10 Rules\n").alias("title"))
    texts = named.unionByName(owasp).join(docs.withColumnRenamed("filename", "file"), "file")
    repo_part = repo_rule(lists, repo_rules).filter(truthy(F.col("repo_rule"))).select(
        "_id", F.lit(-1).alias("o"), F.concat(F.lit("repo/"), rule_key(F.col("repo")), F.lit(".md")).alias("file"),
        F.concat(F.lit("\n## REPO-SPECIFIC RULES for "), F.col("repo"), F.lit("\n")).alias("title"), F.col("repo_rule").alias("content"))
    parts = texts.filter((F.col("file") != "owasp-top10.md") | truthy(F.col("content"))).unionByName(repo_part)
    agg = parts.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("o", "file", F.concat("title", "content").alias("part")))).alias("_p"))
    agg = agg.select("_id", F.transform("_p", lambda x: x["file"]).alias("files"),
                     py_strip(F.array_join(F.transform("_p", lambda x: x["part"]), "\n\n")).alias("content"))
    return reqs.select(key, "_id").join(agg, "_id", "left").select(
        key, F.coalesce("files", F.array().cast("array<string>")).alias("files"), F.coalesce("content", F.lit("")).alias("content"))


def rule_category(focus: Column) -> Column:
    """focus area -> generatable rule category (``best_practices`` -> ``best-practices``), else NULL."""
    c = F.regexp_replace(F.lower(focus), "_", "-")
    return F.when(c.isin(*dims.RULE_CATEGORIES), c)


def missing_rules(requests: DataFrame, cat: DataFrame) -> DataFrame:
    """Distinct (language, category) requested with no ``{language}-{category}.md`` document."""
    want = (requests.filter(truthy(F.col("language")))
            .select("language", rule_category(F.col("focus")).alias("category"))
            .filter(F.col("category").isNotNull()).distinct()
            .withColumn("filename", F.concat("language", F.lit("-"), "category", F.lit(".md"))))
    return want.join(cat.select("filename"), "filename", "left_anti")


def coverage(languages: DataFrame, cat: DataFrame) -> DataFrame:
    """language x all six categories existence matrix (pivot with fixed values)."""
    grid = languages.select("language", F.explode(F.array(*[F.lit(c) for c in dims.RULE_CATEGORIES])).alias("category"))
    have = cat.select("filename").withColumn("_has", F.lit(True))
    j = grid.withColumn("filename", F.concat("language", F.lit("-"), "category", F.lit(".md"))).join(have, "filename", "left")
    return (j.groupBy("language").pivot("category", dims.RULE_CATEGORIES)
            .agg(F.max(F.coalesce("_has", F.lit(False)))))


# FIXED VALUES: base rule document per generatable category
GENERATION_BASE = {
    "security": "security.md",
    "performance": "performance.md",
    "fundamentals": "dotnet-fundamentals.md",
    "compilation": "compilation.md",
    "best-practices": "best-practices.md",
    "linter": "linter.md",
}


def generation_request(missing: DataFrame, rules: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Base rule text (whole, or its first ``max_chars`` characters) and display name per missing (language, category)."""
    from .corpus import language_name

    base = rules.select(F.col("filename").alias("_bf"), F.col("content").alias("_bc"))
    text = F.col("_bc") if max_chars is None else F.substring("_bc", 1, max_chars)
    m = missing.withColumn("_base", dims.lookup(GENERATION_BASE, F.col("category")))
    return (m.join(base, F.col("_base") == F.col("_bf"), "left")
            .select("language", "category", language_name(F.col("language")).alias("display_name"),
                    F.coalesce(text, F.lit("")).alias("base_rules")))


# ------------------------------------------------------------------------------------------ OWASP

def owasp_sections(docs: DataFrame, key: str = "doc_id", text: str = "raw_md", description_chars: int | None = None,
                   fallback_end: int | None = None) -> DataFrame:
    """Per document: sorted distinct CWE ids and the description: what stands between ``## Description`` /
    ``## Overview`` and the next ``## ``, else the lines from the third on (before line ``fallback_end`` if given),
    whole or cut to ``description_chars``.

    Lines in fenced code blocks are text, not headings.  Lines are exploded once per document after hash-partitioning
    the documents, so the state window (last marker before each line) needs no further exchange; each line is
    kept once."""
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"CWE-\d+"), 0)))
    d = docs.select(F.col(key).alias("_k"), F.split(py_strip(F.coalesce(F.col(text), F.lit(""))), "\r\n|\r|\n").alias("_l"), ids.alias("cwes")).repartition("_k")
    d = d.withColumn("_fenced", fenced_spans(F.col("_l")))
    lines = d.select("_k", "cwes", "_fenced", F.posexplode("_l").alias("i", "line"))
    s = py_strip(F.col("line"))
    heading = s.startswith("## ") & ~in_spans(F.col("i"), F.col("_fenced"))
    marker = F.when(heading & (s.startswith("## Description") | s.startswith("## Overview")), "start").when(heading, "end")
    w = Window.partitionBy("_k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_m", marker).withColumn("_state", F.last("_m", ignorenulls=True).over(w))
    in_desc = F.coalesce(F.col("_m").isNull() & (F.col("_state") == "start"), F.lit(False))
    in_rest = (F.col("i") >= 2) if fallback_end is None else (F.col("i") >= 2) & (F.col("i") < fallback_end)
    agg = lines.filter(in_desc | in_rest | (F.col("i") == 0)).groupBy("_k").agg(
        F.first("cwes").alias("cwes"), F.array_sort(F.collect_list(F.struct("i", "line", in_desc.alias("d"), in_rest.alias("r")))).alias("_l"))
    joined = lambda part: py_strip(F.array_join(F.transform(F.filter("_l", lambda x: x[part]), lambda x: x["line"]), "\n"))
    desc = joined("d")
    whole = F.when(desc != "", desc).otherwise(joined("r"))
    return agg.select(F.col("_k").alias(key), (whole if description_chars is None else F.substring(whole, 1, description_chars)).alias("description"), "cwes")


def section_text(code: Column, title: Column, cwes: Column, description: Column) -> Column:
    head = F.concat(F.lit("### "), code, F.lit(" — "), title, F.lit("\n\n"))
    cwe_line = F.when(F.size(cwes) > 0, F.concat(F.lit("**Related CWEs:** "), F.array_join(cwes, ", "), F.lit("\n\n"))) \
        .otherwise(F.lit(""))
    return F.concat(head, cwe_line, description)


# FIXED VALUES: default severity per OWASP category (consolidated document footer)
OWASP_DEFAULT_SEVERITY = [
    ("A01", "Broken Access Control", "HIGH–CRITICAL"),
    ("A02", "Cryptographic Failures", "HIGH–CRITICAL"),
    ("A03", "Injection", "CRITICAL"),
    ("A04", "Insecure Design", "MEDIUM–HIGH"),
    ("A05", "Security Misconfiguration", "MEDIUM–HIGH"),
    ("A06", "Vulnerable Components", "MEDIUM–HIGH"),
    ("A07", "Auth Failures", "HIGH–CRITICAL"),
    ("A08", "Integrity Failures", "HIGH"),
    ("A09", "Logging Failures", "LOW–MEDIUM"),
    ("A10", "SSRF", "HIGH–CRITICAL"),
]

# FIXED VALUES: head of the consolidated document; {updated} is the time of the update
OWASP_HEADER = """# OWASP Top 10 — 2021 Edition (Review Rules)

> Auto-generated from the official OWASP/Top10 GitHub repository.
> Last updated: {updated}
>
> These rules are injected into AI code reviews when security is a focus area.
> For the latest source see: https://github.com/OWASP/Top10

---

## How to Use in Reviews

For each security issue found, include:
- `category`: "security"
- `owasp_id`: The relevant OWASP category code (e.g. "A01", "A03")
- `cwe_id`: The most specific CWE identifier if known
- `threat_type`: One of injection, broken_auth, sensitive_data, xxe, broken_access,
  misconfig, xss, deserialization, vulnerable_deps, insufficient_logging, secret_leak

---

"""


def owasp_document(sections: DataFrame, updated: str, edition: str = "edition") -> DataFrame:
    """Consolidated document per edition: usage header with the time of the update (an argument, never now()),
    sections in A01..A10 order, then the severity table."""
    table = "\n\n---\n\n## Severity Guidelines\n\n| OWASP Category | Default Severity |\n|----------------|-----------------|\n" + \
        "".join(f"| {c} — {t} | {s} |\n" for c, t, s in OWASP_DEFAULT_SEVERITY)
    return sections.groupBy(edition).agg(
        F.count(F.lit(1)).alias("sections"),
        F.concat(F.lit(OWASP_HEADER.format(updated=updated)),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", "section"))), lambda x: x["section"]),
                              "\n\n---\n\n"),
                 F.lit(table)).alias("document"))


def update_log(attempts: DataFrame, keep: int) -> DataFrame:
    """Fetch attempts (update_id, code, ok) -> one log entry per update with fetched/total/errors;
    updates that fetched nothing fail and are not logged; the log keeps the newest ``keep``."""
    per = attempts.groupBy("update_id").agg(
        F.count_if("ok").alias("fetched"), F.lit(len(dims.OWASP_CATEGORIES)).alias("total"),
        F.count_if(~F.col("ok")).alias("errors"))
    per = per.withColumn("status", F.when(F.col("fetched") == 0, "failed").otherwise("updated"))
    logged = per.filter(F.col("status") == "updated")
    # newest ``keep`` entries: a global top-k (each task keeps ``keep`` rows), then rank those few
    newest = logged.orderBy(F.col("update_id").desc()).limit(keep)
    kept = newest.withColumn("age", F.row_number().over(Window.orderBy(F.col("update_id").desc())))
    return per.join(kept.select("update_id", "age"), "update_id", "left").withColumn("kept", F.col("age").isNotNull())
