"""Deterministic pattern scans over line corpora (re-aimed from prompt/rule text; not a model verdict).

A pack is a small fixed table of (rule_id, regex, severity, category, threat_type).  Lines are
first pre-filtered by one fused alternation of the whole pack (a codegen'd ``rlike``); the
survivors explode an array with one literal ``rlike`` per rule, so every pattern is compiled once
and there is no join.  Regexes stay in the RE2 and Java common subset
(no look-around, no back-references); word boundaries are spelled out as ASCII classes because
``\\b`` differs between the two engines on non-ASCII letters, and ``\\z`` replaces ``$``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markdown import fenced_spans, in_spans
from ..functions.text import py_strip

# FIXED VALUES: rule packs (rule_id, regex, severity, category, threat_type)
SECRET_PACK = [
    ("secret.password", r"(?i)password\s*[:=]", "critical", "security", "secret_leak"),
    ("secret.api_key", r"(?i)api[_-]?key\s*[:=]", "critical", "security", "secret_leak"),
    ("secret.secret", r"(?i)secret\s*[:=]", "critical", "security", "secret_leak"),
    ("secret.token", r"(?i)token\s*[:=]\s*[\"'][^\"']{8,}", "critical", "security", "secret_leak"),
    ("secret.bearer", r"(?i)bearer\s+[a-z0-9._\-]{16,}", "critical", "security", "secret_leak"),
    ("secret.private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "critical", "security", "secret_leak"),
    ("secret.conn_string", r"(?i)[a-z][a-z0-9+.\-]*://[^/\s:@]+:[^/\s@]+@", "critical", "security", "secret_leak"),
    ("secret.cloud_key", r"AKIA[0-9A-Z]{16}", "critical", "security", "secret_leak"),
]
INJECTION_PACK = [
    ("inj.sql_built", r"(?i)(^|[^a-z0-9_])(select|insert|update|delete)[^a-z0-9_].*(\{[a-z_][a-z0-9_]*\}|%s|\"\s*\+)",
     "critical", "security", "injection"),
    ("inj.shell", r"(?i)(os\.system|subprocess\.[a-z_]+|(^|[^a-z0-9_.])exec)\s*\(.*(\{|%s|\+)", "critical", "security",
     "injection"),
    ("inj.inner_html", r"\.innerHTML\s*=", "high", "security", "xss"),
    ("inj.weak_hash", r"(?i)(^|[^a-z0-9_])(md5|sha1)\s*\(", "high", "security", "sensitive_data"),
]
SLOP_PACK = [
    ("slop.todo", r"(?i)(#|//)\s*(todo|fixme)([^a-z0-9_]|\z)", "low", "ai_slop", None),
    ("slop.catch_all", r"(except\s+Exception([^A-Za-z0-9_]|\z)|except\s*:|catch\s*\(\s*Exception([^A-Za-z0-9_]|\z))",
     "medium", "ai_slop", None),
    ("slop.redundant_comment", r"(?i)(#|//)\s*(initialize the variable|return the result|import the module|loop through items)",
     "low", "ai_slop", None),
    ("slop.generic_name", r"^\s*(data|result|temp|item|value|obj|thing)\s*=", "low", "ai_slop", None),
]
PACKS = {"secret": SECRET_PACK, "injection": INJECTION_PACK, "slop": SLOP_PACK}

# language keywords whose disappearance breaks compilation
KEYWORDS = ["await", "async", "static", "var", "public", "private", "protected", "let", "const", "function",
            "def", "return", "throws", "func", "fn", "end"]

LINE_LIMIT = 120


def fused(pack: list[tuple]) -> str:
    return "|".join(f"(?:{r[1]})" for r in pack)


def scan(lines: DataFrame, pack: list[tuple], text: str = "content") -> DataFrame:
    """Lines x pack -> one row per (line, matching rule)."""
    def found(rule: tuple) -> Column:
        names = ("rule_id", "severity", "category", "threat_type")
        values = (rule[0], *rule[2:])
        return F.when(F.col(text).rlike(rule[1]), F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, values)]))

    cand = lines.filter(F.col(text).rlike(fused(pack)))
    return cand.select("*", F.explode(F.array_compact(F.array(*[found(r) for r in pack]))).alias("_r")).select("*", "_r.*").drop("_r")


def split_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole texts -> (key, line_no 1-based, content)."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("i", "content")) \
        .select(key, (F.col("i") + 1).alias("line_no"), "content")


def line_style(lines: DataFrame, limit: int = LINE_LIMIT, text: str = "content") -> DataFrame:
    c = F.col(text)
    rules = F.array(
        F.when(F.length(c) > limit, F.lit("line_too_long")),
        F.when(c.rlike(r"[ \t]+\z"), F.lit("trailing_whitespace")),
        F.when(c.rlike(r"^(\t+ +| +\t+)"), F.lit("mixed_indentation")))
    return (lines.select("*", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))
            .withColumn("severity", F.lit("low")))


TOKEN_SPLIT = r"[^A-Za-z0-9_]+"


def removed_keywords(diff_lines: DataFrame) -> DataFrame:
    """Keywords present on removed lines but absent from the added lines of the same hunk
    (tokens are maximal ASCII word-character runs)."""
    kw = (diff_lines.filter(F.col("type").isin("added", "removed"))
          .select("pr", "file_idx", "hunk_idx", "type", F.explode(F.split("content", TOKEN_SPLIT)).alias("keyword"))
          .filter(F.col("keyword").isin(*KEYWORDS)))
    g = kw.groupBy("pr", "file_idx", "hunk_idx", "keyword").agg(
        F.count_if(F.col("type") == "removed").alias("removed"), F.count_if(F.col("type") == "added").alias("added"))
    return g.filter((F.col("removed") > 0) & (F.col("added") == 0))


def duplicate_blocks(lines: DataFrame, k: int = 4, key: str = "doc_id", text: str = "content") -> DataFrame:
    """Identical runs of ``k`` consecutive non-blank (stripped) lines appearing more than once.

    The block hash is aggregated with map-side partial counts, so a block repeated in a third of
    all documents (a licence header) is pre-counted per task before the shuffle."""
    norm = lines.select(key, "line_no", py_strip(F.col(text)).alias("_n")).filter(F.col("_n") != "")
    w = Window.partitionBy(key).orderBy("line_no")
    nxt = [F.lead("_n", j).over(w) for j in range(1, k)]
    blocks = norm.select(key, "line_no", F.concat_ws("\n", F.col("_n"), *nxt).alias("_b"),
                         nxt[-1].isNotNull().alias("_full")).filter("_full")
    return (blocks.groupBy(F.md5("_b").alias("block_md5"))
            .agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct(key).alias("docs"))
            .filter(F.col("occurrences") > 1))


def _numbered(lines: DataFrame, key: str, text: str) -> DataFrame:
    """(key, j, line_no, n): the stripped lines of a document that are not blank, numbered from 0."""
    norm = lines.select(F.col(key).alias("key"), "line_no", py_strip(F.col(text)).alias("n")).filter(F.col("n") != "")
    return norm.withColumn("j", F.row_number().over(Window.partitionBy("key").orderBy("line_no")) - 1)


def winnowed_prints(numbered: DataFrame, k: int, window: int) -> DataFrame:
    """(key, j, print): of every ``window`` consecutive runs of ``k`` lines the run of the least hash (of equal ones the
    last), so that any ``window + k - 1`` lines in common have a print in common."""
    by = Window.partitionBy("key").orderBy("j")
    grams = numbered.select("key", "j", F.md5(F.concat_ws("\n", "n", *[F.lead("n", i).over(by) for i in range(1, k)])).alias("print"), F.lead("n", k - 1).over(by).isNotNull().alias("full")).filter("full")
    ahead = Window.partitionBy("key").orderBy("j").rowsBetween(0, window - 1)
    least = grams.select("key", "j", F.min(F.struct("print", (-F.col("j")).alias("neg"))).over(ahead).alias("m"), F.max("j").over(Window.partitionBy("key")).alias("last"))
    whole = least.filter((F.col("j") + (window - 1) <= F.col("last")) | (F.col("j") == 0))
    return whole.select("key", (-F.col("m.neg")).alias("j"), F.col("m.print").alias("print")).distinct()


def copied_blocks(lines: DataFrame, k: int = 4, window: int = 4, key: str = "doc_id", text: str = "content") -> DataFrame:
    """Blocks of any length that stand elsewhere too, each with its place and the place of the original.

    Every class of equal winnowed prints has a representative, its first place by (key, line); each other place is
    matched with that one alone, so a class of m places gives m - 1 rows.  Matches that follow each other at the same
    distance are merged by gaps and islands, and each block is extended by the equal lines on both sides (up to
    ``window - 1``, which the prints cannot see).  ``window`` is at most ``k``: neighbouring prints then cover all lines
    between them.

    Columns: key, first_line, last_line, lines (not blank), of_key, of_first_line, of_last_line, block_md5.  Blocks
    shorter than ``k`` lines, blank lines and indentation do not count; null texts have no blocks."""
    if not 1 <= window <= k:
        raise ValueError("window must be between 1 and k")
    numbered = _numbered(lines, key, text)
    prints = winnowed_prints(numbered, k, window)
    first = prints.groupBy("print").agg(F.min(F.struct("key", "j")).alias("of"), F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("print").alias("p"), "of")
    match = prints.join(first, F.col("print") == F.col("p")).filter((F.col("key") != F.col("of.key")) | (F.col("j") != F.col("of.j")))
    match = match.select("key", "j", F.col("of.key").alias("of_key"), (F.col("of.j") - F.col("j")).alias("apart"))
    line = Window.partitionBy("key", "of_key", "apart").orderBy("j")
    gap = F.coalesce(F.col("j") - F.lag("j").over(line) > k, F.lit(True))
    island = match.withColumn("new", gap.cast("int")).withColumn("island", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = island.groupBy("key", "of_key", "apart", "island").agg(F.min("j").alias("a"), (F.max("j") + (k - 1)).alias("b"))
    # equal lines next to the ends
    if window > 1:
        here = numbered.select(F.col("key").alias("hk"), F.col("j").alias("hj"), F.col("n").alias("hn"))
        there = numbered.select(F.col("key").alias("tk"), F.col("j").alias("tj"), F.col("n").alias("tn"))
        steps = blocks.select("*", F.explode(F.array(*[F.lit(x) for x in range(-(window - 1), window) if x])).alias("step"))
        at = F.when(F.col("step") < 0, F.col("a") + F.col("step")).otherwise(F.col("b") + F.col("step"))
        steps = steps.withColumn("at", at)
        beside = steps.join(here, (F.col("key") == F.col("hk")) & (F.col("at") == F.col("hj")), "left").join(there, (F.col("of_key") == F.col("tk")) & (F.col("at") + F.col("apart") == F.col("tj")), "left")
        other = ~F.coalesce(F.col("hn") == F.col("tn"), F.lit(False))
        reach = lambda side: F.coalesce(F.min(F.when(side & other, F.abs("step"))), F.lit(window)) - 1
        blocks = beside.groupBy("key", "of_key", "apart", "island", "a", "b").agg(reach(F.col("step") < 0).alias("up"), reach(F.col("step") > 0).alias("down"))
        blocks = blocks.select("key", "of_key", "apart", (F.col("a") - F.col("up")).alias("a"), (F.col("b") + F.col("down")).alias("b")).distinct()
        # blocks that grew into each other at the same distance are one
        by = Window.partitionBy("key", "of_key", "apart").orderBy("a", "b")
        far = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
        merged = blocks.withColumn("new", F.coalesce(F.col("a") > far + 1, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        blocks = merged.groupBy("key", "of_key", "apart", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    blocks = blocks.select("key", "of_key", "apart", "a", "b")
    held = numbered.select(F.col("key").alias("hk"), F.col("j").alias("hj"), F.col("line_no").alias("hl"), F.col("n").alias("hn"))
    places = blocks.withColumn("at", F.explode(F.sequence("a", "b")))
    text_of = places.join(held, (F.col("key") == F.col("hk")) & (F.col("at") == F.col("hj"))).groupBy("key", "of_key", "apart", "a", "b").agg(
        F.min("hl").alias("first_line"), F.max("hl").alias("last_line"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hj", "hn"))), lambda x: x["hn"]), "\n")).alias("block_md5"))
    ends = numbered.select(F.col("key").alias("tk"), F.col("j").alias("tj"), F.col("line_no").alias("tl"))
    out = text_of.withColumns({"from_j": F.col("a") + F.col("apart"), "to_j": F.col("b") + F.col("apart")})
    for c, j in (("of_first_line", "from_j"), ("of_last_line", "to_j")):
        out = out.join(ends, (F.col("of_key") == F.col("tk")) & (F.col(j) == F.col("tj"))).withColumn(c, F.col("tl")).drop("tk", "tj", "tl")
    return out.select(F.col("key").alias(key), "first_line", "last_line", (F.col("b") - F.col("a") + 1).alias("lines"), F.col("of_key").alias(f"of_{key}"), "of_first_line", "of_last_line", "block_md5")


def severity_guidelines(docs: DataFrame, key: str = "document", text: str = "content") -> DataFrame:
    """Rows of the ``## Severity Guidelines`` table of each document -> (document, issue, severity); headings and tables
    in fenced code blocks are text."""
    ls = docs.select(key, F.split(F.col(text), "\n").alias("_l")).withColumn("_fenced", fenced_spans(F.col("_l")))
    ls = ls.select(key, "_fenced", F.posexplode("_l").alias("i", "line")).filter(~in_spans(F.col("i"), F.col("_fenced"))).drop("_fenced")
    s = py_strip(F.col("line"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ls = ls.withColumn("_section", F.last(F.when(s.startswith("## "), s), ignorenulls=True).over(w))
    rows = ls.filter((F.col("_section") == "## Severity Guidelines") & s.startswith("|") & ~s.rlike(r"^\|[-\s|:]+\|$"))
    cells = F.split(F.regexp_replace(s, r"^\||\|$", ""), r"\|")
    issue = py_strip(cells[0])
    sev = F.lower(py_strip(F.regexp_replace(cells[1], r"\*", "")))
    return (rows.select(key, "i", issue.alias("issue"), sev.alias("severity"))
            .filter((F.col("issue") != "Issue") & (F.col("issue") != "")))
