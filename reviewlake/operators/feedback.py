"""Per-repository feedback mining over the newest issues / reviews, and rule-evolution triggers.

All repos and their whole history at once; a horizon of the newest issues and reviews of each repo is
an argument (a per-repo ``row_number``, pruned by ``WindowGroupLimit`` before the shuffle).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.heavy import most_frequent
from ..functions.text import py_strip, truthy
from . import analytics


def feedback_window(reviews: DataFrame, issues: DataFrame, max_issues: int | None = None,
                    max_reviews: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(issues per repo with the review's repo, reviews per repo): all, or the newest ``max_issues`` / ``max_reviews``
    of each repo with their rank."""
    iw = analytics.repo_issues(reviews, issues, max_issues)
    rw = analytics.repo_reviews(reviews, max_reviews)
    return iw, rw


def _count(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy("repo", *keys).agg(F.count(F.lit(1)).alias("count"))


def _top(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    g = _count(df, keys)
    w = Window.partitionBy("repo").orderBy(F.col("count").desc(), *[F.col(k).asc() for k in keys])
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def category_frequency(window_issues: DataFrame) -> DataFrame:
    return _count(window_issues.withColumn("category", F.coalesce("category", F.lit("general"))), ["category"])


def severity_distribution(window_issues: DataFrame) -> DataFrame:
    return _count(window_issues.withColumn("severity", F.coalesce("severity", F.lit("info"))), ["severity"])


def owasp_frequency(window_issues: DataFrame) -> DataFrame:
    return _count(window_issues.filter(truthy(F.col("owasp_id"))), ["owasp_id"])


def threat_frequency(window_issues: DataFrame) -> DataFrame:
    return _count(window_issues.filter(truthy(F.col("threat_type"))), ["threat_type"])


def file_hotspots(window_issues: DataFrame, n: int) -> DataFrame:
    df = window_issues.filter(truthy(F.col("file_path"))).withColumn("category", F.coalesce("category", F.lit("general")))
    return _top(df, ["file_path", "category"], n)


def posix_parent(path: Column) -> Column:
    """Parent directory in POSIX normal form: ``//`` collapsed, ``.`` parts and trailing ``/`` dropped;
    a top-level name gives ``.``, ``/x`` gives ``/``."""
    p = F.regexp_replace(path, "/+", "/")
    p = F.regexp_replace(p, "(^|/)(\\./)+", "$1")   # drop './' parts
    p = F.regexp_replace(p, "/\\.$", "")             # drop a trailing '/.'
    p = F.when(p == ".", F.lit("")).otherwise(p)
    p = F.regexp_replace(p, "(.)/$", "$1")           # trailing '/', except for the root itself
    # a path without '//', './' or a last '/', '/.' or line end is in normal form: no regex is run on it
    normal = ~(path.contains("//") | path.contains("./") | path.endswith("/") | path.endswith("/.") | (path == ".") | F.right(path, F.lit(1)).isin("\n", "\r", "\u0085", "\u2028", "\u2029"))
    p = F.when(normal, path).otherwise(p)
    name = F.length(F.substring_index(p, "/", -1))    # of what follows the last '/'
    head = p.substr(F.lit(1), F.length(p) - name - 1)
    return F.when(~p.contains("/"), F.lit(".")).when(F.length(head) == 0, F.lit("/")).otherwise(head)


def directory_hotspots(window_issues: DataFrame, n: int) -> DataFrame:
    df = (window_issues.filter(truthy(F.col("file_path")))
          .withColumn("directory", posix_parent(F.col("file_path")))
          .filter((F.col("directory") != "") & (F.col("directory") != ".")))
    return _top(df, ["directory"], n)


def title_pattern(title: Column) -> Column:
    """Strip ``CRITICAL:`` markers, parenthesised text -> one space, ``line 12`` -> ``line N``."""
    t = F.coalesce(title, F.lit(""))
    t = py_strip(F.when(t.contains("CRITICAL:"), F.regexp_replace(t, r"(CRITICAL:\s*)", "")).otherwise(t))
    t = F.when(t.contains("("), py_strip(F.regexp_replace(t, r"\s*\(.*?\)\s*", " "))).otherwise(t)
    return F.when(F.lower(t).contains("line "), F.regexp_replace(t, r"(?i)line \d+", "line N")).otherwise(t)


def recurring_titles(window_issues: DataFrame, n: int, capacity: int | None = None) -> DataFrame:
    """The ``n`` most frequent title patterns of each repo, with count and rank.

    The distinct titles of a repo are not shuffled: see ``functions.heavy``."""
    df = window_issues.select("repo", title_pattern(F.col("title")).alias("title_pattern")).filter(F.col("title_pattern") != "")
    return most_frequent(df, "repo", "title_pattern", n, **({} if capacity is None else {"capacity": capacity}))


def review_stats(window_reviews: DataFrame) -> DataFrame:
    return window_reviews.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.round(F.avg("score"), 1).alias("avg_score"),
        F.round(F.avg("security_score"), 1).alias("avg_security_score"),
        F.round(F.count_if(F.col("block_merge")) / F.count(F.lit(1)) * 100, 1).alias("block_rate"))


# lengths of the top lists of a report
REPORT_FILES, REPORT_DIRECTORIES, REPORT_TITLES = 15, 10, 10


def report(reviews: DataFrame, issues: DataFrame, max_issues: int | None = None, max_reviews: int | None = None) -> DataFrame:
    """All sub-reports as one nested row per repo.

    Every issue gives one entry (list, two keys) for each list that it is in, titles and directories already in normal
    form; one aggregation counts the entries of all lists.  The lists of a fixed length take their first entries by a
    rank that prunes before the shuffle."""
    window, rw = feedback_window(reviews, issues, max_issues, max_reviews)
    none = F.lit(None).cast("string")

    def entry(name: str, key: Column, second: Column = none, where: Column | None = None) -> Column:
        e = F.struct(F.lit(name).alias("list"), key.alias("k1"), second.alias("k2"))
        return e if where is None else F.when(where, e)

    general, path, directory = F.coalesce("category", F.lit("general")), F.col("file_path"), F.col("_directory")
    whole = [entry("category_frequency", general), entry("severity_distribution", F.coalesce("severity", F.lit("info"))),
             entry("owasp_frequency", F.col("owasp_id"), where=truthy(F.col("owasp_id"))), entry("threat_type_frequency", F.col("threat_type"), where=truthy(F.col("threat_type")))]
    first = [entry("file_hotspots", path, general, truthy(path)), entry("directory_hotspots", directory, where=truthy(directory) & (directory != ".")),
             entry("top_recurring_titles", F.col("_title"), where=F.col("_title") != "")]
    named = window.withColumn("_directory", F.when(truthy(path), posix_parent(path))).withColumn("_title", title_pattern(F.col("title")))

    def counted(df: DataFrame, entries: list[Column]) -> DataFrame:
        return df.select("repo", F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("repo", "e.list", "e.k1", "e.k2").agg(F.count(F.lit(1)).alias("count"))

    lengths = {"file_hotspots": REPORT_FILES, "directory_hotspots": REPORT_DIRECTORIES, "top_recurring_titles": REPORT_TITLES}
    w = Window.partitionBy("repo", "list").orderBy(F.col("count").desc(), F.col("k1").asc(), F.col("k2").asc())
    length = F.element_at(F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv]), F.col("list"))
    ranked = counted(named, first).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max(lengths.values())).filter(F.col("r") <= length).drop("r")
    entries = counted(window, whole).unionByName(ranked)

    def nested(name: str, *cols: str) -> Column:
        """The list's entries by count descending, then key."""
        found = F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct((-F.col("count")).alias("neg"), "k1", "k2", "count"))))
        made = F.transform(found, lambda x: F.struct(*[x[k].alias(c) for k, c in zip(("k1", "k2") if len(cols) > 1 else ("k1",), cols)], x["count"].alias("count")))
        return F.when(F.size(made) > 0, made).alias(name)

    severity = F.collect_list(F.when(F.col("list") == "severity_distribution", F.struct("k1", "count")))
    lists = entries.groupBy("repo").agg(
        F.sum(F.when(F.col("list") == "severity_distribution", F.col("count"))).alias("total_issues_analyzed"), nested("category_frequency", "category"),
        F.when(F.size(severity) > 0, F.map_from_entries(severity)).alias("severity_distribution"), nested("owasp_frequency", "owasp_id"), nested("threat_type_frequency", "threat_type"),
        nested("file_hotspots", "file_path", "category"), nested("directory_hotspots", "directory"), nested("top_recurring_titles", "title_pattern"))
    stats = review_stats(rw).select("repo", F.struct("total_reviews", "avg_score", "avg_security_score", "block_rate").alias("review_stats"))
    out = reviews.select("repo").distinct().join(lists, "repo", "left").join(stats, "repo", "left")
    return out.withColumn("total_issues_analyzed", F.coalesce("total_issues_analyzed", F.lit(0)))


def rule_key(repo: Column) -> Column:
    """repo -> safe rule name (``/`` and ``\\`` become ``_``)."""
    return F.translate(repo, "/\\", "__")


def should_evolve(review_counts: DataFrame, repo_rules: DataFrame, trigger_every: int = 10) -> DataFrame:
    """No reviews -> no; no rule yet -> count >= 3; else count % trigger_every == 0.

    ``repo_rules`` has one row per existing rule document (``filename`` = rule key + '.md')."""
    rr = repo_rules.select(F.col("filename").alias("_rule"))
    j = review_counts.join(rr, F.concat(rule_key(F.col("repo")), F.lit(".md")) == F.col("_rule"), "left")
    has_rule = F.col("_rule").isNotNull()
    return j.withColumn("should_evolve",
                        F.when(F.col("cnt") == 0, F.lit(False))
                        .when(~has_rule, F.col("cnt") >= 3)
                        .otherwise(F.col("cnt") % trigger_every == 0)).withColumn("has_rule", has_rule).drop("_rule")


def evolve_decision(review_counts: DataFrame, analyzed: DataFrame, force: bool = False) -> DataFrame:
    """Status per repo: skipped/no_review_data, skipped/insufficient_data (< 3 issues and not forced), ready."""
    j = review_counts.join(analyzed, "repo", "left").withColumn(
        "total_issues_analyzed", F.coalesce("total_issues_analyzed", F.lit(0)))
    no_data = F.col("cnt") == 0
    insufficient = (F.col("total_issues_analyzed") < 3) & F.lit(not force)
    return (j.withColumn("status", F.when(no_data | insufficient, "skipped").otherwise("ready"))
            .withColumn("reason", F.when(no_data, "no_review_data").when(insufficient, "insufficient_data")))


def evolution_request(report_df: DataFrame, rules: DataFrame, rule_chars: int | None = None, total_chars: int | None = None) -> DataFrame:
    """Prompt context per repo: the report as JSON plus the base rules, whole or cut (each, and in all).

    The base-rule text is a single small row (three fixed documents) joined by broadcast."""
    names = dims.EVOLUTION_BASE_RULES
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("filename"))
    base = (rules.filter(F.col("filename").isin(*names) & truthy(F.col("content")))
            .select(order.alias("o"), (F.col("content") if rule_chars is None else F.substring("content", 1, rule_chars)).alias("c"))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "c"))), lambda x: x["c"]),
                              "\n\n---\n\n").alias("base_rules")))
    if total_chars is not None:
        base = base.select(F.substring("base_rules", 1, total_chars).alias("base_rules"))
    payload = F.to_json(F.struct(*[F.col(c) for c in report_df.columns if c != "repo"]))
    # ``base`` is exactly one row (a global aggregate): broadcast it on a constant key
    return (report_df.select("repo", payload.alias("report_json"), F.lit(1).alias("_k"))
            .join(F.broadcast(base.withColumn("_k", F.lit(1))), "_k", "left").drop("_k"))
