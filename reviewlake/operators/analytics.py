"""Rollups, frequencies, hotspots, trends and project measures.

Top-k rules: every limit has a total order (count desc then key asc; newest first =
``created_at desc, review_id desc``).  Global top-k is ``orderBy().limit()`` which Catalyst plans as
``TakeOrderedAndProject`` (each task keeps only k rows).  Per-group top-k is ``row_number() <= k``
which Spark turns into a ``WindowGroupLimit`` before the shuffle, so a hot repo sends at most k
rows per map task rather than its whole history.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.ranking import running_sums
from ..functions.text import falsy, truthy
from ..session import scratch_path
from . import findings


def _top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


# ------------------------------------------------------------------------------------------
# snapshot-level (one row per review)
# ------------------------------------------------------------------------------------------

def _counted_map(values: Column) -> Column:
    """Values of one review -> map of value to number (a review's issues are bounded by one response)."""
    return F.coalesce(F.map_from_entries(F.transform(F.array_distinct(values), lambda v: F.struct(
        v.alias("key"), F.size(F.filter(values, lambda x: x == v)).cast("bigint").alias("value")))), F.create_map().cast("map<string,bigint>"))


def snapshot(reviews: DataFrame, issues: DataFrame) -> DataFrame:
    """Per-review snapshot with counters plus ``categories`` / ``threat_types`` maps, in one aggregation of the issues."""
    extra = [F.collect_list("category").alias("_c"), F.collect_list(F.when(truthy(F.col("threat_type")), F.col("threat_type"))).alias("_t")]
    rolled = findings.review_rollup(reviews, issues, extra=extra)
    return rolled.withColumns({"categories": _counted_map(F.col("_c")), "threat_types": _counted_map(F.col("_t"))}).drop("_c", "_t")


def overview(snaps: DataFrame) -> DataFrame:
    """Nine global measures; an empty input gives zeros (global aggregate always has one row)."""
    return snaps.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.coalesce(F.round(F.avg("score"), 1), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.round(F.avg("security_score"), 1), F.lit(0.0)).alias("avg_security_score"),
        F.coalesce(F.sum("total_issues"), F.lit(0)).cast("bigint").alias("total_issues"),
        F.coalesce(F.sum("critical_count"), F.lit(0)).cast("bigint").alias("total_critical"),
        F.coalesce(F.sum("security_issues_count"), F.lit(0)).cast("bigint").alias("total_security_issues"),
        F.coalesce(F.sum("ai_slop_count"), F.lit(0)).cast("bigint").alias("total_ai_slop"),
        F.count_if(F.col("block_merge")).alias("blocked_merges"),
        F.count_if(F.col("secret_leak_detected")).alias("secret_leaks"),
    )


def newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("review_id").desc()]


def score_trend(snaps: DataFrame, n: int) -> DataFrame:
    """Last ``n`` reviews in arrival order."""
    return (snaps.orderBy(*newest_first()).limit(n)
            .select("created_at", "review_id", "score", "security_score", "pr_id"))


def newest_snapshots(reviews: DataFrame, issues: DataFrame, n: int) -> DataFrame:
    """Counters of the newest ``n`` reviews only: the reviews are chosen first, then their issues are rolled up."""
    newest = reviews.orderBy(*newest_first()).limit(n)
    few = issues.join(F.broadcast(newest.select("review_id")), "review_id", "left_semi")  # n rows
    return findings.review_rollup(newest, few)


def recent_reviews(snaps: DataFrame, n: int) -> DataFrame:
    return snaps.orderBy(*newest_first()).limit(n)


def top_categories(issues: DataFrame, n: int) -> DataFrame:
    return (issues.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("category").asc()).limit(n))


def owasp_distribution(snaps: DataFrame) -> DataFrame:
    """Reviews hitting each OWASP id (each review once: ``owasp_hits`` is a set)."""
    return (snaps.select("review_id", F.explode("owasp_hits").alias("owasp_id"))
            .groupBy("owasp_id").agg(F.count(F.lit(1)).alias("reviews")))


def threat_totals(issues: DataFrame) -> DataFrame:
    return (issues.filter(truthy(F.col("threat_type")))
            .groupBy("threat_type").agg(F.count(F.lit(1)).alias("issues")))


def security_breakdown(snaps: DataFrame) -> DataFrame:
    return snaps.agg(
        F.count_if(F.col("secret_leak_detected")).alias("total_secret_leaks"),
        F.coalesce(F.round(F.avg("security_score"), 1), F.lit(0.0)).alias("avg_security_score"))


def author_stats(snaps: DataFrame, n: int) -> DataFrame:
    return (snaps.filter(truthy(F.col("author")))
            .groupBy("author").agg(
                F.count(F.lit(1)).alias("reviews"),
                F.round(F.avg("score"), 1).alias("avg_score"),
                F.sum("total_issues").cast("bigint").alias("total_issues"),
                F.count_if(F.col("block_merge")).alias("blocked"))
            .orderBy(F.col("reviews").desc(), F.col("author").asc()).limit(n))


# ------------------------------------------------------------------------------------------
# per-repo store queries (all history)
# ------------------------------------------------------------------------------------------

def repo_issues(reviews: DataFrame, issues: DataFrame, n: int | None, category: str | None = None) -> DataFrame:
    """issues ⋈ reviews, newest ``n`` per repo, or all unranked for None (optional category).

    The threshold is cut before the join: issues are counted per review, and a repo's newest reviews are kept up to
    the one that fills ``n`` (at most ``n`` reviews with an issue each).  These reviews are stored first, so that the
    join knows their size and does not shuffle all issues to meet a few.  Only their issues are joined and ranked."""
    r = reviews.select("review_id", "repo", "pr_id", F.col("created_at").alias("review_ts"))
    i = issues if category is None else issues.filter(F.col("category") == category)
    if n is None:
        return i.join(r, "review_id")
    newest = [F.col("review_ts").desc(), F.col("review_id").desc()]
    counted = r.join(i.groupBy("review_id").agg(F.count(F.lit(1)).alias("_issues")), "review_id")
    counted = _top_per_group(counted, ["repo"], newest, n, "_r")
    before = Window.partitionBy("repo").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    kept = counted.withColumn("_before", F.sum("_issues").over(before)).filter(F.coalesce("_before", F.lit(0)) < n).drop("_issues", "_r", "_before")
    path = scratch_path(reviews.sparkSession, f"newest-{uuid.uuid4().hex}")
    kept.write.parquet(path)
    return _top_per_group(i.join(reviews.sparkSession.read.parquet(path), "review_id"), ["repo"], [*newest, F.col("pos").asc(), F.col("issue_id").asc()], n)


def repo_reviews(reviews: DataFrame, n: int | None) -> DataFrame:
    return reviews if n is None else _top_per_group(reviews, ["repo"], newest_first(), n)


def repo_review_count(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("repo").agg(F.count(F.lit(1)).alias("cnt"))


def _with_repo(reviews: DataFrame, issues: DataFrame) -> DataFrame:
    return issues.join(reviews.select("review_id", "repo"), "review_id")


def _freq(df: DataFrame, keys: list[str], n: int | None) -> DataFrame:
    g = df.groupBy("repo", *keys).agg(F.count(F.lit(1)).alias("cnt"))
    if n is None:
        return g
    return _top_per_group(g, ["repo"], [F.col("cnt").desc(), *[F.col(k).asc() for k in keys]], n)


def category_frequency(reviews: DataFrame, issues: DataFrame, n: int) -> DataFrame:
    return _freq(_with_repo(reviews, issues), ["category"], n)


def owasp_frequency(reviews: DataFrame, issues: DataFrame, n: int) -> DataFrame:
    return _freq(_with_repo(reviews, issues.filter(truthy(F.col("owasp_id")))), ["owasp_id"], n)


def file_frequency(reviews: DataFrame, issues: DataFrame, n: int) -> DataFrame:
    """Non-NULL paths only; ``''`` is kept (SQL semantics, unlike the feedback hotspots)."""
    return _freq(_with_repo(reviews, issues.filter(F.col("file_path").isNotNull())), ["file_path", "category"], n)


def severity_distribution(reviews: DataFrame, issues: DataFrame) -> DataFrame:
    return _freq(_with_repo(reviews, issues), ["severity"], None)


def threat_frequency(reviews: DataFrame, issues: DataFrame, n: int) -> DataFrame:
    return _freq(_with_repo(reviews, issues.filter(truthy(F.col("threat_type")))), ["threat_type"], n)


# ------------------------------------------------------------------------------------------
# per-review report tables
# ------------------------------------------------------------------------------------------

def severity_type_matrix(reviews: DataFrame, issues: DataFrame) -> DataFrame:
    """Area x (critical, high, medium) + total for every review, all three areas listed."""
    i = issues.filter(F.col("severity").isin("critical", "high", "medium")).withColumn("area", dims.area_of(F.col("category")))
    counts = i.groupBy("review_id", "area").agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(F.col("severity") == "medium").alias("medium"))
    grid = reviews.select("review_id", F.explode(F.array(*[F.lit(a) for a in dims.AREAS])).alias("area"))
    out = grid.join(counts, ["review_id", "area"], "left").fillna(0, ["critical", "high", "medium"])
    return out.withColumn("total", F.col("critical") + F.col("high") + F.col("medium"))


def risk_areas(issues: DataFrame, key: str = "review_id") -> DataFrame:
    """Per review (or project) and area: issue count and worst severity."""
    i = issues.withColumn("area", dims.area_of(F.col("category"))).withColumn("_rank", dims.severity_rank(F.col("severity")))
    return (i.groupBy(key, "area").agg(F.count(F.lit(1)).alias("issues"), F.min("_rank").alias("_r"))
            .withColumn("worst_severity", F.element_at(F.array(*[F.lit(s) for s in dims.SEVERITIES]), F.col("_r") + 1))
            .drop("_r"))


def risk_level(counts: DataFrame) -> DataFrame:
    """HIGH / MEDIUM / LOW / NONE from critical, high, medium counts."""
    return counts.withColumn("risk_level",
                             F.when(F.col("critical_count") > 0, "HIGH").when(F.col("high_count") > 0, "MEDIUM")
                             .when(F.col("medium_count") > 0, "LOW").otherwise("NONE"))


def debt_weight(severity: Column) -> Column:
    return F.coalesce(dims.lookup(dims.DEBT_HOURS, severity), F.lit(0.0))


def debt_hours(reviews: DataFrame, issues: DataFrame, key: str = "review_id") -> DataFrame:
    """Σ weight by severity per review, 1 decimal; reviews without issues give 0.0.

    Weights are summed as exact hundredths (integers) so the result does not depend on the order
    in which partial sums are combined across tasks."""
    cents = F.coalesce(dims.lookup({k: int(round(v * 100)) for k, v in dims.DEBT_HOURS.items()}, F.col("severity")), F.lit(0))
    d = issues.groupBy(key).agg(F.sum(cents).alias("_c"))
    return (reviews.select(key).join(d, key, "left")
            .withColumn("debt_hours", F.round(F.coalesce(F.col("_c"), F.lit(0)) / 100.0, 1)).drop("_c"))


def score_band(df: DataFrame, score_col: str = "score") -> DataFrame:
    s = F.col(score_col)
    return (df.withColumn("score_color", F.when(s >= 8, "brightgreen").when(s >= 6, "yellow")
                          .when(s >= 4, "orange").otherwise("red"))
            .withColumn("score_icon", F.when(s >= 8, "✅").when(s >= 6, "⚠️").otherwise("❌"))
            .withColumn("cli_icon", F.when(s >= 8, "🟢").when(s >= 5, "🟡").otherwise("🔴")))


def file_breakdown(issues: DataFrame) -> DataFrame:
    """Per review and file: issue count and per-severity counts; issues without a path form the NULL bucket."""
    i = issues.withColumn("file", F.when(truthy(F.col("file_path")), F.col("file_path")))
    return i.groupBy("review_id", "file").agg(
        F.count(F.lit(1)).alias("issues"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in dims.SEVERITIES])


def _ranked(df: DataFrame, group: list[str], order: list[Column], n: int | None) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))) if n is None else _top_per_group(df, group, order, n)


def important_issues(issues: DataFrame, n: int | None = None, key_chars: int | None = None) -> DataFrame:
    """Critical/high issues per review in issue order (the first ``n`` if given); one whose lower-cased description
    (its first ``key_chars`` characters if given) already appeared among them is flagged as repeated."""
    ch = issues.filter(F.col("severity").isin("critical", "high"))
    ranked = _ranked(ch, ["review_id"], [F.col("pos").asc()], n)
    text = F.coalesce("description", F.lit(""))
    w = Window.partitionBy("review_id", F.lower(text if key_chars is None else F.substring(text, 1, key_chars))).orderBy("pos")
    return ranked.withColumn("repeated_description", F.row_number().over(w) > 1)


def section_issues(issues: DataFrame, n_security: int | None = None, n_slop: int | None = None) -> DataFrame:
    """Security and ai_slop issues per review in issue order, all or the first of each."""
    sec = _ranked(issues.filter(F.col("category") == "security"), ["review_id"], [F.col("pos")], n_security)
    slop = _ranked(issues.filter(F.col("category") == "ai_slop"), ["review_id"], [F.col("pos")], n_slop)
    return (sec.withColumn("section", F.lit("security"))
            .unionByName(slop.withColumn("section", F.lit("ai_slop"))))


# FIXED VALUES: severity markers used in rendered issue text
SEVERITY_EMOJI = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵", "info": "ℹ️"}


def inline_comments(issues: DataFrame) -> DataFrame:
    """Issues with both a path and a (non-zero) line -> (file_path, line, body)."""
    has_line = F.col("line_number").isNotNull() & (F.col("line_number") != 0)
    emoji = dims.lookup(SEVERITY_EMOJI, F.col("severity"))
    sugg = F.when(truthy(F.col("suggestion")), F.concat(F.lit("\n\n**Suggestion:**\n> "), F.col("suggestion"))).otherwise(F.lit(""))
    body = F.concat(emoji, F.lit(" **"), F.upper("severity"), F.lit(": "), F.col("title"), F.lit("**\n\n"),
                    F.col("description"), sugg, F.lit("\n\n*Category: "), F.col("category"), F.lit("*"))
    src = issues if "suggestion" in issues.columns else issues.withColumn("suggestion", F.lit(None).cast("string"))
    return (src.filter(truthy(F.col("file_path")) & has_line)
            .select("review_id", "pos", "file_path", F.col("line_number").alias("line"), body.alias("body")))


def issue_table(issues: DataFrame) -> DataFrame:
    """Numbered listing per review: idx, SEVERITY, file or '-', line or '-', title."""
    w = Window.partitionBy("review_id").orderBy("pos")
    has_line = F.col("line_number").isNotNull() & (F.col("line_number") != 0)
    return issues.select(
        "review_id", F.row_number().over(w).alias("idx"), F.upper("severity").alias("severity"),
        F.when(truthy(F.col("file_path")), F.col("file_path")).otherwise(F.lit("-")).alias("file"),
        F.when(has_line, F.col("line_number").cast("string")).otherwise(F.lit("-")).alias("line"),
        F.col("title"))


# ------------------------------------------------------------------------------------------
# project review (file results keyed by project, in path order ``pos``)
# ------------------------------------------------------------------------------------------

def error_streak(results: DataFrame, limit: int = 5) -> DataFrame:
    """Per project: position at which consecutive errors first reach ``limit`` (NULL if never).

    Skipped files are invisible to the counter.  Islands: the running count of successes (distributed
    running sums, so a large project is many tasks) is the island id; the ``limit``-th error of an
    island is a break.  Only the first ``limit`` errors of an island are ranked.
    """
    visible = results.filter(~F.col("skipped")).select("project", "pos", "is_error")
    isl = running_sums(visible, ["project"], [F.col("pos")], {"_island": (~F.col("is_error")).cast("bigint")})
    errors = _top_per_group(isl.filter("is_error"), ["project", "_island"], [F.col("pos")], limit)
    return errors.filter(F.col("rank") == limit).groupBy("project").agg(F.min("pos").alias("break_pos"))


def kept_results(results: DataFrame, limit: int = 5, stop_at_break: bool = False) -> DataFrame:
    """Results with the project's ``break_pos``; with ``stop_at_break`` only those up to and including it."""
    out = results.join(error_streak(results, limit), "project", "left")
    return out.filter(F.col("break_pos").isNull() | (F.col("pos") <= F.col("break_pos"))) if stop_at_break else out


def project_summary(results: DataFrame, issues: DataFrame | None = None, limit: int = 5, stop_at_break: bool = False) -> DataFrame:
    """files, reviewed, skipped, errors, avg score (+ issue counts when ``issues`` is given)."""
    totals = results.groupBy("project").agg(F.count(F.lit(1)).alias("total_files"))
    kept = kept_results(results, limit, stop_at_break)
    ok = ~F.col("skipped") & ~F.col("is_error")
    s = kept.groupBy("project").agg(
        F.count_if(ok).alias("reviewed"),
        F.count_if(F.col("skipped")).alias("skipped_files"),
        F.count_if(F.col("is_error")).alias("errors"),
        F.coalesce(F.round(F.avg(F.when(ok, F.col("score"))), 1), F.lit(0.0)).alias("avg_score"),
        F.max("break_pos").alias("break_pos"))
    out = totals.join(s, "project", "left")
    if issues is not None:
        reviewed = kept.filter(ok).select("project", "file")
        ic = (issues.join(reviewed, ["project", "file"], "left_semi").groupBy("project").agg(
            F.count(F.lit(1)).alias("total_issues"),
            *[F.count_if(F.col("severity") == sv).alias(sv) for sv in ["critical", "high", "medium", "low"]]))
        out = out.join(ic, "project", "left").fillna(0, ["total_issues", "critical", "high", "medium", "low"])
    return out


def project_status(summary: DataFrame, cancelled_col: str | None = None) -> DataFrame:
    cancelled = F.col(cancelled_col) if cancelled_col else F.lit(False)
    return summary.withColumn(
        "status",
        F.when(cancelled, "cancelled").when(F.col("break_pos").isNotNull(), "failed")
        .when(F.col("errors") > F.col("reviewed"), "failed").otherwise("done"))


def provider_fallback(attempts: DataFrame) -> DataFrame:
    """First successful attempt per file in provider order, else an error row."""
    return (attempts.groupBy("file_id").agg(
        F.min_by(F.struct("attempt", "provider"), F.when(F.col("ok"), F.col("attempt"))).alias("_first"),
        F.count(F.lit(1)).alias("attempts"))
        .select("file_id",
                F.col("_first.provider").alias("provider"),
                F.coalesce(F.col("_first.attempt") + 1, F.col("attempts")).cast("int").alias("tries"),
                F.when(F.col("_first").isNull(), "error").otherwise("ok").alias("outcome")))


def file_issue_counts(kept: DataFrame, issues: DataFrame) -> DataFrame:
    """Reviewed results with their issue count."""
    ok = kept.filter(~F.col("skipped") & ~F.col("is_error"))
    n = issues.groupBy("project", "file").agg(F.count(F.lit(1)).alias("total_issues"))
    return ok.join(n, ["project", "file"], "left").fillna(0, ["total_issues"])


def worst_files(reviewed: DataFrame, n: int) -> DataFrame:
    """``n`` lowest-scored reviewed files per project (ties by path order)."""
    return _top_per_group(reviewed, ["project"], [F.col("score").asc(), F.col("pos").asc()], n)


def files_with_issues(reviewed: DataFrame) -> DataFrame:
    return reviewed.filter(F.col("total_issues") > 0)


def clean_files(reviewed: DataFrame) -> DataFrame:
    return reviewed.filter(F.col("total_issues") == 0)


def important_project_issues(issues: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Critical/high issues of reviewed files, numbered by severity rank then path order."""
    i = issues.filter(F.col("severity").isin("critical", "high")).join(
        reviewed.select("project", "file", F.col("pos").alias("file_pos")), ["project", "file"])
    order = [dims.severity_rank(F.col("severity")), F.col("file_pos"), F.col("pos")]
    return running_sums(i, ["project"], order, {"idx": F.lit(1).cast("bigint")})


# FIXED VALUES: categories counted as security-like in the project dashboard
PROJECT_SECURITY_CATEGORIES = ["security", "injection", "broken_auth", "sensitive_data", "xss", "secret_leak"]


def project_security_score(projects: DataFrame, issues: DataFrame) -> DataFrame:
    c = (issues.filter(F.lower("category").isin(*PROJECT_SECURITY_CATEGORIES))
         .groupBy("project").agg(F.count(F.lit(1)).alias("security_like")))
    return (projects.join(c, "project", "left").fillna(0, ["security_like"])
            .withColumn("security_score", F.greatest(F.lit(0), F.lit(10) - 2 * F.col("security_like")).cast("int")))


def progress(results: DataFrame, issues_per_file: DataFrame | None = None, limit: int = 5, stop_at_break: bool = False) -> DataFrame:
    """Running percent done (of all files), running average score of reviewed files and issues so
    far, in path order (with ``stop_at_break`` up to the error-streak break)."""
    ok = ~F.col("skipped") & ~F.col("is_error")
    df = results.join(results.groupBy("project").agg(F.count(F.lit(1)).alias("total")), "project")
    if stop_at_break:
        df = df.join(error_streak(results, limit), "project", "left").filter(F.col("break_pos").isNull() | (F.col("pos") <= F.col("break_pos")))
    if issues_per_file is not None:
        df = df.join(issues_per_file, ["project", "file"], "left")
    if "total_issues" not in df.columns:
        df = df.withColumn("total_issues", F.lit(0))
    df = running_sums(df, ["project"], [F.col("pos")], {
        "done": F.lit(1).cast("bigint"), "_scored": F.when(ok & F.col("score").isNotNull(), 1).cast("bigint"),
        "_scores": F.when(ok, F.col("score")).cast("bigint"), "issues_now": F.when(ok, F.col("total_issues")).cast("bigint")})
    return (df.withColumn("pct", F.round(F.col("done") * 100.0 / F.col("total"), 0).cast("int"))
            .withColumn("avg_now", F.when(F.col("_scored") > 0, F.round(F.col("_scores") / F.col("_scored"), 1)))
            .drop("_scored", "_scores"))
