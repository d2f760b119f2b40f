"""Dashboard measures that grow by batches: a batch is reduced to partial aggregates once, later batches add theirs.

State under a folder: ``ids`` of the reviews counted so far, ``measures`` (one row per repo and batch) and ``keys``
(categories and threat types per repo and batch).  A batch reads its own reviews and issues and the ids, no old
issue; the measures are sums over the partial rows.  A review that is delivered again, late or in the same batch,
is counted once: the first delivery stays.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import batches, io
from . import analytics

IDS, MEASURES, KEYS = "ids", "measures", "keys"
_SUMS = ["total_issues", "critical_count", "security_issues_count", "ai_slop_count"]
SCHEMAS = {
    IDS: "review_id string",
    MEASURES: "repo string, reviews long, score_sum long, scores long, security_sum long, securities long, " + ", ".join(f"{c} long" for c in _SUMS) + ", blocked long, secrets long",
    KEYS: "repo string, kind string, key string, n long",
}


def first_deliveries(reviews: DataFrame, seen: DataFrame) -> DataFrame:
    """Reviews whose id is not among ``seen``, each id once (the earliest ``created_at``)."""
    w = Window.partitionBy("review_id").orderBy(F.col("created_at").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("repo", "score") if c in reviews.columns])
    once = reviews.where("review_id is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return once.join(seen.select("review_id"), "review_id", "left_anti")


def open_state(spark: SparkSession, path: str) -> None:
    batches.open_batches(spark, path, SCHEMAS)


def add_batch(spark: SparkSession, path: str, batch_id: int, reviews: DataFrame, issues: DataFrame) -> None:
    """Add a batch of reviews and their issues to the state; a batch id that is there already changes nothing."""
    new = first_deliveries(reviews, batches.read_batches(spark, path, IDS, SCHEMAS[IDS]))
    snaps = analytics.snapshot(new, issues.join(new.select("review_id"), "review_id", "left_semi"))
    snaps = snaps.persist()
    try:
        total = lambda c, name=None: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name or c)
        measures = snaps.groupBy("repo").agg(
            F.count(F.lit(1)).alias("reviews"), total("score", "score_sum"), F.count("score").alias("scores"), total("security_score", "security_sum"), F.count("security_score").alias("securities"),
            *[total(c) for c in _SUMS], F.count_if("block_merge").alias("blocked"), F.count_if("secret_leak_detected").alias("secrets"))
        keys = lambda kind: snaps.select("repo", F.lit(kind).alias("kind"), F.explode(kind).alias("key", "n"))
        counted = keys("categories").unionByName(keys("threat_types")).groupBy("repo", "kind", "key").agg(F.sum("n").alias("n"))
        batches.write_batch(spark, path, batch_id, {IDS: snaps.select("review_id"), MEASURES: measures, KEYS: counted})
    finally:
        snaps.unpersist()


#: Tables of the review store; ``dropped`` holds the reviews whose issues in a batch do not count.
_STORE = {"reviews": io.REVIEWS_SCHEMA, "issues": io.ISSUES_SCHEMA, "dropped": "review_id string"}


def open_store(spark: SparkSession, path: str) -> None:
    batches.open_batches(spark, path, _STORE)


def add_reviews(spark: SparkSession, path: str, batch_id: int, reviews: DataFrame, issues: DataFrame) -> None:
    """Reviews and their issues into a store whose key is review_id: a review that is there already, or delivered twice
    in the batch, is stored once with the issues of the batch that brought it.  Fields of the schema that are not
    given are null.  A batch id that is there already changes nothing.

    Issues are written as they come, without a shuffle of their texts; beside them go the ids of the batch's issues
    that are not of a review the batch brought, which ``stored_reviews`` leaves out."""
    if batches.is_committed(spark, path, batch_id):
        return
    shape = lambda df, ddl: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl)])
    new = first_deliveries(reviews, batches.read_batches(spark, path, "reviews", io.REVIEWS_SCHEMA)).persist()
    try:
        own = issues.where("review_id is not null")
        dropped = own.select("review_id").distinct().join(new.select("review_id"), "review_id", "left_anti")
        batches.write_batch(spark, path, batch_id, {"reviews": shape(new, io.REVIEWS_SCHEMA), "issues": shape(own, io.ISSUES_SCHEMA), "dropped": shape(dropped, _STORE["dropped"])})
    finally:
        new.unpersist()


def stored_reviews(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reviews, issues) of the store, each review once, with the issues of the batch that brought it."""
    reviews, issues, dropped = (batches.read_batches(spark, path, name, ddl) for name, ddl in _STORE.items())
    return reviews.drop("batch"), issues.join(dropped, ["batch", "review_id"], "left_anti").drop("batch")


def _measures(rows: DataFrame, keys: list[str]) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    mean = lambda s, n: F.coalesce(F.round(F.try_divide(F.sum(s), F.sum(n)), 1), F.lit(0.0))
    return rows.groupBy(*keys).agg(
        total("reviews").alias("total_reviews"), mean("score_sum", "scores").alias("avg_score"), mean("security_sum", "securities").alias("avg_security_score"), total("total_issues").alias("total_issues"),
        total("critical_count").alias("total_critical"), total("security_issues_count").alias("total_security_issues"), total("ai_slop_count").alias("total_ai_slop"),
        total("blocked").alias("blocked_merges"), total("secrets").alias("secret_leaks"))


def overview(spark: SparkSession, path: str) -> DataFrame:
    """The measures of ``analytics.overview`` from the partial aggregates (one row; zeros without a review)."""
    return _measures(batches.read_batches(spark, path, MEASURES, SCHEMAS[MEASURES]), [])


def repo_overview(spark: SparkSession, path: str) -> DataFrame:
    """The same measures per repo."""
    return _measures(batches.read_batches(spark, path, MEASURES, SCHEMAS[MEASURES]), ["repo"])


def key_counts(spark: SparkSession, path: str) -> DataFrame:
    """(repo, kind, key, n): issues by category (kind ``categories``) and threat type (``threat_types``)."""
    return batches.read_batches(spark, path, KEYS, SCHEMAS[KEYS]).groupBy("repo", "kind", "key").agg(F.sum("n").cast("long").alias("n"))
