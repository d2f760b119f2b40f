"""Review-run event log (batch form; ``reviewlake.streaming`` runs the same logic on a stream).

Arrival sequences and counts are distributed running sums, so a run or repo that holds a third of all
rows is many tasks; per-run limits are written as ``row_number() <= n`` so that Spark prunes each map
task before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_rank, running_sums
from ..functions.text import py_strip

ARRIVAL = ["ts", "event_id"]
RUN_FIELDS = ["platform", "pr_id", "title", "author", "source_branch", "target_branch", "repo"]


def sequence(events: DataFrame) -> DataFrame:
    """1-based sequence per run in arrival order ``(ts, event_id)``."""
    return running_sums(events, ["run_id"], [F.col(c) for c in ARRIVAL], {"seq": F.lit(1).cast("bigint")})


def retain(events: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` (>= 1) events per run; sequence numbers are kept as they are."""
    n = max(1, int(n))
    w = Window.partitionBy("run_id").orderBy(F.col("seq").desc())
    return events.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def clamp_limit(limit: int) -> int:
    return max(1, min(int(limit), 1000))


def since(events: DataFrame, cursors: DataFrame, limit: int = 200) -> DataFrame:
    """Oldest ``limit`` events with seq > cursor per run, and the next cursor (= cursor when none).

    Returns one row per (run, returned event) plus runs with an empty chunk (seq NULL)."""
    lim = clamp_limit(limit)
    after = events.join(cursors, "run_id").filter(F.col("seq") > F.col("cursor"))
    w = Window.partitionBy("run_id").orderBy("seq")
    chunk = after.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= lim).drop("_r")
    nxt = chunk.groupBy("run_id").agg(F.max("seq").alias("_last"))
    cur = cursors.join(nxt, "run_id", "left").withColumn("next_cursor", F.coalesce("_last", "cursor")).drop("_last")
    return cur.join(chunk.drop("cursor"), "run_id", "left")


def run_state(events: DataFrame) -> DataFrame:
    """Latest state per run, with the descriptive fields (``RUN_FIELDS``) that the events carry: the first non-NULL
    value of each.  Each event moves ``updated_at``; a completion sets status, score, issues
    and critical; a failure sets status and error.  No transition guard: the last transition wins and
    each field keeps its last non-NULL value."""
    order = F.struct("ts", "event_id")
    trans = F.col("transition").isNotNull()
    described = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in RUN_FIELDS if c in events.columns]
    return events.groupBy("run_id").agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("updated_at"),
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.max_by("transition", F.when(trans, order)), F.lit("active")).alias("status"),
        F.max_by("score", F.when(F.col("score").isNotNull(), order)).alias("score"),
        F.max_by("issues", F.when(F.col("issues").isNotNull(), order)).alias("issues"),
        F.max_by("critical", F.when(F.col("critical").isNotNull(), order)).alias("critical"),
        F.max_by("error", F.when(F.col("error").isNotNull(), order)).alias("error"), *described)


def list_runs(state: DataFrame) -> DataFrame:
    """All runs ranked by newest activity, and the rank among active runs (distributed ranks)."""
    order = [F.col("updated_at").desc(), F.col("run_id").asc()]
    active = global_rank(state.filter(F.col("status") == "active").select("run_id", "updated_at"), order, "active_rank")
    return global_rank(state, order, "rank").join(active.select("run_id", "active_rank"), "run_id", "left")


def stale(state: DataFrame, as_of: Column, seconds: int = 30) -> DataFrame:
    """Active runs without progress for more than ``seconds`` as of ``as_of`` (an argument, never now())."""
    idle = F.unix_micros(F.to_timestamp(as_of)) - F.unix_micros(F.to_timestamp(F.col("updated_at")))
    return (state.filter(F.col("status") == "active")
            .withColumn("idle_seconds", (idle / 1_000_000).cast("double"))
            .filter(F.col("idle_seconds") > seconds))


def status_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


SEPARATOR_RE = r"^[-=]{20,}$"


def clean(events: DataFrame) -> DataFrame:
    """Drop console banners, blank messages and separator lines."""
    msg = py_strip(F.coalesce(F.col("message"), F.lit("")))
    return events.filter((F.col("step") != "console_banner") & (msg != "") & ~msg.rlike(SEPARATOR_RE))


def step_group_key(step: Column, seq: Column) -> tuple[Column, Column, Column]:
    """(group id, kind, title) of an event."""
    num = F.regexp_extract(step, r"^step_(\d+)", 1)
    norm = F.when(num != "", F.concat(F.lit("step_"), num)).otherwise(step)
    gid = (F.when(step == "console_header", "header")
           .when(step.isin("summary", "error"), "result")
           .when(step.startswith("step_"), norm)
           .otherwise(F.concat(F.lit("misc-"), seq.cast("string"))))
    kind = (F.when(step == "console_header", "header").when(step.isin("summary", "error"), "result")
            .when(step.startswith("step_"), "step").otherwise("misc"))
    title = (F.when(step == "console_header", "PR Header").when(step.isin("summary", "error"), "Result")
             .when(step.startswith("step_") & norm.rlike(r"^step_\d+$"), F.concat(F.lit("Step "), F.regexp_extract(norm, r"^step_(\d+)$", 1)))
             .when(step.startswith("step_"), norm)
             .otherwise(step))
    return gid, kind, title


def step_groups(events: DataFrame) -> DataFrame:
    """Cleaned events grouped per run: order of first appearance, last event time, status.

    Status is order-independent: error if any event is an error (level or a cross mark), else success
    if any has a check mark, else running; header groups are neutral."""
    ev = clean(events)
    gid, kind, title = step_group_key(F.col("step"), F.col("seq"))
    ev = ev.withColumn("group_id", gid).withColumn("kind", kind).withColumn("title", title)
    err = (F.col("level") == "error") | F.col("message").contains("❌")
    ok = F.col("message").contains("✅")
    g = ev.groupBy("run_id", "group_id").agg(
        F.first("kind").alias("kind"), F.min_by("title", "seq").alias("title"),
        F.min("seq").alias("first_seq"), F.max_by("ts", "seq").alias("ts"), F.count(F.lit(1)).alias("events"),
        F.max(err).alias("_err"), F.max(ok).alias("_ok"))
    status = (F.when(F.col("kind") == "header", "neutral").when(F.col("_err"), "error")
              .when(F.col("_ok"), "success").otherwise("running"))
    return g.withColumn("status", status).drop("_err", "_ok")


def fresh(events: DataFrame) -> DataFrame:
    """One event of each run and sequence number: the first that arrived, by (ts, event_id)."""
    first = F.min_by(F.struct(*events.columns), F.struct(*ARRIVAL))
    return events.groupBy("run_id", "seq").agg(first.alias("_e")).select("_e.*")


def evolve_triggers(reviews: DataFrame, repo_rules: DataFrame, trigger_every: int = 10, first_at: int = 3) -> DataFrame:
    """Reviews at which a repo's rule evolution fires, in arrival order.

    Without a rule the trigger is the ``first_at``-th review (which creates the rule); with a rule it
    is every ``trigger_every``-th review."""
    from .feedback import rule_key

    counted = running_sums(reviews.select("repo", "review_id", "created_at"), ["repo"], [F.col("created_at"), F.col("review_id")],
                           {"count": F.lit(1).cast("bigint")})
    rr = repo_rules.select(F.col("filename").alias("_f"))
    j = counted.join(rr, F.concat(rule_key(F.col("repo")), F.lit(".md")) == F.col("_f"), "left")
    had = F.col("_f").isNotNull()
    fire = (F.when(had, F.col("count") % trigger_every == 0)
            .otherwise((F.col("count") == first_at) | ((F.col("count") > first_at) & (F.col("count") % trigger_every == 0))))
    return j.filter(fire).select("repo", "review_id", "count")
