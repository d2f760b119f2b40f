"""runs.*: the live review-run event log (fx_run_events, fx_run_transitions)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ts_text
from ..operators import runs as Rn
from . import base
from .fixtures import fixture, oracle_with
from .registry import register

TS = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
RETAIN_N = 50
SINCE_LIMIT = 25


def _events(spark, sf):
    return fixture(spark, sf, "fx_run_events")


@register("runs.sequence", oracle_with("""
SELECT run_id, event_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS BIGINT) AS seq
FROM fx_run_events""", "fx_run_events"))
def _sequence(spark, sf):
    return Rn.sequence(_events(spark, sf).drop("seq")).select("run_id", "event_id", "seq")


RETAINED_SQL = f"""
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r FROM fx_run_events) t
         WHERE r <= {RETAIN_N})"""


@register("runs.retain", oracle_with(f"WITH {RETAINED_SQL} SELECT run_id, seq, event_id FROM kept", "fx_run_events"))
def _retain(spark, sf):
    return Rn.retain(_events(spark, sf), RETAIN_N).select("run_id", "seq", "event_id")


@register("runs.since", oracle_with(f"""
WITH {RETAINED_SQL},
cur AS (SELECT run_id, CAST(floor(max(seq) / 3) AS BIGINT) AS cursor FROM fx_run_events GROUP BY run_id),
chunk AS (SELECT * FROM (SELECT k.run_id, k.seq, k.event_id, row_number() OVER (PARTITION BY k.run_id ORDER BY k.seq) AS r
                         FROM kept k JOIN cur c ON k.run_id = c.run_id WHERE k.seq > c.cursor) t WHERE r <= {SINCE_LIMIT}),
nxt AS (SELECT run_id, max(seq) AS last FROM chunk GROUP BY run_id)
SELECT c.run_id, c.cursor, coalesce(n.last, c.cursor) AS next_cursor, ch.seq, ch.event_id
FROM cur c LEFT JOIN nxt n ON c.run_id = n.run_id LEFT JOIN chunk ch ON c.run_id = ch.run_id""", "fx_run_events"))
def _since(spark, sf):
    ev = _events(spark, sf)
    cursors = ev.groupBy("run_id").agg(F.floor(F.max("seq") / 3).cast("bigint").alias("cursor"))
    out = Rn.since(Rn.retain(ev, RETAIN_N), cursors, SINCE_LIMIT)
    return out.select("run_id", "cursor", "next_cursor", "seq", "event_id")


STATE_SQL = """
st AS (SELECT run_id, min(ts) AS started_at, max(ts) AS updated_at, count(*) AS events,
              coalesce(arg_max(transition, (ts, event_id)) FILTER (WHERE transition IS NOT NULL), 'active') AS status,
              arg_max(score, (ts, event_id)) FILTER (WHERE score IS NOT NULL) AS score,
              arg_max(issues, (ts, event_id)) FILTER (WHERE issues IS NOT NULL) AS issues,
              arg_max(critical, (ts, event_id)) FILTER (WHERE critical IS NOT NULL) AS critical,
              arg_max(error, (ts, event_id)) FILTER (WHERE error IS NOT NULL) AS error,
              arg_min(platform, (ts, event_id)) FILTER (WHERE platform IS NOT NULL) AS platform, min(pr_id) AS pr_id,
              arg_min(title, (ts, event_id)) FILTER (WHERE title IS NOT NULL) AS title, min(author) AS author,
              min(source_branch) AS source_branch, min(target_branch) AS target_branch, min(repo) AS repo
       FROM fx_run_transitions GROUP BY run_id)"""


def _state(spark, sf):
    return Rn.run_state(fixture(spark, sf, "fx_run_transitions"))


def _state_text(df):
    return df.withColumn("started_at", ts_text(F.col("started_at"))).withColumn("updated_at", ts_text(F.col("updated_at")))


@register("runs.state", oracle_with(f"""
WITH {STATE_SQL}
SELECT run_id, {TS.format(c='started_at')} AS started_at, {TS.format(c='updated_at')} AS updated_at, events, status,
       score, issues, critical, error, platform, pr_id, title, author, source_branch, target_branch, repo FROM st""", "fx_run_transitions"))
def _state_q(spark, sf):
    return _state_text(_state(spark, sf))


@register("runs.list", oracle_with(f"""
WITH {STATE_SQL}
SELECT run_id, status, {TS.format(c='updated_at')} AS updated_at,
       row_number() OVER (ORDER BY updated_at DESC, run_id) AS rank,
       CASE WHEN status = 'active' THEN row_number() OVER (PARTITION BY status = 'active' ORDER BY updated_at DESC, run_id)
       END AS active_rank
FROM st""", "fx_run_transitions"))
def _list(spark, sf):
    out = Rn.list_runs(_state(spark, sf))
    return out.select("run_id", "status", ts_text(F.col("updated_at")).alias("updated_at"), "rank", "active_rank")


@register("runs.stale", oracle_with(f"""
WITH {STATE_SQL},
now_ref AS (SELECT max(ts) AS as_of FROM fx_run_transitions)
SELECT run_id, (epoch_us(as_of) - epoch_us(updated_at)) / 1000000.0 AS idle_seconds
FROM st, now_ref WHERE status = 'active' AND (epoch_us(as_of) - epoch_us(updated_at)) / 1000000.0 > 30""",
                                      "fx_run_transitions"))
def _stale(spark, sf):
    tr = fixture(spark, sf, "fx_run_transitions")
    as_of = tr.agg(F.max("ts").alias("as_of")).withColumn("_k", F.lit(1))
    st = Rn.run_state(tr).withColumn("_k", F.lit(1)).join(F.broadcast(as_of), "_k").drop("_k")
    return Rn.stale(st, F.col("as_of"), 30).select("run_id", "idle_seconds")


@register("runs.status_counts", oracle_with(f"WITH {STATE_SQL} SELECT status, count(*) AS runs FROM st GROUP BY status",
                                            "fx_run_transitions"))
def _status_counts(spark, sf):
    return Rn.status_counts(_state(spark, sf))


CLEAN_WHERE = ("step <> 'console_banner' AND regexp_replace(coalesce(message, ''), '^\\s+|\\s+$', '', 'g') <> '' "
               "AND NOT regexp_matches(regexp_replace(coalesce(message, ''), '^\\s+|\\s+$', '', 'g'), '^[-=]{20,}$')")


@register("runs.clean", oracle_with(f"SELECT run_id, seq FROM fx_run_events WHERE {CLEAN_WHERE}", "fx_run_events"))
def _clean(spark, sf):
    return Rn.clean(_events(spark, sf)).select("run_id", "seq")


@register("runs.step_groups", oracle_with(f"""
WITH c AS (
  SELECT *, regexp_extract(step, '^step_(\\d+)', 1) AS num FROM fx_run_events WHERE {CLEAN_WHERE}),
g AS (
  SELECT *,
    CASE WHEN step = 'console_header' THEN 'header' WHEN step IN ('summary', 'error') THEN 'result'
         WHEN starts_with(step, 'step_') THEN CASE WHEN num <> '' THEN 'step_' || num ELSE step END
         ELSE 'misc-' || CAST(seq AS VARCHAR) END AS group_id,
    CASE WHEN step = 'console_header' THEN 'header' WHEN step IN ('summary', 'error') THEN 'result'
         WHEN starts_with(step, 'step_') THEN 'step' ELSE 'misc' END AS kind,
    CASE WHEN step = 'console_header' THEN 'PR Header' WHEN step IN ('summary', 'error') THEN 'Result'
         WHEN starts_with(step, 'step_') AND num <> '' THEN 'Step ' || num
         WHEN starts_with(step, 'step_') THEN step ELSE step END AS title
  FROM c)
SELECT run_id, group_id, min(kind) AS kind, arg_min(title, seq) AS title, min(seq) AS first_seq,
       {TS.format(c='arg_max(ts, seq)')} AS ts, count(*) AS events,
       CASE WHEN min(kind) = 'header' THEN 'neutral'
            WHEN bool_or(level = 'error' OR contains(message, '❌')) THEN 'error'
            WHEN bool_or(contains(message, '✅')) THEN 'success' ELSE 'running' END AS status
FROM g GROUP BY run_id, group_id""", "fx_run_events"))
def _step_groups(spark, sf):
    return Rn.step_groups(_events(spark, sf)).withColumn("ts", ts_text(F.col("ts")))


@register("runs.fresh", oracle_with("SELECT run_id, seq, event_id FROM fx_run_events", "fx_run_events"))
def _fresh(spark, sf):
    ev = _events(spark, sf)
    late = ev.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND")).withColumn("event_id", -F.col("event_id") - 1)
    redelivered = ev.unionByName(late)  # every event delivered twice, later under another id
    return Rn.fresh(redelivered).select("run_id", "seq", "event_id")


@register("runs.evolve_trigger", base.oracle_st("""
WITH c AS (SELECT repo, review_id, CAST(row_number() OVER (PARTITION BY repo ORDER BY created_at, review_id) AS BIGINT) AS count
           FROM st_reviews),
j AS (SELECT c.*, r.filename IS NOT NULL AS had FROM c LEFT JOIN fx_repo_rules r ON r.filename = replace(c.repo, '/', '_') || '.md')
SELECT repo, review_id, count FROM j
WHERE CASE WHEN had THEN count % 10 = 0 ELSE count = 3 OR (count > 3 AND count % 10 = 0) END""", "fx_repo_rules"))
def _evolve_trigger(spark, sf):
    return Rn.evolve_triggers(base.st_reviews(spark, sf), fixture(spark, sf, "fx_repo_rules"))
