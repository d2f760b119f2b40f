"""Structured Streaming forms of the run-log and review operators.

The batch operators in ``reviewlake.operators`` are the oracles of these streams (tests check
stream == batch with ``Trigger.AvailableNow``).  Rows of a key are put in one total order per
micro-batch before any is numbered.  State is one counter or a bounded list per key and expires when the
key has been silent for ``idle``; de-duplication is bounded by an event-time watermark.  Checkpoints go
under the session's ``spark.checkpoint.dir``.

A key's rows of one micro-batch are one group: bound them by the source (``maxFilesPerTrigger``,
``maxOffsetsPerTrigger``).  The batch forms have no such bound.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import runs as Rn

SEQ_OUT = "run_id string, event_id long, ts timestamp_ntz, seq long"
COUNT_STATE = "n long"
IDLE_MS = 24 * 3600 * 1000


def _timeout(idle_ms: int | None) -> str:
    """Expiry by processing time; None for runs that end (``availableNow`` would wait for the timeouts)."""
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _ordered(pdfs: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """All rows of a key in this micro-batch, however many Arrow chunks they came in, in total order."""
    parts = [p for p in pdfs if len(p)]
    return pd.concat(parts).sort_values(by, kind="stable") if parts else pd.DataFrame()


def _sequence_fn(idle_ms: int | None):
    def fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if idle_ms is not None and state.hasTimedOut:
            state.remove()
            return
        (n,) = state.get if state.exists else (0,)
        pdf = _ordered(pdfs, ["ts", "event_id"])
        if len(pdf):
            yield pd.DataFrame({"run_id": pdf["run_id"].values, "event_id": pdf["event_id"].values,
                                "ts": pdf["ts"].values, "seq": list(range(n + 1, n + 1 + len(pdf)))})
        state.update((n + len(pdf),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
    return fn


def stream_sequence(events: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """1-based arrival sequence per run, continued across micro-batches (one counter of state per run, dropped
    when the run has been silent for ``idle_ms``).  Within a micro-batch arrival order is ``(ts, event_id)``."""
    return (events.select("run_id", "event_id", "ts").groupBy("run_id")
            .applyInPandasWithState(_sequence_fn(idle_ms), SEQ_OUT, COUNT_STATE, "append", _timeout(idle_ms)))


def stream_fresh(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop redelivered (run_id, seq) events; state is dropped once the watermark passes."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "seq"])


RETAIN_OUT = "run_id string, newest array<long>"
RETAIN_STATE = "seqs array<long>"


def _retain_fn(n: int, idle_ms: int | None):
    def fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if idle_ms is not None and state.hasTimedOut:
            state.remove()
            return
        (kept,) = state.get if state.exists else ([],)
        seqs = set(kept)
        for pdf in pdfs:
            seqs = set(sorted(seqs | set(pdf["seq"].tolist()))[-n:])
        newest = sorted(seqs)
        state.update((newest,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"run_id": [key[0]], "newest": [newest]})
    return fn


def stream_retain(events: DataFrame, n: int, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Sequence numbers of the newest ``n`` events per run, once per run and micro-batch (update mode); the state is
    at most ``n`` numbers per run."""
    return (events.select("run_id", "seq").groupBy("run_id")
            .applyInPandasWithState(_retain_fn(max(1, int(n)), idle_ms), RETAIN_OUT, RETAIN_STATE, "update", _timeout(idle_ms)))


def stream_run_state(transitions: DataFrame) -> DataFrame:
    """Latest state per run as an update-mode streaming aggregation."""
    return Rn.run_state(transitions)


TRIGGER_OUT = "repo string, review_id string, count long"


def _trigger_fn(every: int, first_at: int):
    def fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        pdf = _ordered(pdfs, ["created_at", "review_id"])
        rows = []
        for rid, had in zip(pdf.get("review_id", []), pdf.get("had_rule", [])):
            n += 1
            if (n % every == 0) if had else (n == first_at or (n > first_at and n % every == 0)):
                rows.append((key[0], rid, n))
        state.update((n,))
        yield pd.DataFrame(rows, columns=["repo", "review_id", "count"])
    return fn


def stream_evolve_triggers(reviews: DataFrame, repo_rules: DataFrame, every: int = 10, first_at: int = 3) -> DataFrame:
    """Emit (repo, review, count) when a repo's review count crosses the evolution trigger.  The
    existing-rule flag comes from a stream-static join with the rule documents.  A repo's count never
    expires: a trigger counts all of its reviews."""
    from ..operators.feedback import rule_key

    rr = repo_rules.select(F.col("filename").alias("_f"))
    flagged = (reviews.join(rr, F.concat(rule_key(F.col("repo")), F.lit(".md")) == F.col("_f"), "left")
               .withColumn("had_rule", F.col("_f").isNotNull()).select("repo", "review_id", "created_at", "had_rule"))
    return flagged.groupBy("repo").applyInPandasWithState(
        _trigger_fn(every, first_at), TRIGGER_OUT, COUNT_STATE, "append", GroupStateTimeout.NoTimeout)


def latest_updates(updates: DataFrame, key: str, version: str) -> DataFrame:
    """Last row of each key among the rows that an update-mode stream has written."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    return updates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def write_reviews_stream(reviews: DataFrame, issues_of, path: str, checkpoint: str):
    """``foreachBatch`` sink: each micro-batch overwrites its own ``batch=<id>`` folder, so a replayed
    batch (after a failure) rewrites the same files: idempotent.  ``read_reviews(spark, path + "/batch=*")``
    reads all of them."""
    from ..sources.io import write_reviews

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_reviews(batch, issues_of(batch), f"{path}/batch={batch_id}", mode="overwrite")

    return reviews.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
