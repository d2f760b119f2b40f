"""Webhooks to tables: one parse of each micro-batch, three sinks that appear together.

The sinks are tables of ``sources.batches`` whose batch id is the stream's: a query that fails between two sinks
and is restarted from its checkpoint gets the same rows for the same id, overwrites what it had written, and
commits once.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import ingest as I
from ..sources import batches

EVENTS, QUARANTINE, COUNTS = "events", "quarantine", "counts"
QUARANTINE_SCHEMA = "event_id {id}, platform string, reason string"
COUNTS_SCHEMA = "platform string, reason string, n long"


def _schemas(raw: DataFrame) -> dict[str, str]:
    """DDL of the sinks; event ids keep the type that they arrive with."""
    ddl = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    shape = raw.sparkSession.createDataFrame([], raw.schema)
    return {EVENTS: ddl(I.unified_prs(shape)), QUARANTINE: QUARANTINE_SCHEMA.format(id=raw.schema["event_id"].dataType.simpleString()), COUNTS: COUNTS_SCHEMA}


def ingest_batch(raw: DataFrame, batch_id: int, path: str, after: Callable[[str], None] | None = None) -> None:
    """One batch of raw webhooks into the three sinks, parsed once."""
    classified = I.classify_events(raw).persist()
    try:
        counts = classified.groupBy("platform", "reason").agg(F.count(F.lit(1)).alias("n"))
        bad = classified.filter(F.col("reason").isNotNull()).select("event_id", "platform", "reason")
        batches.write_batch(raw.sparkSession, path, batch_id, {EVENTS: I.unify(classified), QUARANTINE: bad, COUNTS: counts}, after)
    finally:
        classified.unpersist()


def ingest_stream(raw: DataFrame, path: str, checkpoint: str, after: Callable[[str], None] | None = None) -> DataStreamWriter:
    """``raw`` (see ``sources.io.read_webhooks(streaming=True)``) into unified events, quarantine and counts under
    ``path``; start it with the trigger of choice."""
    batches.open_batches(raw.sparkSession, path, _schemas(raw))
    return raw.writeStream.foreachBatch(lambda df, batch_id: ingest_batch(df, batch_id, path, after)).option("checkpointLocation", checkpoint)


def read_ingested(spark: SparkSession, path: str, sink: str, raw: DataFrame) -> DataFrame:
    """What the committed batches put into a sink, with ``batch``; ``raw`` gives the schema."""
    return batches.read_batches(spark, path, sink, _schemas(raw)[sink])
