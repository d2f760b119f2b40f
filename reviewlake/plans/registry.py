"""Query registry: operator id -> (Spark builder, DuckDB oracle text or None)."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    op_id: str
    build: Builder
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def key_of(op_id: str) -> str:
    return op_id.replace(".", "_")


def register(op_id: str, oracle: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``op_id``."""

    def deco(fn: Builder) -> Builder:
        k = key_of(op_id)
        if k in REGISTRY:
            raise ValueError(f"duplicate operator id {op_id}")
        REGISTRY[k] = Entry(op_id, fn, oracle)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    # importing the modules fills REGISTRY
    from . import (analytics_queries, corpus_queries, diff_queries, feedback_queries,  # noqa: F401
                   findings_queries, incremental_queries, infer_queries, ingest_queries, io_queries, rules_queries,
                   runs_queries, scan_queries)

    return REGISTRY
