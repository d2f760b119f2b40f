"""Tables that grow by batches and appear together or not at all.

Each batch writes a folder ``<table>/batch=<id>`` for every table and, last, its commit.  Readers see committed
batches only.  A batch that is run again, after a failure between two tables or a lost commit, overwrites its own
folders; one that is committed is left as it is.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMITS = "commits"
#: The batch that holds no rows and gives every table its schema.
_FIRST = -1


def open_batches(spark: SparkSession, path: str, schemas: dict[str, str]) -> None:
    """Make the tables of the given schemas under ``path``, without rows; those already there stay."""
    for name, schema in {**schemas, _COMMITS: "committed boolean"}.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}/batch={_FIRST}")


def batch_ids(spark: SparkSession, path: str) -> DataFrame:
    """(batch) of the committed batches."""
    return spark.read.schema("committed boolean, batch long").parquet(f"{path}/{_COMMITS}").where("committed").select("batch").distinct()


def is_committed(spark: SparkSession, path: str, batch_id: int) -> bool:
    return not batch_ids(spark, path).where(F.col("batch") == batch_id).isEmpty()


def write_batch(spark: SparkSession, path: str, batch_id: int, tables: dict[str, DataFrame], after: Callable[[str], None] | None = None) -> None:
    """Write one batch of all tables and commit it; nothing for a committed one.  ``after`` is called with the name of
    each table written."""
    if is_committed(spark, path, batch_id):
        return
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}/batch={batch_id}")
        if after is not None:
            after(name)
    spark.createDataFrame([(True,)], "committed boolean").write.mode("overwrite").parquet(f"{path}/{_COMMITS}/batch={batch_id}")


def read_batches(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The rows of a table's committed batches, with ``batch``."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/{name}")
    return rows.join(batch_ids(spark, path), "batch", "left_semi")
