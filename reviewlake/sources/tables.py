"""Driver tables (Parquet).  Column pruning and filter pushdown are left to Catalyst: callers
select only what they use and the scan's ``ReadSchema`` shrinks accordingly."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
