"""Small Spark helpers of the llm operators."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once under the shared checkpoint folder and read it back.

    Cuts lineage: a lost executor costs the reading stage only, and later passes over the table do
    not compute it again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def gathered(df: DataFrame) -> DataFrame:
    """A table that is small beside the shuffle it comes from, dealt to a 16th of the partitions (but one for each core).

    Stored, it has so many files fewer.  Hadoop starts `chmod` processes for each file of a local folder, and until such a
    process runs its own program it counts with all the memory of the executor that started it.
    """
    width = shuffle_width(df.sparkSession)
    return df.repartition(min(width, max(df.sparkSession.sparkContext.defaultParallelism, width // 16)))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def utf8_size(col: str = "text"):
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("long")
