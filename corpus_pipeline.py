"""From raw documents to token ids: language ID, near-dedup, decontamination, PII and byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame over all that its predecessor kept; all
but the last return the columns of `docs`.  `run` writes each stage to the shared checkpoint folder and
reads it back, so that a lost executor costs one stage at most.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import bpe, fm_index, kneser_ney, lsh_forest, pii_lstm, shared

#: Near-duplicates: shingles of so many words, and the least similarity in hundredths.
SHINGLE, SIMILAR = 5, 80


def _columns(docs: DataFrame, leave: tuple[str, ...] = ()):
    return [F.col(f"`{c}`") for c in docs.columns if c not in leave]


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of changed texts, where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that no learned language explains.

    Null languages are filled with the predicted one.  Without any labelled text nothing can be learned,
    and all documents stay.
    """
    models = kneser_ney.fit(docs)
    if models is None:
        return docs
    rows = docs.select(F.struct(*_columns(docs, ("text",))).alias("row"), "text")
    kept = kneser_ney.identify(rows, models).where(~F.col("rejected"))
    out = {c: F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns}
    out["lang"] = F.coalesce(out["lang"], "lang_pred")
    return kept.select(*[c.alias(name) for name, c in out.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each near-duplicate group.

    Rows are compared each for itself: of rows that share an id, those with different texts stay or go by
    their own group (in a group, ties of the id go to the smallest text), and of rows that repeat id and text one stays.
    Documents without an id or without words stay, though of repeated rows with an id one.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1").isEmpty():
        found = lsh_forest.near_duplicates(docs, shingle=SHINGLE, num=SIMILAR, den=100)
        gone = found.where(~F.col("kept")).select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*_columns(docs))
    key = shared.free_name(docs, "row_key")
    rows = shared.stored(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-rows")
    named = rows.where("doc_id is not null")
    found = lsh_forest.near_duplicates(named, id_col=key, shingle=SHINGLE, num=SIMILAR, den=100)
    groups = found.select(F.col(key).alias("k"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("c"))
    placed = named.select(F.col(key).alias("own"), F.col("doc_id").alias("i"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("t")).join(groups, F.col("own") == F.col("k"))
    # rows without words have no group: they are told apart by id and text
    group = F.when(F.col("c").isNull(), F.struct(F.lit(None).cast("long").alias("c"), "i", "t")).otherwise(F.struct("c", F.lit(None).cast("long").alias("i"), F.lit(None).cast("string").alias("t")))
    stay = placed.groupBy(group.alias("g")).agg(F.min(F.struct("i", "t", "own")).alias("m")).select(F.col("m.own").alias("stay"))
    kept = named.join(stay, F.col(key) == F.col("stay"), "left_semi")
    return kept.unionByName(rows.where("doc_id is null")).select(*_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts; documents that were nothing else go."""
    return _measured(fm_index.decontaminate(docs, shared.documents(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind."""
    return _measured(pii_lstm.redact(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens and token_ids of each document."""
    keep = [c for c in ("doc_id", "lang", "source", "n_chars") if c in docs.columns]
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", personal_data), ("byte_bpe", byte_bpe)]

#: SQL expresses none of the stages; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
