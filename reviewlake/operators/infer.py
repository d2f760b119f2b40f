"""Model requests, provider routing and batched inference.

``apply`` is the only Python-worker operator of the batch library: a user callable runs over Arrow
batches inside ``mapInPandas`` (one client per task, batch size bounded by
``spark.sql.execution.arrow.maxRecordsPerBatch``).  Without a callable it returns the fixed offline
response, which parses as a valid review.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import nullif_empty

REQUEST_DEFAULT_FOCUS = ["compilation", "security", "bugs", "performance", "best_practices"]


def build_requests(prs: DataFrame, rules: DataFrame, key: str = "review_id", diff_chars: int | None = None,
                   rules_chars: int | None = None) -> DataFrame:
    """prs(key, focus ARRAY, diff, files ARRAY) x resolved rules(key, content) -> request rows, whole or cut."""
    cut = lambda c, n: c if n is None else F.substring(c, 1, n)
    r = rules.select(key, cut(F.col("content"), rules_chars).alias("rules"))
    return (prs.join(r, key, "left")
            .select(key, F.array_join("focus", ", ").alias("focus_areas"),
                    cut(F.coalesce("diff", F.lit("")), diff_chars).alias("diff"),
                    F.array_join(F.coalesce("files", F.array().cast("array<string>")), "\n").alias("files"),
                    F.coalesce("rules", F.lit("")).alias("rules")))


def route(requests: DataFrame, primary: str, configured_models: dict[str, str],
          provider_col: str = "provider_override", model_col: str = "model_override") -> DataFrame:
    """provider = lower(override or primary); model = override or configured model or provider default.

    An empty override is none.  A provider without a model is not supported: ``route_error`` says so."""
    prov = F.lower(F.coalesce(nullif_empty(F.col(provider_col)), F.lit(primary)))
    model = F.coalesce(nullif_empty(F.col(model_col)), dims.lookup(configured_models, prov) if configured_models else F.lit(None),
                       dims.lookup(dims.PROVIDER_DEFAULT_MODEL, prov))
    return (requests.withColumn("provider", prov).withColumn("model", model)
            .withColumn("route_error", F.when(model.isNull(), F.concat(F.lit("Unsupported AI provider: "), prov))))


ResponseFn = Callable[[pd.DataFrame], pd.Series]


def offline_response(batch: pd.DataFrame) -> pd.Series:
    return pd.Series([dims.OFFLINE_RESPONSE] * len(batch), index=batch.index)


def apply(requests: DataFrame, fn: ResponseFn | None = None, key: str = "review_id") -> DataFrame:
    """Run ``fn`` (pandas batch of whole requests -> response text series) over request batches.

    The result is lazy: store it (``stored_apply``) before it is read more than once."""
    call = fn or offline_response

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame({key: b[key]})
            out["provider"] = b["provider"] if "provider" in b else "mock"
            out["model"] = b["model"] if "model" in b else dims.PROVIDER_DEFAULT_MODEL["mock"]
            out["response"] = call(b).astype(str).values
            yield out

    schema = f"{key} string, provider string, model string, response string"
    return requests.mapInPandas(run, schema)


def stored_apply(requests: DataFrame, path: str, fn: ResponseFn | None = None, key: str = "review_id") -> DataFrame:
    """``apply`` run once, its responses kept under ``path``: every later pass reads them from there."""
    out = apply(requests, fn, key)
    out.write.mode("overwrite").parquet(path)
    return requests.sparkSession.read.schema(out.schema).parquet(path)


def prompt_size(requests: DataFrame) -> Column:
    return F.length("diff") + F.length("rules") + F.length("files")
