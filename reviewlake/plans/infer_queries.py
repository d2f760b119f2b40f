"""infer.*: request building, provider routing and batched inference over fx_rule_requests / fx_diffs."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import diff as D
from ..operators import findings as Fd
from ..operators import infer as In
from ..operators import rules as R
from ..session import scratch_path
from .diff_queries import LINES_SQL
from .fixtures import fixture, oracle_with
from .registry import register
from .rules_queries import RESOLVE_CTES

# routing configuration of the registered query: primary provider and per-provider configured models
PRIMARY = "groq"
CONFIGURED = {"groq": "llama-3.1-8b-instant"}


def _requests(spark, sf):
    req = fixture(spark, sf, "fx_rule_requests")
    focus = req.groupBy("review_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("focus_pos", "focus"))), lambda x: x["focus"]).alias("focus"))
    diffs = fixture(spark, sf, "fx_diffs").select(F.col("doc_id").cast("string").alias("review_id"), "diff")
    files = D.changed_paths(D.diff_files(diffs.withColumnRenamed("review_id", "pr"))).withColumnRenamed("pr", "review_id")
    prs = focus.join(diffs, "review_id", "left").join(files.withColumnRenamed("paths", "files"), "review_id", "left")
    rules = R.resolve(req, fixture(spark, sf, "fx_rules"), fixture(spark, sf, "fx_repo_rules"))
    return In.build_requests(prs, rules)


REQUESTS_SQL = f"""{RESOLVE_CTES},
{LINES_SQL.strip()},
diffs AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS review_id, 'src/doc' || CAST(d.doc_id AS VARCHAR) || '.py' AS files,
         '--- a/src/doc' || CAST(d.doc_id AS VARCHAR) || '.py' || chr(10) || '+++ b/src/doc' || CAST(d.doc_id AS VARCHAR) || '.py' || chr(10)
         || '@@ -1,' || CAST(c.src_len AS VARCHAR) || ' +1,' || CAST(c.tgt_len AS VARCHAR) || ' @@' || chr(10)
         || array_to_string(list_transform(string_split(d.text, chr(10)),
                lambda x, i: CASE (i - 1) % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END || x), chr(10)) AS diff
  FROM documents d JOIN counts c ON d.doc_id = c.doc_id)"""


@register("infer.requests", oracle_with(f"""
WITH {REQUESTS_SQL}
SELECT r.review_id, 'compilation, Security, bugs, best_practices, code_quality, unknown' AS focus_areas,
       md5(coalesce(d.diff, '')) AS diff_md5, coalesce(d.files, '') AS files, md5(r.content) AS rules_md5
FROM resolved r LEFT JOIN diffs d ON r.review_id = d.review_id""", "fx_rule_requests", "fx_rules", "fx_repo_rules"))
def _requests_q(spark, sf):
    return _requests(spark, sf).select("review_id", "focus_areas", F.md5("diff").alias("diff_md5"),
                                       "files", F.md5("rules").alias("rules_md5"))


OVERRIDES = """
CASE WHEN CAST(review_id AS BIGINT) % 7 = 0 THEN 'Other' ELSE CASE CAST(review_id AS BIGINT) % 4 WHEN 0 THEN 'openai' WHEN 2 THEN 'Anthropic' WHEN 3 THEN '' END END AS provider_override,
CASE CAST(review_id AS BIGINT) % 5 WHEN 0 THEN 'custom-model' WHEN 1 THEN '' END AS model_override"""


def _routed(spark, sf):
    r = fixture(spark, sf, "fx_reviews").selectExpr("review_id", *[x.strip() for x in OVERRIDES.strip().split(",\n")])
    return In.route(r, PRIMARY, CONFIGURED)


@register("infer.route", oracle_with(f"""
SELECT *, CASE WHEN model IS NULL THEN 'Unsupported AI provider: ' || provider END AS route_error FROM (
SELECT review_id, provider,
       coalesce(nullif(model_override, ''), CASE provider WHEN 'groq' THEN 'llama-3.1-8b-instant' END,
                CASE provider {' '.join(f"WHEN '{p}' THEN '{m}'" for p, m in dims.PROVIDER_DEFAULT_MODEL.items())} END) AS model
FROM (SELECT review_id, model_override, lower(coalesce(nullif(provider_override, ''), 'groq')) AS provider
      FROM (SELECT review_id, {OVERRIDES} FROM fx_reviews) o) x) y""", "fx_reviews"))
def _route(spark, sf):
    return _routed(spark, sf).select("review_id", "provider", "model", "route_error")


def echo(batch):
    """A callable that answers with what it was asked: sizes of the diff and of the rules, and the score they give."""
    size = batch["diff"].str.len() + batch["rules"].str.len()
    return '{"summary":"diff ' + batch["diff"].str.len().astype(str) + ", rules " + batch["rules"].str.len().astype(str) + '","score":' + (size % 11).astype(str) + "}"


@register("infer.apply", oracle_with(f"""
WITH {REQUESTS_SQL},
q AS (SELECT r.review_id, length(coalesce(d.diff, '')) AS n_diff, length(r.content) AS n_rules FROM resolved r LEFT JOIN diffs d ON r.review_id = d.review_id)
SELECT review_id, md5('{{"summary":"diff ' || n_diff || ', rules ' || n_rules || '","score":' || (n_diff + n_rules) % 11 || '}}') AS response_md5,
       CAST((n_diff + n_rules) % 11 AS INT) AS score, false AS block_merge, 'ok' AS parse_status
FROM q""", "fx_rule_requests", "fx_rules", "fx_repo_rules"))
def _apply(spark, sf):
    """Built requests -> callable (once, responses stored) -> parsed reviews."""
    path = scratch_path(spark, f"infer/{uuid.uuid4().hex}")
    out = In.stored_apply(_requests(spark, sf), path, echo)
    reviews, _ = Fd.review_responses(out.select("review_id", "response", F.md5("response").alias("response_md5")), "pr")
    return reviews.select("review_id", "response_md5", "score", "block_merge", "parse_status")
