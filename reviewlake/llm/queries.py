"""One thin query per operator: it applies the operator with production parameters to its whole table."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, feast, flow_reshard, fm_index, fst_tokens, host_rank, kneser_ney, license_scan, lsh_forest, pigeonhole, pii_lstm, shared, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL of the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = shared.stored(simhash.fingerprint_report(shared.documents(spark, sf_dir)), "simhash")
    return simhash.near_counts(report)


@_query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fst_tokens.token_count_report(shared.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(shared.documents(spark, sf_dir), shingle=3, num=85, den=100)


@_query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_report(shared.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.contamination_report(shared.documents(spark, sf_dir), shared.documents(spark, sf_dir, "benchmark"))


@_query
def op5_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_reshard.shard_report(shared.documents(spark, sf_dir))


@_query
def op8_url_host_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rank.judge_pages(shared.documents(spark, sf_dir, "pages")).drop("trust", "distrust")


@_query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(shared.documents(spark, sf_dir))


@_query
def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.language_report(shared.documents(spark, sf_dir))


@_query
def op6_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_lstm.pii_report(shared.documents(spark, sf_dir))


@_query
def op11_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pigeonhole.near_duplicates(shared.documents(spark, sf_dir))


@_query
def op12_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feast.whiten(shared.documents(spark, sf_dir, "embeddings"))


@_query
def op13_rollup_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(shared.documents(spark, sf_dir))


ORACLES["op3_minhash_near_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
link AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
         GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach(node, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT b.v, r.c FROM reach r JOIN both_ways b ON r.node = b.u),
least AS (SELECT node, min(c) AS c FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, l.c AS component_id, l.c = s.doc_id AS kept FROM s JOIN least l ON s.doc_id = l.node"""

ORACLES["op9_benchmark_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
phrase AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS p
           FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0) x),
place AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS p
          FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM phrase) k WHERE len(ws) >= n) x),
hit AS (SELECT place.doc_id, place.n, place.i, phrase.item_id FROM place JOIN phrase ON place.n = phrase.n AND place.p = phrase.p),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) x GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hit WHERE item_id IS NOT NULL) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.t, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""


def _host_sql(u: str) -> str:
    return (f"translate(regexp_extract(CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END, '^([^/?#]*)', 1), "
            "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


ORACLES["op8_url_host_rank"] = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, html, {_host_sql("coalesce(url, '')")} AS host,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
rules(verdict, rh, rp) AS (VALUES {', '.join(f"('{v}', '{h}', '{q}')" for v, h, q in host_rank.RULES)}),
fit AS (SELECT p.page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(rh || rp) DESC) AS r
        FROM p JOIN rules ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)),
j AS (SELECT p.page_id, p.host, p.path, f.rule, f.verdict FROM p LEFT JOIN fit f ON p.page_id = f.page_id AND f.r = 1),
target AS (SELECT DISTINCT page_id, host AS src, {_host_sql("CASE WHEN starts_with(u, '//') THEN 'http:' || u ELSE u END")} AS dst
           FROM (SELECT page_id, host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1)) AS u FROM p) x
           WHERE contains(u, '://') OR starts_with(u, '//')),
links AS (SELECT src, dst, count(*) * 1.0::DOUBLE AS weight FROM target WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
hosts AS (SELECT host FROM p WHERE host <> '' UNION SELECT dst FROM links),
labels AS (SELECT l, unnest(range(1, len(l) - 1)) AS k FROM (SELECT string_split(host, '.') AS l FROM hosts) x),
under AS (SELECT DISTINCT array_to_string(list_slice(l, k, len(l)), '.') AS src, array_to_string(list_slice(l, k + 1, len(l)), '.') AS dst FROM labels),
edges AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM links UNION ALL SELECT src, dst, 1.0 FROM under UNION ALL SELECT dst, src, 1.0 FROM under) x GROUP BY src, dst),
ways AS (SELECT kind, a, b, weight / sum(weight) OVER (PARTITION BY kind, a) AS part
         FROM (SELECT 't' AS kind, src AS a, dst AS b, weight FROM edges UNION ALL SELECT 'd', dst, src, weight FROM edges) x),
share AS (SELECT host, kind, avg(CASE WHEN verdict = want THEN 1.0 ELSE 0.0 END) AS s FROM j, (VALUES ('t', 'allow'), ('d', 'block')) AS k(kind, want)
          WHERE host <> '' GROUP BY host, kind),
start AS (SELECT host, kind, s / sum(s) OVER (PARTITION BY kind) AS seed FROM share WHERE s > 0),
walk(k, host, kind, score) AS (
  SELECT 0, host, kind, seed FROM start
  UNION ALL
  SELECT k + 1, host, kind, sum(score) FROM (
    SELECT w.k, e.b AS host, w.kind, w.score * e.part * {host_rank.DAMPING} AS score FROM walk w JOIN ways e ON w.host = e.a AND w.kind = e.kind
    UNION ALL
    SELECT n.k, s.host, s.kind, s.seed * (1 - {host_rank.DAMPING}) FROM start s, (SELECT DISTINCT k FROM walk) n) x
  WHERE k < {host_rank.ROUNDS} GROUP BY k, host, kind),
final AS (SELECT host, round(coalesce(sum(score) FILTER (WHERE kind = 't'), 0), 9) AS t, round(coalesce(sum(score) FILTER (WHERE kind = 'd'), 0), 9) AS d
          FROM walk WHERE k = {host_rank.ROUNDS} GROUP BY host),
even AS (SELECT {host_rank.MARGIN} / greatest(1, count(DISTINCT host)) AS e FROM p WHERE host <> '')
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.verdict, CASE WHEN coalesce(f.d, 0) > coalesce(f.t, 0) + even.e THEN 'block' ELSE 'allow' END) AS verdict
FROM j CROSS JOIN even LEFT JOIN final f ON j.host = f.host"""

ORACLES["op13_rollup_collocations"] = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, {_LOWER} AS s FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(s, '[.,;:!?\x0A-\x0D]')) AS x FROM t),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS ws FROM p),
total AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
f AS (SELECT lang, m, ph, count(*) AS f
      FROM (SELECT lang, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS ph
            FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) k(m) WHERE len(ws) >= m) x) y
      GROUP BY lang, m, ph HAVING count(*) >= {collocations.LEAST}),
c AS (SELECT lang, m, ph, f AS a, string_split(ph, ' ') AS ws FROM f WHERE m > 1),
cut AS (SELECT lang, ph, a, k, array_to_string(list_slice(ws, 1, k), ' ') AS p1, array_to_string(list_slice(ws, k + 1, m), ' ') AS p2
        FROM (SELECT *, unnest(range(1, m)) AS k FROM c) x),
scored AS (SELECT cut.lang, cut.ph, cut.a, k, x.f AS l, y.f AS r, CAST({collocations.SCORE} AS HUGEINT) * cut.a // (CAST(x.f AS HUGEINT) + y.f) AS score
           FROM cut JOIN f x ON x.lang = cut.lang AND x.ph = p1 JOIN f y ON y.lang = cut.lang AND y.ph = p2),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS o FROM scored),
inner_part AS (SELECT lang, q, max(a) AS longer
               FROM (SELECT lang, a, array_to_string(list_slice(ws, i, i + s - 1), ' ') AS q
                     FROM (SELECT lang, a, ws, s, unnest(range(1, m - s + 2)) AS i FROM c, (VALUES (2), (3)) z(s) WHERE s < m) x) y GROUP BY lang, q),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_part i ON i.lang = b.lang AND i.q = b.ph WHERE b.o = 1 AND (i.q IS NULL OR 100 * CAST(i.longer AS HUGEINT) < 80 * CAST(b.a AS HUGEINT))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(ph)) AS rank FROM kept)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, ph AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= {collocations.TOP}"""
