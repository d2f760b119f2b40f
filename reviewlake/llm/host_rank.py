"""Operator 8: URL verdicts by rules and by trust propagated over the host graph.

DataFrame functions only.  Pages with a rule make their hosts seeds: trust starts at hosts by the share
of their pages that rules allow, distrust by the share that rules block.  Personalised PageRank carries
trust along host edges and distrust against them; a host is blocked where its distrust exceeds its
trust by more than a host's even share.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: (verdict, host, path) of the standard rules (fixed values).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING, ROUNDS, CHECKPOINT_EVERY, MARGIN = 0.85, 12, 4, 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Text after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to `?`, `#` or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits (of equal lengths: the first by name), or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): absolute links of pages between hosts, counted once a page, and one edge each
    way between a host and the domain that it is directly under (two labels at least).
    """
    own = host_of(F.col(url_col)).alias("src")
    # counted per (page's distinct targets) before any shuffle
    targets = F.array_distinct(F.transform(
        F.filter(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_HREF), F.lit(1)),
                 lambda u: F.contains(u, F.lit("://")) | F.startswith(u, F.lit("//"))),
        lambda u: host_of(F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("http:"), u)).otherwise(u))))
    links = (pages.select(own, F.explode(targets).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
             .groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    hosts = pages.select(own).distinct().union(links.select(F.col("dst").alias("src"))).where("src <> ''").distinct()
    # every domain above a host, down to two labels
    labels = F.split("src", r"\.")
    chain = hosts.select(F.explode(F.sequence(F.lit(1), F.size(labels) - 1)).alias("k"), labels.alias("l")).where(F.size("l") - F.col("k") >= 2)
    join = lambda skip: F.array_join(F.slice("l", F.col("k") + skip, F.size("l")), ".")
    under = chain.select(join(0).alias("src"), join(1).alias("dst")).distinct()
    both = under.union(under.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return links.union(both.withColumn("weight", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) after `rounds` rounds of personalised PageRank.

    `seeds`: (host, trust, distrust), any non-negative weights.  Mass of hosts without a way out is not
    passed on; scores are shares of the seeds' mass.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    total = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    share = lambda c, whole: (F.col(c) / F.lit(whole) if whole else F.lit(0.0)).cast("double")
    start = seeds.select("host", F.explode(F.array(
        F.struct(F.lit("t").alias("kind"), share("trust", total["t"]).alias("seed")),
        F.struct(F.lit("d").alias("kind"), share("distrust", total["d"]).alias("seed")))).alias("x")).select("host", "x.*").where("seed > 0")
    start = start.checkpoint()
    ways = (edges.select(F.col("src").alias("host"), F.lit("t").alias("kind"), F.col("dst").alias("to"), "weight")
            .union(edges.select(F.col("dst").alias("host"), F.lit("d").alias("kind"), F.col("src").alias("to"), "weight")))
    out = ways.groupBy("host", "kind").agg(F.sum("weight").alias("all"))
    ways = ways.join(out, ["host", "kind"]).select("host", "kind", "to", (F.col("weight") / F.col("all")).alias("part")).checkpoint()
    scores = start.withColumnRenamed("seed", "score")
    for k in range(1, rounds + 1):
        passed = scores.join(ways, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("score") * F.col("part") * damping).alias("score"))
        scores = (passed.union(start.select("host", "kind", (F.col("seed") * (1 - damping)).alias("score")))
                  .groupBy("host", "kind").agg(F.sum("score").alias("score")))
        if k % CHECKPOINT_EVERY == 0:
            scores = scores.checkpoint()
    of = lambda kind: F.round(F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)), 9)
    return scores.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust"))


def judge_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row.

    A rule fits its host and all hosts under it where the path starts with the rule's; the longest wins
    and gives the verdict.  Without a rule the host's scores do: block where distrust > trust + margin /
    number of hosts, else allow (also for an empty host).

    A null url or one without `://` has empty host and path; null html has no links; repeated rows are
    returned each; an empty table gives no rows; other columns are not read.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumn("rule", rule).withColumn("ruled", verdict)
    part = lambda what: F.avg(F.when(F.col("ruled") == what, 1.0).otherwise(0.0))
    seeds = judged.where("host <> ''").groupBy("host").agg(part("allow").alias("trust"), part("block").alias("distrust")).checkpoint()
    scores = propagate(host_edges(pages, url_col, html_col), seeds)
    even = margin / max(1, seeds.count())
    scored = judged.join(scores, "host", "left")
    by_host = F.when(F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)) + even, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"),
                         F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
