import re

import duckdb

from reviewlake.llm import host_rank as hr
from reviewlake.llm.queries import QUERIES

from .helpers import SF

_SCHEMA = "page_id long, url string, html string, host string, trust double, weight int"


def _host(url):
    if url is None or "://" not in url:
        return ""
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].translate({i: i + 32 for i in range(65, 91)})


def _path(url):
    if url is None or "://" not in url:
        return ""
    rest = url.split("://", 1)[1]
    return re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]):])[0]


def _rule(host, path):
    found = [(h + p, v) for v, h, p in hr.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(found, key=lambda r: len(r[0])) if found else (None, None)


def brute_force(pages, rounds=hr.ROUNDS, damping=hr.DAMPING, margin=hr.MARGIN):
    """(host, path, rule, verdict) of each (url, html), by loops."""
    parsed = [(_host(u), _path(u)) for u, _ in pages]
    rules = [_rule(h, p) for h, p in parsed]
    edges = {}
    for (host, _), (_, html) in zip(parsed, pages):
        targets = {_host(u if "://" in u else "http:" + u) for u in re.findall(hr._HREF, html or "") if "://" in u or u.startswith("//")}
        for t in targets:
            if host and t and t != host:
                edges[host, t] = edges.get((host, t), 0) + 1
    hosts = {h for h, _ in parsed if h} | {t for _, t in edges}
    under = set()
    for h in hosts:
        labels = h.split(".")
        under |= {(".".join(labels[k:]), ".".join(labels[k + 1:])) for k in range(len(labels) - 2)}
    for a, b in under:
        edges[a, b] = edges.get((a, b), 0) + 1
        edges[b, a] = edges.get((b, a), 0) + 1
    own = {h for h, _ in parsed if h}
    score = {}
    for kind, what in (("t", "allow"), ("d", "block")):
        seed = {h: sum(r[1] == what for (x, _), r in zip(parsed, rules) if x == h) / sum(x == h for x, _ in parsed) for h in own}
        whole = sum(seed.values())
        seed = {h: s / whole if whole else 0.0 for h, s in seed.items()}
        ways = edges if kind == "t" else {(b, a): w for (a, b), w in edges.items()}
        out = {}
        for (a, _), w in ways.items():
            out[a] = out.get(a, 0) + w
        now = dict(seed)
        for _ in range(rounds):
            new = {h: (1 - damping) * s for h, s in seed.items()}
            for (a, b), w in ways.items():
                new[b] = new.get(b, 0) + damping * now.get(a, 0) * w / out[a]
            now = new
        score[kind] = now
    result = []
    for (h, p), (rule, verdict) in zip(parsed, rules):
        by_host = "block" if h and round(score["d"].get(h, 0), 9) > round(score["t"].get(h, 0), 9) + margin / max(1, len(own)) else "allow"
        result.append((h, p, rule, verdict or by_host))
    return result


def test_query_against_brute_force(spark):
    pages = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = {r.page_id: r for r in QUERIES["op8_url_host_rank"](spark, SF).collect()}
    want = dict(zip(pages, brute_force(list(pages.values()))))
    assert {i: (r.host, r.path, r.rule, r.verdict) for i, r in rows.items()} == want


def test_ruled_columns_against_sql(spark):
    sql = f"""
        WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM read_parquet('{SF}/pages.parquet')),
        q AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
        SELECT page_id, host, path FROM q"""
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    assert {r.page_id: (r.host, r.path) for r in QUERIES["op8_url_host_rank"](spark, SF).collect()} == want


def test_trust_and_distrust_travel_over_links(spark):
    link = lambda *hosts: "".join(f'<p><a class="x" HREF="https://{h}/z?q">t</a>' for h in hosts)
    pages = [
        (1, "https://good.org/fr/1", link("friend.biz")), (2, "https://friend.biz/x", link("other.biz")), (3, "https://other.biz", ""),
        (4, "https://bad.net/1", link("good.org")), (5, "https://spam.biz/a", link("bad.net") + "<a href='//bad.net/2'>"), (6, "https://feeder.biz/a", link("spam.biz")),
        (7, "HTTP://Upper.BIZ?x#y", None),
    ]
    rows = {r.page_id: r for r in hr.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), margin=0.5).collect()}
    want = brute_force([(u, h) for _, u, h in pages], margin=0.5)
    assert [(rows[k + 1].host, rows[k + 1].path, rows[k + 1].rule, rows[k + 1].verdict) for k in range(7)] == want
    assert rows[5].verdict == "block" and rows[2].verdict == "allow" and rows[2].trust > rows[2].distrust and rows[7].host == "upper.biz"


def test_edges(spark):
    pages = [(1, None, None), (2, "", ""), (3, "no scheme", "<a href=x>"), (None, "http://a.example.net/en/x", None), (4, "http://a.example.net/en/x", "x" * 100_000),
             (4, "http://a.example.net/en/x", "x" * 100_000), (5, "https://NET/", ""), (6, "ftp://x.org/fr", ""), (7, "a://b://c/d", "")]
    df = spark.createDataFrame([(*p, "h", None, 1) for p in pages], _SCHEMA)
    rows = hr.judge_pages(df).collect()
    want = brute_force([(u, h) for _, u, h in pages])
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows), key=key) == sorted(((p[0], *w) for p, w in zip(pages, want)), key=key)
    assert hr.judge_pages(spark.createDataFrame([], _SCHEMA)).collect() == []
