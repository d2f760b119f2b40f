"""Rewritten steps that scale: the same rows, and the work they no longer do."""
import re

from pyspark.sql import functions as F

from reviewlake.plans import fixtures as fx


# ------------------------------------------------------------------------------------ staged fixtures

LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double"


def test_issue_fixture_numbers_before_texts(spark):
    """Only key columns go through the window's shuffle; null and repeated keys give the same rows as the text as written."""
    rows = [(o, n, p, s, e) for o in (1, 2, None) for n in (1, 2, None) for p, s, e in [(3, 7, 9.5), (3, 7, 9.5), (18, None, 1.0), (None, 10, None)]]
    lineitem = spark.createDataFrame(rows, LINES)
    sql, binds = fx._numbered(fx.FX_SQL["fx_issues"], {"lineitem": lineitem})
    assert "OVER" not in sql
    got, want = spark.sql(sql, **binds), spark.sql(fx.FX_SQL["fx_issues"], lineitem=lineitem)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    window = plan[re.search(r"\bWindow\b", plan).start():]
    assert "Magic number" in plan and "Magic number" not in window


# ------------------------------------------------------------------------------------ paths and titles

def test_posix_parent_of_odd_paths(spark):
    """A path in normal form runs no regex; all give their parent as the regexes do."""
    from reviewlake.operators import feedback as Fb

    parts = ["a", "b.py", ".", "..", "", "x.", ".x", "é", "a\n", "a "]
    paths = ["/".join(p) for p in [(a,) for a in parts] + [(a, b) for a in parts for b in parts] + [(a, b, c) for a in parts for b in parts for c in parts]]

    def parent(p):
        p = re.sub("/+", "/", p)
        p = re.sub(r"(^|/)(\./)+", r"\1", p)
        end = "(?=(?:\r\n|[\n\r\u0085  ])?\\Z)"
        p = re.sub(r"/\." + end, "", p)
        p = "" if p == "." else p
        p = re.sub("([^\n\r\u0085  ])/" + end, r"\1", p)
        return "." if "/" not in p else p[: p.rindex("/")] or "/"

    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select("p", Fb.posix_parent(F.col("p")).alias("d")).collect()
    assert {r.p: r.d for r in got} == {p: parent(p) for p in paths}
    texts = ["Line 12 and line 3", "LINE 4", "outline 5", "line x", "", None, "a (line 6) b", "CRITICAL: lInE 7"]
    seen = spark.createDataFrame([(t,) for t in texts], "t string").select(Fb.title_pattern(F.col("t")).alias("x")).collect()
    assert [r.x for r in seen] == ["line N and line N", "line N", "outline N", "line x", "", "", "a b", "line N"]
