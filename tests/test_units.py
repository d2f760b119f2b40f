"""Hand-written rows for the semantic contract and the reference's own examples."""
import json

from pyspark.sql import functions as F

from reviewlake.operators import corpus as C
from reviewlake.operators import diff as D
from reviewlake.operators import feedback as Fb
from reviewlake.operators import findings as Fd
from reviewlake.operators import runs as Rn
from reviewlake.operators import scan as S


def _resp(spark, rows):
    return spark.createDataFrame(rows, "review_id string, response string, file string")


def test_response_fallbacks_and_validation(spark):
    good = {"summary": "s", "score": 7.0, "issues": [
        {"severity": "Major", "title": "t", "description": "d", "category": "ai_slop"},
        {"severity": "CRITICAL", "title": "x", "description": "y", "category": "Compilation"}]}
    bad_sev = {"score": 9, "issues": [{"severity": "urgent", "title": "t", "description": "d"}]}
    bad_score = {"score": 7.5, "issues": []}
    rows = [("1", "no json at all", "f"), ("2", "{bad", "f"), ("3", "x " + json.dumps(good) + " y", "f"),
            ("4", json.dumps(bad_sev), "f"), ("5", json.dumps(bad_score), "f"), ("6", "{}", "f")]
    reviews, issues = Fd.review_responses(_resp(spark, rows), "pr")
    r = {x.review_id: x for x in reviews.collect()}
    assert (r["1"].score, r["1"].approval_recommended, r["1"].summary) == (7, True, "no json at all")
    # "{bad" has no closing brace: no span -> the no-JSON fallback
    assert r["2"].parse_status == "no_json"
    assert r["3"].failure_reason is None and r["3"].score == 7
    assert r["4"].failure_reason == "bad_severity" and r["4"].score == 0 and r["4"].block_merge
    assert r["5"].failure_reason == "bad_score"
    assert r["6"].score == 7 and r["6"].summary == "AI review completed"
    i = sorted((x.review_id, x.pos, x.severity, x.title) for x in issues.collect())
    # short-circuit keeps only the critical compilation issue, with the title prefixed
    assert i == [("3", 2, "critical", "CRITICAL: x")]
    assert r["3"].block_merge and r["3"].critical_count == 1
    assert r["3"].summary.startswith("🚨 CRITICAL ERRORS FOUND (1):\n1. CRITICAL: x - 🚨 CRITICAL: y...\n\ns")


def test_malformed_span(spark):
    reviews, _ = Fd.review_responses(_resp(spark, [("1", "a {not json} b", "f")]), "pr")
    r = reviews.collect()[0]
    assert (r.parse_status, r.score, r.approval_recommended, r.summary) == ("malformed", 5, False,
                                                                           "Failed to parse AI response")


def test_file_mode(spark):
    body = {"issues": [{"severity": "critical", "title": "t", "description": "d", "category": "syntax"},
                       {"severity": "low", "title": "u", "description": "e", "file_path": ""}]}
    reviews, issues = Fd.review_responses(_resp(spark, [("1", json.dumps(body), "a/b.py")]), "file")
    r = reviews.collect()[0]
    assert r.total_issues == 2 and not r.block_merge and r.summary == "File review completed"
    assert sorted(x.file_path for x in issues.collect()) == ["a/b.py", "a/b.py"]


def test_security_score_and_flags(spark):
    rows = [("r", 1, "critical", "security", "secret_leak", "A1"), ("r", 2, "high", "security", None, "A10"),
            ("r", 3, "medium", "secret_leak", "x", "A2"), ("r", 4, "low", "ai_slop", None, "")]
    issues = spark.createDataFrame(rows, "review_id string, pos int, severity string, category string, "
                                         "threat_type string, owasp_id string")
    reviews = spark.createDataFrame([("r",), ("empty",)], "review_id string")
    out = {x.review_id: x for x in Fd.review_rollup(reviews, issues).collect()}
    assert out["r"].security_score == 4 and out["r"].secret_leak_detected
    assert out["r"].owasp_hits == ["A1", "A10", "A2"]
    assert out["r"].ai_slop_detected and out["r"].security_issues_count == 2
    assert out["empty"].security_score == 10 and out["empty"].total_issues == 0


DIFF = "\n".join([
    "diff --git a/x.py b/x.py",
    "--- a/x.py",
    "+++ b/x.py",
    "@@ -1,3 +1,3 @@",
    " keep",
    "--- removed line that looks like a header",
    "+added",
    " tail",
    "\\ No newline at end of file",
    "--- /dev/null",
    "+++ b/new.py",
    "@@ -0,0 +1 @@",
    "+hello",
    "--- a/old.py",
    "+++ /dev/null",
    "@@ -1 +0,0 @@",
    "-bye",
    "",
])


def test_diff_parsing(spark):
    prs = spark.createDataFrame([(1, DIFF)], "pr long, diff string")
    c = D.diff_lines_all(prs)
    files = {x.path: x for x in D.diff_files(None, classified=c).collect()}
    assert set(files) == {"x.py", "new.py", "old.py"}
    assert (files["x.py"].additions, files["x.py"].deletions) == (1, 1)
    assert files["new.py"].is_new and files["old.py"].is_deleted
    lines = sorted((x.path, x.type, x.line_number) for x in D.diff_lines(c).collect())
    assert ("x.py", "removed", 2) in lines and ("x.py", "added", 2) in lines and ("x.py", "context", 3) in lines
    assert ("new.py", "added", 1) in lines and ("old.py", "removed", 1) in lines
    assert D.diff_errors(c).count() == 0


def test_diff_errors(spark):
    prs = spark.createDataFrame([(1, "--- a/x\n+++ b/x\n@@ -1,5 +1,5 @@\n a"), (2, "@@ -1 +1 @@\n-a\n+b")],
                                "pr long, diff string")
    err = {x.pr: x.error for x in D.diff_errors(D.diff_lines_all(prs)).collect()}
    assert err == {1: "hunk_too_short", 2: "hunk_without_file_header"}


def test_extension_and_is_diff(spark):
    df = spark.createDataFrame([("a.b/c",), ("noext",), ("x.PY",)], "path string")
    assert [x.e for x in df.select(D.extension_of(F.col("path")).alias("e")).collect()] == ["b/c", "no_extension", "PY"]
    t = spark.createDataFrame([("  \n@@ -1 +1 @@",), ("def f(): pass",)], "t string")
    assert [x.d for x in t.select(D.is_diff(F.col("t")).alias("d")).collect()] == [True, False]


def test_suffix_language_classify(spark):
    paths = ["a/.gitignore", "a/b.", "x/page.spec.ts", "immigration.py", "src/Tests/x.py", "Program.cs",
             "cfg/app.JSON", "lib/a.py", "a/b/Dockerfile"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select(C.suffix(F.col("p")).alias("s"), C.classify_col(F.col("p")).alias("c"),
                    C.language_of(F.col("p")).alias("l")).collect()
    assert [g.s for g in got] == ["", "", ".ts", ".py", ".py", ".cs", ".JSON", ".py", ""]
    assert [g.c for g in got] == ["source", "source", "test", "auto_generated", "test", "boilerplate", "config",
                                  "source", "source"]
    assert got[6].l == "json" and got[1].l is None


def test_ignore_globs(spark):
    files = spark.createDataFrame([(p,) for p in ["node_modules/x/y.js", "a/node_modules", "docs/readme.md",
                                                  "build/out/a.js", "src/mod1.py", "src/mod12.py", "x/Docs/a.py",
                                                  "src/Migrations/m.cs", "abs.py"]], "rel_path string")
    pats = spark.createDataFrame([(p,) for p in ["node_modules/", "*.md", "build/*", "mod?.py", "src/Migrations",
                                                 "/abs.py"]], "pattern string")
    kept, ign = C.split_ignored(files, pats)
    assert sorted(x.rel_path for x in ign.collect()) == ["build/out/a.js", "docs/readme.md", "node_modules/x/y.js",
                                                          "src/Migrations/m.cs", "src/mod1.py"]
    kept_paths = [x.rel_path for x in kept.collect()]
    assert "a/node_modules" in kept_paths and "abs.py" in kept_paths  # a leading / never matches a relative path


def test_posix_parent_and_titles(spark):
    df = spark.createDataFrame([(p,) for p in ["a/b/c.py", "main.py", "/x", "a//b/./c.py", "a/"]], "p string")
    assert [x.d for x in df.select(Fb.posix_parent(F.col("p")).alias("d")).collect()] == ["a/b", ".", "/", "a/b", "."]
    t = spark.createDataFrame([("CRITICAL: SQL Injection (user input) at Line 12",), ("  (x)  ",)], "title string")
    assert [x.p for x in t.select(Fb.title_pattern(F.col("title")).alias("p")).collect()] == [
        "SQL Injection at line N", ""]


def test_retention_and_cursor(spark):
    # three events, keep the last two; cursor 0 returns seq 2 and 3 with next cursor 3
    ev = spark.createDataFrame([("r", i, i) for i in (1, 2, 3)], "run_id string, seq long, event_id long")
    kept = Rn.retain(ev, 2)
    assert sorted(x.seq for x in kept.collect()) == [2, 3]
    cur = spark.createDataFrame([("r", 0)], "run_id string, cursor long")
    out = Rn.since(kept, cur, 200).collect()
    assert sorted(x.seq for x in out) == [2, 3] and {x.next_cursor for x in out} == {3}
    empty = Rn.since(kept, spark.createDataFrame([("r", 3)], "run_id string, cursor long"), 0).collect()
    assert [(x.seq, x.next_cursor) for x in empty] == [(None, 3)]


def test_step_groups(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [("r", 1, t0, "info", "console_banner", "====="), ("r", 2, t0, "info", "console_header", "PR #1"),
            ("r", 3, t0, "info", "step_1_fetch", "fetching"), ("r", 4, t0, "info", "step_1", "✅ ok"),
            ("r", 5, t0, "error", "step_2", "boom"), ("r", 6, t0, "info", "step_2", "✅ later"),
            ("r", 7, t0, "info", "adapter", "x"), ("r", 8, t0, "info", "summary", "   "),
            ("r", 9, t0, "info", "summary", "-" * 25)]
    ev = spark.createDataFrame(rows, "run_id string, seq long, ts timestamp_ntz, level string, step string, message string")
    g = {x.group_id: (x.kind, x.title, x.status) for x in Rn.step_groups(ev).collect()}
    assert g == {"header": ("header", "PR Header", "neutral"), "step_1": ("step", "Step 1", "success"),
                 "step_2": ("step", "Step 2", "error"), "misc-7": ("misc", "adapter", "running")}


def test_scan_packs(spark):
    lines = spark.createDataFrame([("a", 'password = "x"'), ("b", "el.innerHTML = v;"), ("c", "except Exception:"),
                                   ("d", "nothing here")], "id string, content string")
    hits = sorted((x.id, x.rule_id) for x in S.scan(lines, S.SECRET_PACK + S.INJECTION_PACK + S.SLOP_PACK).collect())
    assert hits == [("a", "secret.password"), ("b", "inj.inner_html"), ("c", "slop.catch_all")]


def test_ranks_keep_every_row_under_adaptive_execution(spark):
    """A wide table whose range partitions adaptive execution would merge: ranks are 1..n, each once."""
    from reviewlake.functions.ranking import global_rank, running_sums

    n = 300_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("v"), F.repeat(F.lit("x"), 200).alias("wide"))
    out = global_rank(df, [F.col("v")]).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("a"),
                                            F.max("rank").alias("b"), F.count_if(F.col("rank") != F.col("v") + 1).alias("wrong")).first()
    assert tuple(out) == (n, n, 1, n, 0)
    hot = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), "id")
    got = running_sums(hot, ["k"], [F.col("id")], {"c": F.lit(1).cast("bigint"), "s": F.col("id")})
    want = {}
    for r in sorted(hot.collect(), key=lambda r: r.id):
        c, s = want.get(r.k, (0, 0))
        want[r.k] = (c + 1, s + r.id)
    last = got.groupBy("k").agg(F.max(F.struct("id", "c", "s")).alias("m")).collect()
    assert {r.k: (r.m.c, r.m.s) for r in last} == want and got.count() == 20_000


def test_wrong_types_and_shapes_fail_the_review(spark):
    ok = {"severity": "low", "title": "t", "description": "d"}
    cases = {
        "issues_not_list": [{"issues": "none"}, {"issues": 3}, {"issues": None}, {"issues": {"a": 1}}],
        "issue_not_object": [{"issues": ["x"]}, {"issues": [ok, None]}, {"issues": [[1]]}],
        "bad_title": [{"issues": [ok | {"title": 5}]}, {"issues": [ok | {"title": None}]}],
        "bad_score": [{"score": None}, {"score": "high"}, {"score": 11}, {"score": [7]}],
        "bad_approval": [{"approval_recommended": "maybe"}, {"approval_recommended": None}],
        "bad_block": [{"block_merge": "perhaps"}],
        "bad_summary": [{"summary": None}, {"summary": 4}],
        "bad_severity": [{"issues": [ok | {"severity": 3}]}, {"issues": [{"title": "t", "description": "d"}]}],
        "bad_line_number": [{"issues": [ok | {"line_number": 1.5}]}, {"issues": [ok | {"line_number": "x"}]}],
        "bad_category": [{"issues": [ok | {"category": None}]}],
        None: [{"issues": ""}, {"issues": {}}, {"block_merge": ""}, {"score": "7"}, {"approval_recommended": "Yes"}, {"block_merge": 1},
               {"issues": [ok | {"line_number": 3_000_000_000, "file_path": None}]}, {"issues": [ok | {"line_number": "12"}]}],
    }
    rows = [(f"{k}-{i}", json.dumps(c), "f") for k, cs in cases.items() for i, c in enumerate(cs)]
    reviews, issues = Fd.review_responses(_resp(spark, rows), "pr")
    got = {r.review_id: r.failure_reason for r in reviews.collect()}
    assert got == {f"{k}-{i}": k for k, cs in cases.items() for i in range(len(cs))}
    assert {i.line_number for i in issues.collect()} == {3_000_000_000, 12}


def test_one_parse_in_the_plans(spark):
    """The review pipeline shuffles nothing and the webhook filter does not repeat the parse."""
    from reviewlake.operators import ingest as In
    from reviewlake.plans.ingest_queries import webhooks

    from .conftest import SF_SMALL

    plan = In.unified_prs(webhooks(spark, SF_SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(action") + plan.count("from_json(StructField(zen") == 1, plan.count("from_json")
    reviews, _ = Fd.review_responses(_resp(spark, [("1", "{}", "f")]), "pr")
    text = reviews._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text


def test_globs_and_ignore_files(spark):
    files = spark.createDataFrame([(p, f) for p in ("own", "none") for f in ("foo[bar", "a/b.py", "a.py", "src/gen/x.py", "docs/y.md")], "project string, rel_path string")
    own = spark.createDataFrame([("own", "foo[bar"), ("own", "src/gen/")], "project string, pattern string")
    default = spark.createDataFrame([("[ab].py",), ("docs/",)], "pattern string")
    out = C.flag_ignored(files, own, group="project", default=default).filter("ignored").select("project", "rel_path").collect()
    assert sorted(map(tuple, out)) == [("none", "a.py"), ("none", "a/b.py"), ("none", "docs/y.md"), ("own", "foo[bar"), ("own", "src/gen/x.py")]


def test_invalid_utf8_files_are_read(spark, tmp_path):
    from reviewlake.sources.io import read_files

    (tmp_path / "bad.py").write_bytes(b"ok \xff\xfe end")
    assert "ok " in read_files(spark, str(tmp_path)).first().text


def test_checkpoint_folder_is_required_on_a_cluster():
    import pytest

    from reviewlake.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Cluster())


def test_eight_issue_review(spark):
    """A review with two critical, three high and three medium issues over five categories, from response to tables."""
    from reviewlake.operators import analytics as A

    kinds = [("critical", "security"), ("critical", "reliability"), ("high", "security"), ("high", "performance"), ("high", "maintainability"),
             ("medium", "reliability"), ("medium", "best_practices"), ("medium", "performance")]
    body = {"summary": "Several problems.", "score": 6, "approval_recommended": False, "block_merge": True, "issues": [
        {"severity": s, "title": f"title {k}", "description": f"text {k}", "file_path": f"m{k}.py", "line_number": 10 + k, "suggestion": "fix", "category": c}
        for k, (s, c) in enumerate(kinds)]}
    reviews, issues = Fd.review_responses(_resp(spark, [("1", json.dumps(body), "f")]), "pr")
    r = reviews.first()
    assert (r.total_issues, r.critical_count, r.high_count, r.medium_count, r.low_count, r.info_count) == (8, 2, 3, 3, 0, 0)
    assert (r.score, r.block_merge, r.approval_recommended, r.security_score, r.security_issues_count) == (6, True, False, 4, 2)
    assert r.summary.startswith("🚨 CRITICAL ERRORS FOUND (2):\n1. CRITICAL: title 0 - 🚨 CRITICAL: text 0...\n2. CRITICAL: title 1 - ")
    matrix = {x.area: (x.critical, x.high, x.medium, x.total) for x in A.severity_type_matrix(reviews.select("review_id"), issues).collect()}
    assert matrix == {"Security": (1, 1, 0, 2), "Reliability": (1, 1, 2, 4), "Maintainability": (0, 1, 1, 2)}
    assert A.debt_hours(reviews.select("review_id"), issues).first().debt_hours == 8.5
    comments = {x.pos: (x.file_path, x.line) for x in A.inline_comments(issues).collect()}
    assert comments == {k + 1: (f"m{k}.py", 10 + k) for k in range(8)}
