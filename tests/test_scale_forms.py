"""Forms that avoid work at scale give what the plain ones give: pattern index, threshold join, heavy hitters, blocks."""
import fnmatch
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reviewlake.functions.heavy import most_frequent
from reviewlake.operators import analytics as A
from reviewlake.operators import corpus as C
from reviewlake.operators import feedback as Fb
from reviewlake.operators import scan as S
from reviewlake.plans import base

from .conftest import SF_SMALL


# ------------------------------------------------------------------------------------ ignore patterns

def ignored(path, patterns):
    """The four cases of an ignore pattern, one pattern after the other."""
    *dirs, name = path.replace("\\", "/").split("/")
    rel = path.replace("\\", "/")
    for raw in patterns:
        p = raw.rstrip("/")
        if not p:
            continue
        hit = lambda text, glob=p: fnmatch.fnmatchcase(text, glob)
        if "/" not in p:
            if any(map(hit, dirs)) or (not raw.endswith("/") and hit(name)):
                return True
        elif hit(rel) or hit(rel, p + "/**") or (raw.endswith("/") and hit(rel, p + "*")):
            return True
    return False


PATTERNS = ["node_modules/", "*.md", "build/*", "build/**", "docs/", "src/Mig", "src/Mig/", "mod?.py", "/abs.py", "**/gen", "**/gen/", "*.min.js", "*.d.ts/", "a/*/c", "[ab].py", "[!a].js", "x[.py",
            "src/*.py", "*", "**", "tests/unit/t1.py", "", "///", "a.b", "*_pb2.py", "[z-a]", "v1.0/", "lib/[", "README", "*.", "**/a/b", "é/*"]


def _paths(rng, n):
    parts = ["src", "a", "b", "c", "gen", "docs", "build", "node_modules", "Mig", "Migrations", "x.min.js", "v1.0", "lib", "é", "t.d.ts", ""]
    names = ["mod1.py", "a.py", "b.py", "z.js", "a.js", "README", "README.md", "x.min.js", "x[.py", "gen", "t1.py", "q_pb2.py", "a.b", ".md", "c", "end."]
    return ["/".join([*rng.choices(parts, k=rng.randrange(4)), rng.choice(names)]) for _ in range(n)] + ["abs.py", "/abs.py", "src\\a.py", "tests/unit/t1.py"]


def test_pattern_index_against_every_pattern(spark):
    rng = random.Random(4)
    paths = sorted(set(_paths(rng, 300)))
    groups = {f"p{k}": rng.sample(PATTERNS, k % 5) for k in range(40)} | {f"one{k}": [p] for k, p in enumerate(PATTERNS)}
    default = ["*.js", "docs/"]
    files = spark.createDataFrame([(g, p) for g in [*groups, None] for p in rng.sample(paths, 60)] + [("p1", None)], "project string, rel_path string")
    own = spark.createDataFrame([(g, p) for g, ps in groups.items() for p in ps], "project string, pattern string")
    got = C.flag_ignored(files, own, group="project", default=spark.createDataFrame([(p,) for p in default], "pattern string"))
    assert got.columns == ["project", "rel_path", "ignored"] and got.count() == files.count()
    has_own = {g for g, ps in groups.items() if any(p.rstrip("/") for p in ps)}
    for r in got.collect():
        want = r.rel_path is not None and ignored(r.rel_path, groups[r.project] if r.project in has_own else default)
        assert r.ignored == want, (r, groups.get(r.project))
    alone = C.flag_ignored(files.select("rel_path"), own.select("pattern"))
    assert all(r.ignored == (r.rel_path is not None) for r in alone.collect())  # '*' is among them


def test_no_pattern_of_a_column_reaches_a_regex(spark):
    own = spark.createDataFrame([("p", "*.md")], "project string, pattern string")
    files = spark.createDataFrame([("p", "a/b.md")], "project string, rel_path string")
    plan = C.flag_ignored(files, own, group="project")._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and "RLIKE(x" not in plan and "re_" not in plan


def test_ten_thousand_patterns(spark):
    own = spark.range(10_000).select(F.concat(F.lit("p"), (F.col("id") % 50).cast("string")).alias("project"), F.concat(F.lit("gen/dir"), F.col("id").cast("string")).alias("pattern"))
    files = spark.range(5_000).select(F.concat(F.lit("p"), (F.col("id") * 2 % 50).cast("string")).alias("project"), F.concat(F.lit("gen/dir"), (F.col("id") * 2).cast("string"), F.lit("/x.py")).alias("rel_path"))
    assert C.flag_ignored(files, own, group="project").filter("ignored").count() == 5_000


# ------------------------------------------------------------------------------------ threshold join

@pytest.mark.parametrize("n,category", [(1, None), (7, None), (50, "security"), (10_000, None)])
def test_newest_issues_against_the_plain_join(spark, n, category):
    reviews, issues = base.st_reviews(spark, SF_SMALL), base.st_issues(spark, SF_SMALL)
    # one repo holds a third of all reviews; some reviews share a time, some have no issue
    reviews = reviews.withColumn("repo", F.when(F.crc32("review_id") % 3 == 0, "hot").otherwise(F.col("repo"))).withColumn("created_at", F.date_trunc("month", "created_at"))
    order = [F.col("review_ts").desc(), F.col("review_id").desc(), F.col("pos").asc(), F.col("issue_id").asc()]
    plain = A.repo_issues(reviews, issues, None, category)
    plain = plain.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).filter(F.col("rank") <= n)
    cols = ["issue_id", "review_id", "repo", "pr_id", "review_ts", "category", "rank"]
    got = A.repo_issues(reviews, issues, n, category)
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, plain.select(cols).collect()))


# ------------------------------------------------------------------------------------ heavy hitters

@pytest.mark.parametrize("capacity,task_counters", [(1_000, 500_000), (5, 500_000), (3, 10), (1, 1)])
def test_most_frequent_is_exact(spark, capacity, task_counters):
    rng = random.Random(capacity)
    rows = [("zipf", f"t{int(rng.paretovariate(0.7)) % 500}") for _ in range(4000)] + [("flat", f"u{k % 300}") for k in range(1500)]
    rows += [("few", "a")] * 5 + [("few", "b")] * 5 + [(None, "x"), ("few", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "repo string, title string").repartition(6)
    got = sorted((r.repo, r["rank"], r.title, r["count"]) for r in most_frequent(df, "repo", "title", 10, capacity=capacity, task_counters=task_counters).collect())
    counts = {}
    for g, t in rows:
        if g is not None and t is not None:
            counts.setdefault(g, {}).setdefault(t, 0)
            counts[g][t] += 1
    want = sorted((g, k, t, c) for g, f in counts.items() for k, (t, c) in enumerate(sorted(f.items(), key=lambda x: (-x[1], x[0]))[:10], 1))
    assert got == want


def test_recurring_titles_of_small_summaries(spark):
    issues = base.st_issues(spark, SF_SMALL).join(base.st_reviews(spark, SF_SMALL).select("review_id", "repo"), "review_id")
    rows = lambda df: sorted(map(tuple, df.select("repo", "title_pattern", "count", "rank").collect()))
    assert rows(Fb.recurring_titles(issues, 3, capacity=1)) == rows(Fb.recurring_titles(issues, 3))


# ------------------------------------------------------------------------------------ copied blocks

def _lines(spark, docs):
    return S.split_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))


def test_blocks_are_found_whole(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"line {rng.random()}" for _ in range(n)]
    block, short = fresh(23), fresh(3)
    docs = {1: fresh(5) + block + fresh(4), 2: fresh(2) + [x for y in block for x in ("  " + y, "", " \t")] + fresh(9), 3: block[4:], 4: short + fresh(9), 5: short + fresh(5), 6: fresh(30), 7: []}
    rows = {r.doc_id: r for r in S.copied_blocks(_lines(spark, {k: "\n".join(v) for k, v in docs.items()} | {8: None})).collect()}
    assert set(rows) == {2, 3}
    assert (rows[2].first_line, rows[2].last_line, rows[2].lines, rows[2].of_doc_id, rows[2].of_first_line, rows[2].of_last_line) == (3, 3 + 3 * 22, 23, 1, 6, 28)
    assert (rows[3].first_line, rows[3].last_line, rows[3].lines, rows[3].of_doc_id, rows[3].of_first_line) == (1, 19, 19, 1, 10)


def test_a_class_is_rows_and_not_pairs(spark):
    head = "\n".join(f"licence {k}" for k in range(10))
    docs = {k: head + f"\nown {k}\nmore {k}" for k in range(200)}
    rows = S.copied_blocks(_lines(spark, docs)).collect()
    assert len(rows) == 199 and {r.of_doc_id for r in rows} == {0} and {r.lines for r in rows} == {10} and len({r.block_md5 for r in rows}) == 1


def test_blocks_against_comparing_all_lines(spark):
    """Every block found is equal line by line and cannot be extended where the prints reach."""
    rng = random.Random(2)
    docs = {k: [f"v{rng.randrange(6)}" for _ in range(rng.randrange(3, 60))] for k in range(12)}
    rows = S.copied_blocks(_lines(spark, {k: "\n".join(v) for k, v in docs.items()})).collect()
    assert rows
    for r in rows:
        own, of = docs[r.doc_id][r.first_line - 1:r.last_line], docs[r.of_doc_id][r.of_first_line - 1:r.of_last_line]
        assert own == of and len(own) == r.lines >= 4
    assert len({(r.doc_id, r.first_line, r.of_doc_id, r.of_first_line) for r in rows}) == len(rows)
