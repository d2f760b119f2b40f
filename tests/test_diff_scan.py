"""diff.*: the segmented scan against a parser that walks the lines one by one."""
import random
import re

import pytest

from reviewlake.operators import diff as D

HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
GIT = re.compile(r"diff --git (\S.*) (b/.*|\S+)$")


def path_of(src, tgt):
    bare = lambda x: x[2:] if x[:2] in ("a/", "b/") else x
    return bare(tgt) if src == D.DEV_NULL or (tgt != D.DEV_NULL and bare(src) != bare(tgt)) else bare(src)


def parse(diff):
    """(files, hunks, lines, error) of one diff, line by line."""
    files, hunks, lines, errors = [], [], [], []

    def close(h):
        if h is None:
            return
        src, tgt = h["src"] + h["both"], h["tgt"] + h["both"]
        if h["orphan"]:
            errors.append("hunk_without_file_header")
        elif None in h["numbers"]:
            errors.append("bad_hunk_header")
        elif src < h["numbers"][1] or tgt < h["numbers"][3]:
            errors.append("hunk_too_short")
        elif src > h["numbers"][1] or tgt > h["numbers"][3]:
            errors.append("hunk_too_long")

    for section in re.split(r"(?m)(?=^diff --git )", diff or ""):
        rows = section.split("\n")
        if rows[-1] == "":
            rows.pop()
        hunk, header, at, seen, modes = None, None, None, [0, 0], set()
        section_files = 0
        first_file = len(files)
        for i, text in enumerate(rows):
            m = HUNK.match(text)
            if m:
                close(hunk)
                number = lambda x, omitted=None: omitted if x is None else int(x) if int(x) < 1 << 63 else None
                hunk = {"numbers": [number(m[1]), number(m[2], 1), number(m[3]), number(m[4], 1)], "src": 0, "tgt": 0, "both": 0,
                        "orphan": header is None and not (i and at), "file": len(files)}
                hunks.append(hunk)
                seen = [0, 0]
                continue
            sides = [text == "" or text[0] in " -", text == "" or text[0] in " +"]
            if hunk and None not in (hunk["numbers"][1], hunk["numbers"][3]) and any(sides) and (seen[0] < hunk["numbers"][1] or seen[1] < hunk["numbers"][3]):
                kind = "added" if text[:1] == "+" else "removed" if text[:1] == "-" else "context"
                hunk[{"added": "tgt", "removed": "src", "context": "both"}[kind]] += 1
                start, before = (hunk["numbers"][2], seen[1]) if kind == "added" else (hunk["numbers"][0], seen[0])
                lines.append((len(files), len(hunks), kind, None if start is None else start + before, text[1:], section_files))
                seen = [a + b for a, b in zip(seen, sides)]
                continue
            if hunk:
                seen = [a + b for a, b in zip(seen, sides)]
            modes |= {w for w in ("new file mode", "deleted file mode") if text.startswith(w)}
            if text.startswith("--- ") and i + 1 < len(rows) and rows[i + 1].startswith("+++ "):
                src, tgt = re.match(r"[^\t]*", text[4:])[0], re.match(r"[^\t]*", rows[i + 1][4:])[0]
                header = (path_of(src, tgt), src == D.DEV_NULL, tgt == D.DEV_NULL)
                files.append(header)
                section_files += 1
            elif i == 0:
                at = GIT.match(text)
        close(hunk)
        if at and not section_files:  # a file without hunks
            src, tgt = D.DEV_NULL if "new file mode" in modes else at[1], D.DEV_NULL if "deleted file mode" in modes else at[2]
            files.insert(first_file, (path_of(src, tgt), src == D.DEV_NULL, tgt == D.DEV_NULL))
    return files, hunks, lines, min(errors, default=None)


def some_diff(rng):
    out = []
    for k in range(rng.randrange(5)):
        git = rng.random() < 0.7
        if git:
            out.append(f"diff --git a/f{k}.py b/{rng.choice(['f', 'g'])}{k}.py")
            out += rng.sample(["index 1..2", "new file mode 100644", "deleted file mode 100644"], rng.randrange(3))
        if not git or rng.random() < 0.75:
            names = [rng.choice([f"a/f{k}.py", D.DEV_NULL]), f"b/f{k}.py"]
            out += [f"--- {names[0]}\t2024", f"+++ {names[1]}"]
            for _ in range(rng.randrange(4)):
                body = [rng.choice("+- ") + rng.choice(["x", "", "-- y", "++ z", "@@ -1 +1 @@"]) for _ in range(rng.choice([1, 3, 9, 25]))]
                src, tgt = sum(b[0] != "+" for b in body), sum(b[0] != "-" for b in body)
                if rng.random() < 0.05:
                    src += rng.choice([1, 5])
                out.append(f"@@ -{rng.randrange(9)},{src} +{rng.randrange(9)},{tgt} @@ def f")
                out += [b if b != " " or rng.random() < 0.5 else "" for b in body]
                if rng.random() < 0.3:
                    out.append("\\ No newline at end of file")
    return "\n".join(out) + rng.choice(["", "\n"])


@pytest.mark.parametrize("run_lines", [4, 7, 20_000])
def test_scan_against_line_by_line(spark, run_lines):
    rng = random.Random(11)
    diffs = {i: some_diff(rng) for i in range(160)} | {1000: None, 1001: "", 1002: "no diff\nat all", 1003: "@@ -1 +1 @@\n-a\n+b"}
    want = {i: parse(d) for i, d in diffs.items()}
    assert sum(w[3] is None and len(w[0]) > 1 for w in want.values()) > 30 and sum(w[3] is not None for w in want.values()) > 3
    c = D.diff_lines_all(spark.createDataFrame(list(diffs.items()), "pr long, diff string").repartition(3), run_lines=run_lines)
    assert {r.pr: r.error for r in D.diff_errors(c).collect()} == {i: w[3] for i, w in want.items() if w[3]}
    good = {i: w for i, w in want.items() if w[3] is None}
    lines = sorted((r.pr, r.hunk_idx, r.ln, r.type, r.line_number, r.content) for r in D.diff_lines(c).collect())
    assert [(p, h, t, n, x) for p, h, _, t, n, x in lines] == [(i, h, t, n, x) for i, w in sorted(good.items()) for _, h, t, n, x, _ in w[2]]
    files = sorted((r.pr, r.file_idx, r.path, r.is_new, r.is_deleted) for r in D.diff_files(None, classified=c).collect())
    assert files == [(i, k, *f) for i, w in sorted(good.items()) for k, f in enumerate(w[0], 1)]
    hunks = sorted((r.pr, r.hunk_idx, r.src_start, r.src_len, r.tgt_start, r.tgt_len) for r in D.diff_hunks(c).collect())
    assert hunks == [(i, k, *h["numbers"]) for i, w in sorted(good.items()) for k, h in enumerate(w[1], 1)]
    paths = {(r.pr, r.file_idx): r.path for r in D.diff_files(None, classified=c).collect()}
    assert all(paths[r.pr, r.file_idx] == r.path for r in D.diff_lines(c).collect())


def test_a_large_section_is_many_tasks_and_one_classification(spark):
    n = 30_000
    diff = "\n".join(["--- a/big", "+++ b/big", f"@@ -1,{n} +1,{n} @@", *[" same"] * n, "@@ -50000 +50000,2 @@", "-a", "+b", "+c"])
    c = D.diff_lines_all(spark.createDataFrame([(1, diff)], "pr long, diff string"), run_lines=1000)
    assert c.select("start").distinct().count() == 31
    assert [tuple(r) for r in D.diff_files(None, classified=c).collect()] == [(1, 1, "big", 2, 1, False, False, 2)]
    plan = D.diff_files(None, classified=c)._jdf.queryExecution().optimizedPlan().toString()
    nodes = [x.strip(" +-:").split(" ")[0] for x in plan.splitlines()]
    assert nodes.count("Window") <= 8
    lines = D.diff_lines(c)
    assert lines.where("type = 'context'").count() == n and lines.where("line_number = 50001").collect()[0].content == "c"
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # the classified lines are read, not made again
