"""Line alignment of hunks against trying every alignment."""
import functools
import random

import pytest

from reviewlake.operators import align as L
from reviewlake.operators import diff as D
from reviewlake.operators import scan as S


def _lcs(a, b):
    @functools.cache
    def f(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + f(i + 1, j + 1) if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

    return f(0, 0)


def test_common_subsequence_against_recursion():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        assert L.common_subsequence(a, b) == _lcs(tuple(a), tuple(b))


def _best(removed, added):
    """Greatest total similarity of any alignment in order."""
    tokens = lambda x: L._TOKEN.findall(x)

    def sim(x, y):
        x, y = tokens(x), tokens(y)
        v = 2 * _lcs(tuple(x), tuple(y)) / (len(x) + len(y)) if x or y else 0
        return v if v >= L.SIMILAR else 0

    @functools.cache
    def f(i, j):
        if i == len(removed) or j == len(added):
            return 0
        v = sim(removed[i], added[j])
        return max(f(i + 1, j), f(i, j + 1), v + f(i + 1, j + 1) if v else 0)

    return f(0, 0), sim


def test_alignment_against_recursion():
    rng = random.Random(2)
    for _ in range(200):
        removed, added = ([" ".join(rng.choices(["let", "x", "=", "await", "y", "(", ")"], k=rng.randrange(1, 6))) for _ in range(rng.randrange(5))] for _ in range(2))
        pairs = L.aligned(removed, added)
        most, sim = _best(tuple(removed), tuple(added))
        assert abs(sum(sim(removed[i], added[j]) for i, j in pairs) - most) < 1e-9
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:])) and all(sim(removed[i], added[j]) for i, j in pairs)


def _pairs(spark, *body):
    src, tgt = sum(x[0] != "+" for x in body), sum(x[0] != "-" for x in body)
    diff = "\n".join(["--- a/f", "+++ b/f", f"@@ -1,{src} +1,{tgt} @@", *body])
    lines = D.diff_lines(D.diff_lines_all(spark.createDataFrame([(1, diff)], "pr long, diff string")))
    return lines


def test_moved_lines_are_no_replacements(spark):
    lines = _pairs(spark, "-await one()", "-let two = 2", " c", "+let two = 3", "+  await one()", "-static x = f(1)", "+x = f(1)", " d", "-return gone")
    got = sorted((r.line_number, r.new_line_number, r.keyword, r.lost) for r in L.replaced_keywords(lines, S.KEYWORDS).collect())
    assert got == [(4, 4, "static", 1)]


def test_repeated_lines_move_once_each(spark):
    lines = _pairs(spark, "-await f(1)", "-await f(1)", "+await f(1)", "+f(1)")
    got = [(r.line_number, r.new_line_number, r.keyword) for r in L.replaced_keywords(lines, S.KEYWORDS).collect()]
    assert got == [(2, 2, "await")]


@pytest.mark.parametrize("n", [1, 399, 1000])
def test_long_blocks_are_aligned_part_by_part(n):
    parts = list(L._parts(n, 2 * n, L.SPAN))
    assert [i for a, _ in parts for i in range(n)[a]] == list(range(n)) and [j for _, b in parts for j in range(2 * n)[b]] == list(range(2 * n))
    assert all(a.stop - a.start <= L.SPAN and b.stop - b.start <= L.SPAN for a, b in parts)
