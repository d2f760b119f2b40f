import math

import numpy as np
import pytest

from reviewlake.llm import feast
from reviewlake.llm.queries import QUERIES

from .helpers import SF


def brute_force(vectors):
    """x of each usable vector, n, sums, eigenvalues (falling), eigenvectors and trace."""
    xs = {k: tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for k, v in vectors.items()}
    fit = np.array(sorted(set(xs.values())), dtype=np.float64)
    n = len(fit)
    sums = [sum(x[j] for x in set(xs.values())) for j in range(fit.shape[1])]
    centred = fit - np.array(sums) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    return xs, n, sums, values[::-1], axes[:, ::-1], np.trace(cov)


def compare(rows, vectors, components=16):
    xs, n, sums, values, axes, trace = brute_force(vectors)
    k = min(components, len(sums))
    assert len(rows) == k * len(vectors)
    by = {(r.vec_id, r.component): r for r in rows}
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    for c in range(1, k + 1):
        want = {v: float((np.array(x) - np.array(sums) / n) @ axes[:, c - 1] / math.sqrt(values[c - 1])) for v, x in xs.items()}
        top = max(want, key=lambda v: abs(want[v]))
        sign = np.sign(want[top] * by[top, c].whitened)
        for v, x in xs.items():
            r = by[v, c]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert r.whitened == pytest.approx(sign * want[v], abs=1e-7)
            assert r.explained == pytest.approx(values[c - 1] / trace, rel=1e-9)


def test_query_against_brute_force(spark):
    rows = QUERIES["op12_feast_whitening"](spark, SF).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    compare(rows, vectors)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    good = {k: [float(x) for x in rng.standard_normal(5) * [1, 2, 3, 4, 5]] for k in range(30)}
    good[40] = good[41] = good[0]  # repeats count once in the fit
    good[42] = [1e6, -1e6, 3e5, 0.0, 1e-9]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0, 3.0, 4.0]), (53, [1.0, nan, 2.0, 3.0, 4.0]), (54, [inf, 1.0, 2.0, 3.0, 4.0]), (55, [1.0, 2.0]), (56, [1e300, 0.0, 0.0, 0.0, 0.0])]
    rows = [(k, v, 1, 2.0) for k, v in [*good.items(), *bad]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, x double")
    got = feast.whiten(df).collect()
    compare(got, good)
    assert set(got[0].asDict()) == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    assert feast.whiten(df.where("false")).collect() == []
    assert feast.whiten(df.where("vec_id in (0, 40, 50)")).collect() == []  # one distinct vector has no variance
    # a direction without variance is left out, a null id kept
    flat = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 4.0])], "vec_id long, embedding array<float>")
    assert sorted((str(r.vec_id), r.component, r.deviation, abs(r.whitened), r.explained) for r in feast.whiten(flat).collect()) == [("1", 1, 128 ** 2, 1.0, 1.0), ("None", 1, 128 ** 2, 1.0, 1.0)]


def test_deviations_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0 ** 40, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert all(r.deviation is None for r in feast.whiten(df).collect())
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0 ** 24, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    x = [(1_000_000, 1_000_000), (1_000_000 + (1 << 30), 1_000_000), (1_000_000, 1_000_064)]
    s = [sum(c) for c in zip(*x)]
    got = {r.vec_id: r.deviation for r in feast.whiten(df).collect()}
    assert got == {k: sum((3 * a - b) ** 2 for a, b in zip(v, s)) for k, v in enumerate(x)}


def matrices():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 30, 64):
        a = rng.standard_normal((3 * d, d)) * rng.uniform(0.1, 3, d)
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        yield a.T @ a / len(a)
        yield np.eye(d)
        yield np.diag(np.arange(d) // 3 * 1.0)  # equal eigenvalues
        yield (lambda m: (m + m.T) / 2)(q @ np.diag(np.where(np.arange(d) < 3, 5.0, 1e-9)) @ q.T)


@pytest.mark.parametrize("a", list(matrices()), ids=lambda a: str(len(a)))
def test_eigenpairs(a):
    want = np.linalg.eigvalsh(a)[::-1][:16]
    values, axes = feast.largest_eigenpairs(a, 16)
    scale = np.abs(a).max()
    assert np.abs(values - want).max() < 1e-12 * len(a) * scale
    assert np.abs(axes.T @ axes - np.eye(len(want))).max() < 1e-8
    assert np.abs(a @ axes - axes * values).max() < 1e-11 * len(a) * scale
    for cut in (0.3, 1.0001, 2.5):
        assert feast.inertia_below(a, cut) == int((np.linalg.eigvalsh(a) < cut).sum())


def test_a_contour_that_misses_pairs_is_an_error():
    with pytest.raises(ArithmeticError):
        feast.contour_eigenpairs(np.diag([1.0, 2.0, 3.0, 9.0]), 0.5, 3.5, 2)
