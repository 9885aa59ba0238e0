"""Heritability against values of an independent least-squares computation, and properties of the algebra."""

from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ldlake.functions.columns import probit, with_probit
from ldlake.stats import distributions, jackknife, regression

def study(seed, n):
    """LD scores, weights, sample sizes and chi2 of a simulated trait."""
    rng = np.random.default_rng(seed)
    ld, size = rng.gamma(2.0, 8.0, n) + 0.2, rng.integers(900, 1400, n).astype(float)
    z = rng.normal(size=n) * np.sqrt(1.1 + 0.6 * size * ld / 1000)
    return ld, rng.uniform(0.5, 12, n), size, z * z


def plain_h2(ld, w_ld, size, chi2, m, blocks, step=None, fixed=None):
    """(h2, se, intercept, intercept se) by lstsq of weighted rows, once for each block that is left out."""

    def weight(h2, a, scores=ld):
        var = a + np.clip(h2, 0, 1) * size / m * np.maximum(scores, 1)
        return 1 / (2 * var**2) / np.maximum(w_ld, 1)

    def fitted(x, y, w):
        return np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]

    def jack(x, y, start, update, at):
        w = start
        for _ in range(2):
            w = update(fitted(x, y, w))
        whole = fitted(x, y, w)
        left_out = np.array([fitted(x[at != b], y[at != b], w[at != b]) for b in range(blocks)])
        pseudo = blocks * whole - (blocks - 1) * left_out
        return whole, left_out, pseudo

    n, mean = chi2.size, size.mean()
    at = np.searchsorted([k * n // blocks for k in range(1, blocks)], np.arange(n), side="right")
    x = size * ld / mean
    begin = 1.0 if fixed is None else fixed
    w0 = weight(m * (chi2.mean() - begin) / (ld * size).mean(), begin)
    error = lambda p: p.std(0, ddof=1) / blocks**0.5
    if fixed is not None:
        est, _, pseudo = jack(x[:, None], chi2 - fixed, w0, lambda c: weight(m * c[0] / mean, fixed), at)
        return m * est[0] / mean, m * error(pseudo)[0] / mean, fixed, None
    both = np.stack([x, np.ones(n)], 1)
    if step is None:
        est, _, pseudo = jack(both, chi2, w0, lambda c: weight(m * c[0] / mean, c[1]), at)
        e = error(pseudo)
        return m * est[0] / mean, m * e[0] / mean, est[1], e[1]
    small = np.flatnonzero(chi2 < step)
    borders = [small[k * small.size // blocks] for k in range(1, blocks)]
    moved = np.searchsorted(borders, np.arange(n), side="right")

    def part(c):  # the first step's new weights go by the regressor, scaled by sample size
        return weight(m * c[0] / mean, c[1], x)[small]

    first, out1, _ = jack(both[small], chi2[small], w0[small], part, moved[small])
    second, out2, _ = jack(x[:, None], chi2 - first[1], w0, lambda c: weight(m * c[0] / mean, first[1]), moved)
    c = (w0 * x).sum() / (w0 * x * x).sum()
    left_out = np.stack([out2[:, 0] - c * (out1[:, 1] - first[1]), out1[:, 1]], 1)
    est = np.array([second[0], first[1]])
    e = error(blocks * est - (blocks - 1) * left_out)
    return m * est[0] / mean, m * e[0] / mean, est[1], e[1]


@pytest.mark.parametrize("seed,n,blocks", [(1, 60, 12), (2, 200, 50), (3, 31, 31)])
def test_heritability(spark, seed, n, blocks):
    ld, w_ld, size, chi2 = study(seed, n)
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(ld, w_ld, size, chi2))]
    df = spark.createDataFrame(rows, "_i long, L2 double, w_l2 double, N double, chi2 double").cache()
    for step, fixed in ((None, None), (30.0, None), (None, 1.0), (None, 0.8)):
        h = regression.heritability(df, ["L2"], [1000.0], blocks, step=step, intercept=fixed)
        want = plain_h2(ld, w_ld, size, chi2, 1000.0, blocks, step, fixed)
        for a, b in zip((h.h2, h.se, h.intercept, h.intercept_se), want):
            assert b is None or abs(a - b) < 1e-7 * max(1, abs(b))


def test_probit(spark):
    ps = [1.0, 0.5, 0.05, 1e-3, 1e-10, 1e-100, 1e-300]
    df = spark.createDataFrame([(p,) for p in ps], "P double")
    got = [r[0] for r in df.select(probit("P")).collect()]
    assert [r["z"] for r in with_probit(df, "P", "z").collect()] == got
    assert np.allclose(got, [abs(NormalDist().inv_cdf(p / 2)) for p in ps], rtol=1e-14, atol=1e-15)


@given(st.integers(1, 2000), st.integers(1, 200))
def test_blocks_are_separators(n, b):
    want = np.searchsorted([k * n // b for k in range(1, b)], np.arange(n), side="right") if b > 1 else np.zeros(n, int)
    assert [((i + 1) * b - 1) // n for i in range(n)] == list(want) or b > n


def test_block_of(spark):
    got = [r[0] for r in spark.range(103).select(regression.block_of(F.col("id"), 103, 10)).collect()]
    assert got == [((i + 1) * 10 - 1) // 103 for i in range(103)]


def test_jackknife_of_a_mean():
    y = np.random.default_rng(1).normal(size=40)
    jk = jackknife.from_block_sums(np.ones((40, 1, 1)), y[:, None])
    assert np.allclose(jk.est, y.mean()) and np.allclose(jk.se, y.std(ddof=1) / 40**0.5)


def test_distributions():
    assert abs(distributions.student_t_sf(2.0, 10) - 0.036694) < 1e-6
    assert abs(distributions.chi2_1_sf(3.841458820694124) - 0.05) < 1e-12
    assert abs(distributions.normal_sf(1.959963984540054) - 0.025) < 1e-12


def test_correlation_of_a_trait_with_itself(spark):
    rng = np.random.default_rng(3)
    ld = rng.uniform(1, 50, 3000)
    z = rng.normal(size=3000) * np.sqrt(1 + 0.5 * 10000 / 3000 * ld / 5)
    rows = [(i, float(a), float(a), 10000.0, 10000.0, float(b), 1.0) for i, (a, b) in enumerate(zip(z, ld))]
    df = spark.createDataFrame(rows, "_i long, Z1 double, Z2 double, N1 double, N2 double, L2 double, w_l2 double").cache()
    c = regression.correlation(df, ["L2"], [3000.0], 50)
    assert c.status == "ok" and abs(c.rg - 1) < 0.02


def test_m():
    assert regression.resolve_m(None, None, 7) == [7.0]
    assert regression.resolve_m(5, [9], 7) == [5.0]
    assert regression.resolve_m(5, [9, 8], 7, 2) == [9.0, 8.0]
    with pytest.raises(ValueError):
        regression.resolve_m(None, [1], 7, 2)
