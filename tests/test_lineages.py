"""Lineage methods, surrogates, kernels, bands and densities against loops over draws in NumPy."""

import math

import numpy as np
import pandas as pd
import pytest

from outspan.functions.special import gamma_cdf_np, gamma_pdf_np, lower_gamma, thinned_gamma_cdf, weibull_thinned_np
from outspan.operators import quiet, stats

STAR = 10.0
DRAWS = [(1, 2.0, 0.5, 0.5, 2.0, 3.0), (2, 1.2, 3.0, 0.9, 1.0, 5.0), (3, 6.0, 0.3, 0.2, 3.5, 1.1), (4, 1.5, 1.0, 0.4, 0.6, 4.0), (5, 3.0, 2.0, 0.5, 2.0, 2.0)]
ACTIVE = [(1, 0.0), (1, 7.5), (1, 7.5), (2, 10.0), (2, 9.0), (3, 1.0), (3, 8.0), (4, 9.5), (4, 3.0)]  # draw 5 has none
TIMES = [0.0, 1.0, 4.0, 15.0]


@pytest.fixture(scope="module")
def tables(spark):
    draws = spark.createDataFrame(DRAWS, "traj_id long, R0 double, k double, r double, alpha double, theta double")
    act = spark.createDataFrame(ACTIVE, "traj_id long, parent_t double")
    return draws, act, spark.createDataFrame([(x,) for x in TIMES], "T double")


def F(x, a, th):
    return gamma_cdf_np(np.asarray(x, float), np.full(np.shape(x), a), np.full(np.shape(x), th))


def ages(i):
    return STAR - np.array(sorted({t for j, t in ACTIVE if j == i}))


@pytest.mark.parametrize("effective", [True, False])
def test_lineage_quiet(tables, effective):
    draws, act, grid = tables
    for method in ("ev", "size_only"):
        got = {(r["traj_id"], r["T"]): r["g"] for r in quiet.lineage_quiet(draws, act, grid, STAR, method, effective=effective).collect()}
        for i, R0, k, r, a, th in DRAWS:
            c, age = (R0 * r if effective else R0) / k, ages(i)
            for T in TIMES:
                if not len(age):
                    want = 1.0
                elif method == "ev":
                    s = np.maximum(age - a * th, 0)
                    want = np.prod(((1 + c * (1 - F(s, a, th))) / (1 + c * (F(s + T, a, th) - F(s, a, th)))) ** -k)
                else:
                    want = float(((1 + c) / (1 + c * F([T], a, th)[0])) ** (-k * len(age)))
                assert got[i, T] == pytest.approx(min(1, want), abs=1e-12)


def surrogate(method, horizon, rho=3.0):
    """log S at the grid and at the horizon of each draw, then the mixture."""
    end = np.inf if horizon is None else horizon
    num, den = 0.0, np.zeros(len(TIMES))
    t = np.array([*TIMES, end])
    for i, R0, k, r, a, th in DRAWS:
        age, R = ages(i), R0 * r
        if not len(age):
            hazard = np.zeros(len(t))
        else:
            at = np.maximum(age, 1e-12) if a < 1 else age
            fa = np.where(at > 0, gamma_pdf_np(at, a, th), 1 / th if a == 1 else 0.0)
            q = [1 - lower_gamma(np.full(len(at), a + j), at / th) for j in range(3)]
            A, h0 = k * np.log(1 + R / k * q[0]).sum(), R * fa.sum()
            slope = np.where(at > 0, fa * ((a - 1) / np.where(at > 0, at, 1) - 1 / th), -fa / th)
            h1 = R * slope.sum() - R * R / k * (fa**2).sum()
            hazard = A * (1 - np.exp(-h0 / A * t))
            if method == "exact":
                hazard = np.array([k * np.log(1 + R / k * (F(at + min(x, 1e9), a, th) - F(at, a, th))).sum() for x in t])
            elif method == "two_exp":
                disc = (h0 * (rho + 1)) ** 2 + 4 * rho * A * h1
                if disc >= 0:
                    b = (h0 * (rho + 1) + math.sqrt(disc)) / (2 * rho * A)
                    w2 = -(h0 + h1 / b) / (rho - 1)
                    w1 = h0 - w2
                    if w1 > 0 and w2 > 0:
                        hazard = w1 / b * (1 - np.exp(-b * t)) + w2 / (rho * b) * (1 - np.exp(-rho * b * t))
            elif method == "gamma_moment":
                # Moments by quadrature of the hazard's integral over waiting times.
                u = np.linspace(0, 400, 400_001)
                f = sum(gamma_pdf_np(x + u, a, th) for x in np.maximum(at, 1e-9))
                m1, m2 = (R * np.trapezoid(u**n * f, u) for n in (1, 2))
                mean = m1 / A
                var = max(m2 / A - mean * mean, 1e-12)
                shape, scale = mean * mean / var, max(var / mean, 1e-9)  # of draw 3 the variance falls to its floor
                hazard = A * np.append(F(t[:-1], shape, scale), 1.0 if horizon is None else F([horizon], shape, scale)[0])
        num, den = num + np.exp(-hazard[-1]), den + np.exp(-hazard[:-1])
    return np.clip(num / den, 0, 1)


@pytest.mark.parametrize("horizon", [None, 30.0])
@pytest.mark.parametrize("method", ["exact", "gompertz", "two_exp", "gamma_moment"])
def test_surrogates(tables, method, horizon):
    draws, act, grid = tables
    got = {r["T"]: r["p"] for r in quiet.first_after_surrogate(draws, act, grid, STAR, method, horizon).collect()}
    want = surrogate(method, horizon)
    assert [got[t] for t in TIMES] == pytest.approx(list(want), abs=2e-6 if method == "gamma_moment" else 1e-9)


def test_two_decays_differ_from_one(tables):
    """Some draw has weights of both decays above 0, so that the fallback isn't all that is tested."""
    assert np.abs(surrogate("two_exp", None) - surrogate("gompertz", None)).max() > 1e-4
    draws, act, grid = tables
    with pytest.raises(ValueError, match="rho"):
        quiet.first_after_surrogate(draws, act, grid, STAR, "two_exp", rho=1.0)


def test_surrogates_without_rows(spark, tables):
    draws, act, grid = tables
    for method in ("gompertz", "two_exp", "gamma_moment"):
        none = quiet.first_after_surrogate(draws, act.limit(0), grid, STAR, method).collect()
        assert len(none) == len(TIMES) and all(r["p"] == 1 for r in none)
        assert quiet.first_after_surrogate(draws.limit(0), act, grid, STAR, method).count() == 0


@pytest.mark.parametrize("a,th,rate,shape", [(2.0, 3.0, 0.05, 1.5), (0.3, 4.0, 0.1, 0.7), (20.0, 1.0, 0.05, 4.0), (1.0, 2.0, 0.2, 1.0)])
def test_weibull_kernel(a, th, rate, shape):
    """Against a fine sum, at the end the share that is not removed; alone as beside any other row."""
    x = np.array([0.0, 0.01, 1.0, 6.0, 25.0, 5000.0])
    got = weibull_thinned_np(x, a, th, rate, shape)
    for xi, g in zip(x, got, strict=True):
        # Even steps of the logarithm take the pole at 0 away.
        u = np.geomspace(1e-40, max(min(xi, th * (a + 12 * math.sqrt(a) + 60)), 1e-39), 400_000)
        y = np.exp(a * np.log(u / th) - u / th - (u * rate) ** shape) / math.gamma(a)
        assert g == pytest.approx(np.trapezoid(y, np.log(u)), abs=1e-6)
    assert got[-1] < 1
    if shape == 1:
        assert got == pytest.approx(F(x, a, th / (1 + rate * th)) * (1 + rate * th) ** -a, abs=1e-12)
    cdf = thinned_gamma_cdf("weibull", rate, shape).func
    alone = [cdf(pd.Series([xi]), pd.Series([a]), pd.Series([th]))[0] for xi in x]
    both = cdf(pd.Series([*x, 3.0, np.nan]), pd.Series([*[a] * len(x), 5.0, 1.0]), pd.Series([*[th] * len(x), 9.0, 1.0]))
    assert alone == both[: len(x)].tolist() and np.isnan(both.iloc[-1])


def tail_band(v, w, p):
    v, w = (np.asarray(x, float) for x in (v, w))
    o = np.argsort(v)
    v, w = v[o], w[o]
    c, total, mean = np.cumsum(w), w.sum(), (v * w).sum() / w.sum()
    lo, hi = c <= (1 - p) / 2 * total, c >= total - (1 - p) / 2 * total
    lo[0], hi[-1] = lo[0] or not lo.any(), True
    of = lambda m: (v[m] * w[m]).sum() / w[m].sum()
    return mean, mean + p**0.7 * (of(lo) - mean), mean + p**0.7 * (of(hi) - mean)


def test_weighted_tail_mean_band(spark):
    rng = np.random.default_rng(3)
    cases = {1: (list(range(1, 101)), [1.0] * 100), 2: (rng.normal(size=37).tolist(), rng.uniform(size=37).tolist()), 3: ([5.0], [2.0]), 4: ([1.0, 2.0], [9.0, 1.0])}
    df = spark.createDataFrame([(k, float(x), y) for k, (v, w) in cases.items() for x, y in zip(v, w, strict=True)], "g long, v double, w double")
    for p in (0.5, 0.9):
        got = {r["g"]: (r["mean"], r["lo"], r["hi"]) for r in stats.weighted_tail_mean_band(df, ["g"], "v", "w", p).collect()}
        for k, (v, w) in cases.items():
            assert got[k] == pytest.approx(tail_band(v, w, p), abs=1e-9)
    assert stats.weighted_tail_mean_band(df.filter("g = 1"), ["g"], "v", "w", 0.9).first()["hi"] == pytest.approx(94.16, abs=0.01)


def test_bounded_densities(spark):
    """Mirrored samples take their own bandwidth; truncated kernels have area 1 inside the bounds."""
    rng = np.random.default_rng(6)
    x, grid, (lo, hi) = np.concatenate([rng.uniform(0, 15, 300), [0.0, 15.0]]), np.arange(-2, 18.5, 0.5), (0.0, 15.0)
    df = spark.createDataFrame([(1, float(v)) for v in x], "g long, v double")
    g = spark.createDataFrame([(float(v),) for v in grid], "x double")
    inside = (grid >= lo) & (grid <= hi)

    def norm(y):
        y = np.where(inside, y, 0.0)
        return y / np.trapezoid(y[inside], grid[inside])

    gauss = lambda s, h, w=1.0: (np.exp(-0.5 * ((grid[:, None] - s) / h) ** 2) * w).sum(1)
    near = 0.4 * (x.max() - x.min())
    m = np.concatenate([x, (2 * lo - x)[2 * lo - x > lo - near], (2 * hi - x)[2 * hi - x < hi + near]])
    h = x.std(ddof=1) * len(x) ** -0.2
    phi = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))))
    want = {"reflect": norm(gauss(m, m.std(ddof=1) * len(m) ** -0.2)), "truncate": norm(gauss(x, h, 1 / (phi((hi - x) / h) - phi((lo - x) / h))))}
    for method, y in want.items():
        got = {r["x"]: r["density"] for r in stats.kde(df, ["g"], "v", g, bounds=(lo, hi), method=method).collect()}
        d = np.array([got[v] for v in grid])
        assert d == pytest.approx(y, abs=1e-9) and np.trapezoid(d[inside], grid[inside]) == pytest.approx(1) and not d[~inside].any()


def test_silverman_falls_back(spark):
    df = spark.createDataFrame([(1, 2.0)] * 9 + [(1, 5.0)] + [(2, 1.0)] * 4, "g long, v double")
    got = {r["g"]: r["bw"] for r in stats.bandwidth(df, ["g"], "v", "silverman").collect()}
    assert got[1] == pytest.approx(0.9 * np.std([2.0] * 9 + [5.0]) * 10**-0.2) and got[2] == pytest.approx(0.9 * 4**-0.2)
