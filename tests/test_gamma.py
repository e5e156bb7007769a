"""Column versions of the gamma distribution against NumPy and closed forms, over shapes from 0.01 to 10,000."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from outspan.functions import special as S

SHAPES = [0.01, 0.1, 0.5, 1.0, 2.0, 3.0, 5.0, 7.5, 10.0, 15.0, 20.0, 50.0, 300.0, 10_000.0]
SCALES = [0.5, 1.0, 5.0]


@pytest.fixture(scope="module")
def grid(spark):
    """Points around the mean, in both tails and at the switch between the two expansions."""
    rows = []
    for a in SHAPES:
        for th in SCALES:
            for f in (1e-6, 0.01, 0.3, 0.9, 1 - 1e-9, 1.0, 1.1, 2.0, 6.0, 50.0):
                rows += [(f * (a + 1) * th, a, th)]
    return spark.createDataFrame([*rows, (0.0, 2.0, 1.0), (-1.0, 2.0, 1.0), (float("inf"), 2.0, 1.0)], "x double, a double, th double")


def test_distribution_and_density(grid):
    got = grid.select("x", "a", "th", S.gamma_cdf_native("x", "a", "th").alias("F"), S.gamma_pdf("x", "a", "th").alias("f"), S.log_gamma("a").alias("lg")).toPandas()
    x, a, th = (got[c].to_numpy() for c in ("x", "a", "th"))
    assert got["F"].to_numpy() == pytest.approx(S.gamma_cdf_np(x, a, th), abs=1e-11)
    ok = np.isfinite(x)
    assert got["f"][ok].to_numpy() == pytest.approx(S.gamma_pdf_np(x[ok], a[ok], th[ok]), rel=1e-9, abs=1e-12)
    assert got["lg"].to_numpy() == pytest.approx([math.lgamma(v) for v in a], rel=1e-13, abs=1e-12)
    assert got["F"].between(0, 1).all()


def test_erlang(spark):
    """Whole shapes have a finite sum."""
    df = spark.range(400).select((F.col("id") * 0.1).alias("x"), ((F.col("id") % 9) + 1).cast("double").alias("a"), F.lit(1.7).alias("th"))
    for r in df.select("x", "a", S.gamma_cdf_native("x", "a", "th").alias("F")).collect():
        z = r["x"] / 1.7
        assert r["F"] == pytest.approx(1 - math.exp(-z) * sum(z**i / math.factorial(i) for i in range(int(r["a"]))), abs=1e-12)


def test_quantiles(spark):
    """The distribution of the quantile is the level, far into both tails."""
    levels = [1e-9, 1e-4, 0.025, 0.25, 0.5, 0.75, 0.975, 0.9999, 1 - 1e-9]
    df = spark.createDataFrame([(q, a, 3.0) for q in levels for a in SHAPES if a >= 0.1], "q double, a double, th double")
    got = df.select("q", "a", "th", S.gamma_quantile_native("q", "a", "th").alias("x")).toPandas()
    back = S.gamma_cdf_np(got["x"].to_numpy(), got["a"].to_numpy(), got["th"].to_numpy())
    tail = np.minimum(got["q"], 1 - got["q"])
    assert (np.abs(back - got["q"]) < 1e-9 * np.maximum(tail, 1e-4)).all(), got[np.abs(back - got["q"]) >= 1e-9 * np.maximum(tail, 1e-4)].assign(back=back[np.abs(back - got["q"]) >= 1e-9 * np.maximum(tail, 1e-4)])
    ends = spark.createDataFrame([(0.0, 2.0, 1.0), (1.0, 2.0, 1.0)], "q double, a double, th double").select(S.gamma_quantile_native("q", "a", "th").alias("x")).collect()
    assert [r["x"] for r in ends] == [0.0, float("inf")]


def test_missing_values(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0), (1.0, None, 1.0), (1.0, 1.0, None), (1.0, 1.0, 0.0)], "x double, a double, th double")
    assert all(r["F"] is None for r in df.select(S.gamma_cdf_native("x", "a", "th").alias("F")).collect()[:3])
    nan = spark.createDataFrame([(float("nan"), 1.0, 1.0), (1.0, float("nan"), 1.0), (1.0, -1.0, 1.0)], "x double, a double, th double")
    assert all(math.isnan(r["F"]) for r in nan.select(S.gamma_cdf_native("x", "a", "th").alias("F")).collect())
    assert nan.limit(0).select(S.gamma_cdf_native("x", "a", "th")).count() == 0


def test_no_python_in_plans(spark):
    """The estimators take the native distribution as they take the other, with the same rows."""
    from outspan.operators import quiet

    parents = spark.createDataFrame([(1, 0, 0.0, True, 2), (1, 1, 3.0, False, 0), (2, 2, 1.0, True, 1)], "traj_id long, parent_id long, t double, is_root boolean, n_pre long")
    draws = spark.createDataFrame([(1, 2.0, 0.5, 0.4, 2.5, 3.0), (2, 1.1, 4.0, 0.9, 0.7, 2.0)], "traj_id long, R0 double, k double, r double, alpha double, theta double")
    grid = spark.createDataFrame([(0.0,), (3.0,), (9.0,)], "T double")
    for f in (
        lambda cdf: quiet.rao_blackwell(parents, draws, grid, 5.0, True, cdf).orderBy("traj_id", "T").select("g_inf", "g_quiet"),
        lambda cdf: quiet.lineage_quiet(draws, parents.select("traj_id", F.col("t").alias("parent_t")), grid, 5.0, cdf=cdf).orderBy("traj_id", "T").select("g"),
    ):
        native, other = f(S.gamma_cdf_native), f(S.gamma_cdf)
        assert "Python" not in native._jdf.queryExecution().optimizedPlan().toString()
        assert [pytest.approx(list(r), abs=1e-11) for r in other.collect()] == [list(r) for r in native.collect()]
