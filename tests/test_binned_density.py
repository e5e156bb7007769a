"""Binned densities against the direct sums."""

import numpy as np
import pytest

from outspan.operators import stats


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in rng.normal(5, 2, 4000)] + [("b", float(x)) for x in rng.gamma(1.0, 3.0, 1500)] + [("c", float(x)) for x in rng.integers(0, 5, 500)] + [("c", None)]
    return spark.createDataFrame(rows, "k string, v double")


@pytest.mark.parametrize(
    ("kind", "rule", "bounds", "method"),
    [("gaussian", "scott", None, "none"), ("gaussian", "silverman", None, "none"), ("gaussian", "scott", (0.0, 9.0), "reflect"), ("gaussian", "scott", (0.0, 9.0), "truncate"), ("epanechnikov", "silverman", None, "none")],
)
def test_error(spark, sample, kind, rule, bounds, method):
    grid = spark.range(60).selectExpr("id / 4D - 2 AS x")
    # Outside the bounds a truncated kernel has next to no mass to be divided by, so there the sample is cut first.
    df = sample.filter("k <> 'c' AND v BETWEEN 0 AND 9") if bounds else sample
    rows = lambda **more: {(r["k"], r["x"]): r["density"] for r in stats.kde(df, ["k"], "v", grid, rule, kind, bounds, method, **more).collect()}
    direct, binned = rows(), rows(per_bandwidth=512)
    assert direct.keys() == binned.keys()
    worst = max(abs(direct[k] - binned[k]) for k in direct)
    assert worst < (1e-6 if kind == "gaussian" else 2e-5)
    if kind == "gaussian":  # quadratic: a quarter of the nodes, sixteen times the error
        coarse = rows(per_bandwidth=128)
        assert worst < max(abs(direct[k] - coarse[k]) for k in direct) < 16e-6
