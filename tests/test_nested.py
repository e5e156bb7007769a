"""Statistics over nested sets against plain loops: hot keys, ties, nulls, ends on a point, empty tables, points that none reaches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outspan.operators import curves, nested, quiet

INF = float("inf")
POINTS = [0.0, 1.0, 2.5, 4.0, 90.0]


def _rows():
    rng = np.random.default_rng(11)
    end = lambda: None if rng.random() < 0.2 else float(rng.choice([1.0, 2.5, rng.exponential(3)]))
    out = [("hot", i, end(), float(x)) for i, x in enumerate(rng.lognormal(0, 3, 600))]
    out += [("ties", i, end(), float(x)) for i, x in enumerate(rng.integers(0, 4, 200))]
    out += [("short", i, float(rng.random()), float(rng.normal())) for i in range(30)]
    return out + [("one", 0, None, 7.0), ("odd", 0, 3.0, None), ("odd", 1, None, INF), ("odd", 2, 2.0, -INF), ("odd", 3, 2.6, -1.0), ("null", 0, 5.0, None), (None, 0, 5.0, 1.0), (None, 1, 0.5, 3.0)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(_rows(), "k string, traj_id long, first_post double, x double")


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(t,) for t in [*POINTS, 1.0]], "T double")


def _alive(key, T):
    return [r for r in _rows() if r[0] == key and (r[2] is None or r[2] > T)]


def test_timepath(rows, grid):
    got = {(r["k"], r["T"]): r for r in curves.timepath(rows, ["x"], grid, (0.0, 0.05, 0.5, 0.95, 1.0), keys=("k",)).collect()}
    want = {(k, T) for k in {r[0] for r in _rows()} for T in POINTS if _alive(k, T)}
    assert set(got) == want and {r["metric"] for r in got.values()} == {"x"}
    for (k, T), r in got.items():
        alive = _alive(k, T)
        x = np.sort([v[3] for v in alive if v[3] is not None])
        assert r["n"] == len(alive)
        for p in (0.0, 0.05, 0.5, 0.95, 1.0):
            name = f"q{round(p * 1000):03d}"
            if not len(x):
                assert r[name] is None
            elif k != "odd":
                assert r[name] == pytest.approx(np.percentile(x, 100 * p), rel=1e-12, abs=1e-12)
            elif p in (0.0, 1.0):
                assert r[name] == x[0 if p == 0 else -1]


def test_points_by_key(spark, rows):
    """A grid with the key has points of its own for each; keys without any have no rows."""
    own = spark.createDataFrame([("hot", 0.5), ("hot", 3.0), ("ties", 1.0), ("absent", 1.0)], "k string, T double")
    got = {(r["k"], r["T"], r["n"]) for r in curves.timepath(rows, ["x"], own, keys=("k",)).collect()}
    assert got == {(k, T, len(_alive(k, T))) for k, T in (("hot", 0.5), ("hot", 3.0), ("ties", 1.0))}


def test_conditional_shares(rows, grid):
    got = {(r["k"], r["T"]): (r["over"], r["n"]) for r in quiet.cond_from_first(rows, grid, ("k",)).collect()}
    assert got == {(k, T): (sum(r[2] is None for r in _alive(k, T)), len(_alive(k, T))) for k in {r[0] for r in _rows()} for T in POINTS}


def test_unconditional_shares(spark, grid):
    ids = spark.createDataFrame([(i,) for i in range(5)], "traj_id long")
    ev = spark.createDataFrame([(0, 9.0), (1, 11.0), (1, 3.0), (2, 12.5), (3, 500.0)], "traj_id long, t double")
    got = {r["T"]: r["p"] for r in quiet.empirical_uncond(ids, ev, grid, 10.0).collect()}
    assert got == pytest.approx({0.0: 0.4, 1.0: 0.6, 2.5: 0.8, 4.0: 0.8, 90.0: 0.8})


def test_cond_cumulative(spark):
    ids = range(40)
    rng = np.random.default_rng(3)
    ev = [(i, float(t)) for i in ids if i % 5 for t in rng.integers(5, 30, 4) / 2.0]
    first = [(i, min((t - 5 for j, t in ev if j == i and t > 5), default=None)) for i in ids]
    Ts = [0.0, 0.5, 2.0, 50.0]
    out = curves.cond_cumulative(spark.createDataFrame(first, "traj_id long, first_post double"), spark.createDataFrame(ev, "traj_id long, t double"), 5.0, spark.createDataFrame([(t,) for t in Ts], "T double"), 0.0, 1.0, 6)
    got = {(r["T"], r["g"]): (r["n"], r["mean"]) for r in out.collect()}
    for T in Ts:
        alive = {i for i, f in first if f is None or f > T}
        for g in range(6):
            assert got[T, float(g)] == (len(alive), pytest.approx(sum(i in alive and 5 < t <= 5 + g for i, t in ev) / len(alive)))


def test_empty(rows, grid):
    none = rows.limit(0)
    assert curves.timepath(none, ["x"], grid).count() == 0 and quiet.cond_from_first(none, grid).count() == 0
    assert curves.timepath(rows, ["x"], grid.limit(0)).count() == 0


def test_rows_are_not_repeated(rows, grid):
    """No generator stands above the rows: only sums by bucket are spread over the points."""
    plan = curves.timepath(rows, ["x"], grid, keys=("k",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and "explode(__ts" not in plan.replace("posexplode(__ts", "")
    reached = nested.reach(rows, grid, lambda T: F.col("first_post") > T)
    assert reached.count() == len(_rows())
