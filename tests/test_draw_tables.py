"""Extinction tables are made where a draw meets its rows and are never dealt to tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outspan.operators import quiet

H, N = 0.2, 150


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def drawn(spark, many=60):
    rng = np.random.default_rng(4)
    # Every third draw has the key of draw 0; 9 has neither seeds nor parents, 100 has no draw.
    own = {i: (2.5, 0.5, 0.4, 2, 3.0) if i % 3 == 0 else (float(rng.uniform(0.5, 6)), float(rng.uniform(0.2, 3)), float(rng.uniform(0.1, 1)), int(rng.integers(1, 4)), float(rng.uniform(1, 6))) for i in range(many)}
    draws = spark.createDataFrame([(i, *x) for i, x in own.items()], "traj_id long, R0 double, k double, r double, alpha long, theta double")
    ids = [i for i in (*range(many), 100) if i != 9]
    return own, draws, ids, rng


def table(R, k, alpha, theta):
    return quiet.extinction(np.array([round(R, 6)]), np.array([round(k, 6)]), np.array([float(alpha)]), np.array([round(theta, 6)]), N, H)[0]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(quiet, "DRAWS", 7)
    monkeypatch.setattr(quiet, "ROWS", 11)


def test_parents(spark, small):
    """Chances of each draw are products over its parents, whatever the batches, and the plan deals draws and parents once."""
    own, draws, ids, rng = drawn(spark)
    rows = [(i, float(t), j == 0, int(n)) for i in ids for j, (t, n) in enumerate(zip(rng.uniform(0, 14, i % 5 + 1), rng.integers(0, 4, i % 5 + 1), strict=True))]
    parents = spark.createDataFrame([*rows, (None, 1.0, False, 0)], "traj_id long, t double, is_root boolean, n_pre long")
    got = quiet.rb_uncond(parents, draws, [0.0, 4.0], 12.0)
    assert exchanges(got) == 1
    want = {}
    for i in own:
        R0, k, r, a, th = own[i]
        tab = table(r * R0, k, a, th)
        for T in (0.0, 4.0):
            logs = 0.0
            mine = [x for x in rows if x[0] == i and x[1] <= 12]
            for _, t, root, n in mine:
                steps, age = int(round(T / H)), 12 - t
                f = quiet.gamma_pdf_np(age + H * np.arange(1, steps + 1), a, th) * H
                psi = 1 - quiet.gamma_cdf_np(age + T, a, th) + (f * (1 - tab[:steps])[::-1]).sum()
                b = k / (R0 if root else r * R0) + quiet.gamma_cdf_np(age, a, th)
                logs += (k + n) * np.log(b / (b + psi))
            if mine:
                want[i, T] = pytest.approx(float(np.exp(logs)), abs=1e-6)
    assert {(r["traj_id"], r["T"]): r["g"] for r in got.collect()} == want and len(want) > 60


def test_seeds(spark, small):
    """Draws without seeds count as over; the plan deals draws and seeds once, and then one row a batch and time."""
    own, draws, ids, rng = drawn(spark)
    edges = [(i, float(p), float(p + c)) for i in ids for p, c in zip(rng.uniform(0, 14, i % 4), rng.uniform(0, 9, i % 4), strict=True)]
    grid = spark.createDataFrame([(0.0,), (3.0,), (8.1,), (3.0,)], "T double")
    got = quiet.seed_uncond(draws, spark.createDataFrame(edges, "traj_id long, parent_t double, child_t double"), grid, 12.0)
    assert exchanges(got) == 2
    for row in got.collect():
        g = []
        for i, (R0, k, r, a, th) in own.items():
            seeds = [c for j, p, c in edges if j == i and p <= 12 < c]
            x = np.maximum(12 + row["T"] - np.array(seeds), 0.0)
            v = np.interp(x, H * np.arange(N + 1), table(r * R0, k, a, th))
            g.append(0.0 if seeds and 12 + row["T"] < max(seeds) else np.prod(v))
        assert row["p"] == pytest.approx(np.mean(g), abs=1e-6)
    assert got.count() == 3


def test_no_rows(spark):
    _, draws, _, _ = drawn(spark, 4)
    none = spark.createDataFrame([], "traj_id long, parent_t double, child_t double")
    assert [r["p"] for r in quiet.seed_uncond(draws, none, spark.range(2).select(F.col("id").cast("double").alias("T")), 1.0).collect()] == [1.0, 1.0]


def test_compared_estimators_hold_no_tables(spark):
    """No step of the comparison carries a draw's table of extinction by age."""
    from conftest import SF

    from outspan.plans import catalog

    plan = catalog.QUERIES["p23_compare_estimators"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "g#" in plan and "H#" not in plan
