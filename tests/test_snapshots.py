"""Curves of all snapshots in one plan against one call a snapshot, with uneven cutoffs, ties on them and times of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outspan.operators import criteria, quiet

SNAPS = [(7, 2.0), (3, 2.5), (1, 4.0), (9, 4.0), (5, -1.0), (2, 60.0)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(8)
    parents = [(i, 10 * i + j, float(t)) for i in range(12) for j, t in enumerate(np.sort(rng.integers(0, 12, 3) / 2.0))]
    edges = [(i, p, t, float(t + rng.integers(0, 8) / 2.0), 100 * p + c) for i, p, t in parents for c in range(int(rng.integers(0, 4)))]
    draws = [(i, 1.5 + i / 10, 0.4, 0.7, float(1 + i % 4), 1.0 + i / 5) for i in range(11)]  # the last trajectory has no draw
    return (
        criteria.mark_roots(spark.createDataFrame(parents, "traj_id long, parent_id long, t double"), "parent_id"),
        spark.createDataFrame(edges, "traj_id long, parent_id long, parent_t double, child_t double, child_id long"),
        spark.createDataFrame(draws, "traj_id long, R0 double, k double, r double, alpha double, theta double"),
        spark.createDataFrame(SNAPS, "snap_id long, t_star double"),
    )


def test_parents(tables):
    parents, edges, _, snaps = tables
    got = {(r["snap_id"], r["parent_id"]): r["n_pre"] for r in quiet.snapshot_parents(parents, edges, snaps).collect()}
    for snap, star in SNAPS:
        want = {r["parent_id"]: r["n_pre"] for r in quiet.pre_children(parents, edges, star).filter(F.col("t") <= star).collect()}
        assert {p: n for (s, p), n in got.items() if s == snap} == want


@pytest.mark.parametrize("posterior", [True, False])
def test_curves(spark, tables, posterior):
    parents, edges, draws, snaps = tables
    grid = spark.createDataFrame([(0.0,), (1.5,), (9.0,)], "T double")
    got = {(r["snap_id"], r["T"]): (r["t_star"], r["n"], r["p"]) for r in quiet.snapshot_curves(parents, edges, draws, snaps, grid, posterior).collect()}
    want = {}
    for snap, star in SNAPS:
        one = quiet.rb_cond_curve(quiet.rao_blackwell(quiet.pre_children(parents, edges, star), draws, grid, star, posterior))
        want |= {(snap, r["T"]): (star, r["n"], pytest.approx(r["p"], rel=1e-12)) for r in one.collect()}
    assert got == want and (5, 0.0) not in got


def test_own_times(spark, tables):
    parents, edges, draws, snaps = tables
    all_times = spark.createDataFrame([(0.0,), (1.5,), (9.0,)], "T double")
    own = spark.createDataFrame([(7, 0.0), (7, 9.0), (2, 1.5), (100, 0.0)], "snap_id long, T double")
    rows = lambda g: {(r["snap_id"], r["T"]): r["p"] for r in quiet.snapshot_curves(parents, edges, draws, snaps, g).collect()}
    full = rows(all_times)
    assert rows(own) == pytest.approx({k: full[k] for k in ((7, 0.0), (7, 9.0), (2, 1.5))}, rel=1e-12)


def test_plan_does_not_grow(spark, tables):
    parents, edges, draws, snaps = tables
    grid = spark.createDataFrame([(0.0,), (1.5,)], "T double")
    size = lambda n: quiet.snapshot_curves(parents, edges, draws, snaps.limit(n), grid)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(1) == size(6)
    assert quiet.snapshot_curves(parents, edges, draws, snaps.limit(0), grid).count() == 0
