"""Segments against all ways to cut a series, and scores of options against plain counts."""

import itertools
import math

import numpy as np
import pytest

from outspan.model import WindowOptions
from outspan.operators import options as option_rows
from outspan.operators import windows


def chords(x, v, kmax, least):
    """The best score over every choice of cuts for 1 to kmax chords."""
    n, best = len(x), None
    for k in range(1, kmax + 1):
        sse = math.inf
        for cuts in itertools.combinations(range(1, n - 1), k - 1):
            ends = (0, *cuts, n - 1)
            if all(b - a >= least for a, b in itertools.pairwise(ends)):
                error = sum(((v[a : b + 1] - np.linspace(v[a], v[b], b - a + 1)) ** 2).sum() for a, b in itertools.pairwise(ends))
                if error < sse - 1e-12:
                    sse, at = error, ends
        if sse < math.inf:
            score = n * math.log(max(sse / n, 1e-12)) + 2 * k * math.log(n)
            if best is None or score < best[0] - 1e-9:
                best = (score, at)
    return [] if best is None else [(x[a], x[b]) for a, b in itertools.pairwise(best[1])]


@pytest.mark.parametrize("min_seg", [1.0, 3.0])
def test_segments_are_the_best_cuts(spark, min_seg):
    rng = np.random.default_rng(5)
    rows = [(s, float(d), int(rng.integers(1, 9))) for s in range(6) for d in sorted(rng.choice(22, rng.integers(2, 9), replace=False))]
    obs = spark.createDataFrame(rows, "series_id long, d double, n long")
    o = WindowOptions(grid_step_days=1.0, min_seg_days=min_seg)
    got = {}
    for r in windows.segment_windows(obs, o).collect():
        got.setdefault(r["series_id"], []).append((r["a"], r["b"]))
    curve = windows.monotone_interpolant(obs, 1.0).toPandas().sort_values("i")
    for s, own in curve.groupby("series_id"):
        assert sorted(got.get(s, [])) == chords(own["x"].tolist(), own["v"].to_numpy(), o.kmax, max(2, int(min_seg)))


def test_scores_are_counts_of_accepted(spark):
    """Accepted trajectories, distance of mean and observed counts, the surcharge below 80, and the best option of each series."""
    rng = np.random.default_rng(7)
    obs_rows = [(s, float(d), int(n)) for s in (1, 2) for d, n in zip((0, 6, 7, 15), rng.integers(1, 4, 4), strict=True)]
    ev_rows = [(s, i, float(np.round(t, 3))) for s in (1, 2) for i in range(40) for t in rng.uniform(-1, 16, rng.integers(1, 14))]
    obs, ev = spark.createDataFrame(obs_rows, "series_id long, d double, n long"), spark.createDataFrame(ev_rows, "series_id long, traj_id long, t double")
    loose = WindowOptions(strategy="cluster", baseline_p=0.9, h_max=2.0, include_global_total=False)
    options = {0: loose, 1: windows.with_option(loose, baseline_p=0.5), 2: windows.with_option(loose, sigma_days=0.5)}
    want = {}
    for oid, o in options.items():
        win = [(r["series_id"], r["a"], r["b"], r["L"], r["U"]) for r in windows.acceptance_windows(obs, o).collect()]
        for s in (1, 2):
            times = {i: [t for q, j, t in ev_rows if (q, j) == (s, i)] for i in range(40)}
            kept = [i for i, ts in times.items() if all(L <= sum(a <= t <= b for t in ts) <= U for q, a, b, L, U in win if q == s)]
            if kept:
                seen = [(d, sum(n for q, e, n in obs_rows if q == s and e <= d)) for q, d, _ in obs_rows if q == s]
                l2 = np.mean([(y - sum(t <= d for i in kept for t in times[i]) / len(kept)) ** 2 for d, y in seen])
                want[s, oid] = (len(kept), l2 + max(0, 80 - len(kept)) ** 2)
    rows = option_rows.score_options(obs, ev, options).collect()
    scored = spark.createDataFrame(rows)
    assert {(r["series_id"], r["option_id"]): (r["accepted"], pytest.approx(r["objective"])) for r in rows} == want and len(want) >= 2
    for r in option_rows.best_options(scored).collect():
        assert r["objective"] == pytest.approx(min(v[1] for (s, _), v in want.items() if s == r["series_id"]))


def series(spark, seed=3):
    rng = np.random.default_rng(seed)
    obs = [(s, float(d), int(n)) for s in (1, 2, 3) for d, n in zip((0, 6, 7, 15, 19), rng.integers(1, 4, 5), strict=True)]
    ev = [(s, i, float(np.round(t, 3))) for s in (1, 2, 3) for i in range(30) for t in rng.uniform(-1, 20, rng.integers(1, 16))]
    return spark.createDataFrame(obs, "series_id long, d double, n long"), spark.createDataFrame(ev, "series_id long, traj_id long, t double")


def test_windows_of_option_rows_are_those_of_each_option(spark):
    """All strategies and flags in one plan, whose size doesn't depend on the number of options; also options for one series alone."""
    obs, _ = series(spark)
    o = WindowOptions(grid_step_days=1.0)
    some = {
        0: o, 1: windows.with_option(o, strategy="segment", kmax=2, include_union_windows=False, include_global_total=False), 2: windows.with_option(o, strategy="cluster", day_snap=True, include_gap_windows=False),
        3: windows.with_option(o, alpha=0.3, beta=0.5, sigma_days=0.4, max_unions_to_keep=1, min_seg_days=4.0),
    }
    norm = lambda rows: sorted((r["series_id"], round(r["a"], 6), round(r["b"], 6), r["L"], r["U"]) for r in rows)
    table = option_rows.option_table(spark, some)
    got = option_rows.windows_by_option(obs, table).collect()
    for oid, option in some.items():
        assert norm(r for r in got if r["option_id"] == oid) == norm(windows.acceptance_windows(obs, option).collect()), oid
    own = table.selectExpr("*", "option_id % 3 + 1 AS series_id")
    alone = option_rows.windows_by_option(obs, own).collect()
    assert {(r["series_id"], r["option_id"]) for r in alone} == {(i % 3 + 1, i) for i in some}
    assert norm(alone) == norm(r for r in got if r["series_id"] == r["option_id"] % 3 + 1)
    size = lambda table: option_rows.windows_by_option(obs, table)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(table) == size(option_rows.option_table(spark, {i: o for i in range(300)}))


def test_no_options_no_events_no_observations(spark):
    obs, ev = series(spark)
    table = option_rows.option_table(spark, {0: WindowOptions(strategy="cluster")})
    assert option_rows.score_options(obs, ev.limit(0), table).count() == 0
    assert option_rows.score_options(obs.limit(0), ev, table).count() == 0
    assert option_rows.score_options(obs, ev, table.limit(0)).count() == 0
