"""Windows, segments and scores that are made where the series are: against the same steps as Spark operators, and what is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outspan.model import WindowOptions
from outspan.operators import options as option_rows
from outspan.operators import windows

KEY = windows.KEY


def exchanges(df):
    """Times that a plan deals rows to tasks."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def observations(spark, many=40, seed=11):
    rng = np.random.default_rng(seed)
    rows = [(s, float(np.round(d, 2)), int(n)) for s in range(many) for d, n in zip(rng.choice([0.5, 3, 7.25, 30], 1) * rng.normal(4, 3, s % 9 + 1), rng.integers(0, 5, s % 9 + 1), strict=True)]
    rows += [(1, -3.0, 2), (1, -3.0, 1), (1, 8.0, 2), (2, None, 4), (None, 1.0, 3), (None, 5.0, 1)]  # equal times, no time, no series
    return spark.createDataFrame(rows, "series_id long, d double, n long")


def by_operators(obs, o):
    """Acceptance windows from the operators on clusters, gaps, masses, bands and unions, one after another."""
    t = windows.totals(obs)
    c = windows.cluster_windows(obs, o)
    base = c.select(KEY, "a", "b").limit(0)
    if o.strategy != "segment":
        base = windows.union_windows(c, windows.gap_windows(c, o.gap_scale) if o.include_gap_windows else c)
    if o.strategy != "cluster":
        base = windows.union_windows(base, windows.segment_windows(obs, o))
    bands = windows.band(windows.observed_mass(obs, base), t, o).select(KEY, "a", "b", "L", "U").join(t, KEY)
    bands = bands.withColumn("a", F.greatest("a", F.least("first", F.lit(0.0)))).withColumn("b", F.least("b", "last"))
    if o.day_snap:
        bands = bands.withColumn("a", F.floor("a").cast("double")).withColumn("b", F.ceil("b").cast("double"))
    out = windows.fold_bounds(bands.filter("b > a").select(KEY, "a", "b", "L", "U", F.lit(0).alias("ord"))).withColumn("ord", F.lit(0))
    parts = [out]
    if o.include_union_windows:
        parts.append(windows.union_candidates(out, obs, o).select(KEY, "a", "b", "L", "U", F.lit(1).alias("ord")))
    if o.include_global_total:
        whole = t.select(KEY, F.least("first", F.lit(0.0)).alias("a"), F.col("last").alias("b"), F.col("N").alias("M"))
        parts.append(windows.band(whole, t, o).select(KEY, "a", "b", "L", "U", F.lit(2).alias("ord")))
    for p in parts[1:]:
        out = out.unionByName(p)
    return windows.fold_bounds(out)


def rows(df):
    return sorted((r[KEY], round(r["a"], 7) + 0.0, round(r["b"], 7) + 0.0, r["L"], r["U"]) for r in df.collect())


CASES = [{}, {"strategy": "segment", "kmax": 2}, {"strategy": "cluster", "day_snap": True, "max_unions_to_keep": 2}, {"include_gap_windows": False, "include_union_windows": False, "sigma_days": 0.2}]


@pytest.mark.parametrize("changes", CASES)
def test_windows_are_those_of_the_operators(spark, changes):
    o = windows.with_option(WindowOptions(grid_step_days=1.0), **changes)
    obs = observations(spark)
    some = obs.groupBy(KEY).agg(F.sum("n").alias("all")).filter(F.col("all") > 0).select(KEY)
    assert rows(windows.acceptance_windows(obs.join(some, KEY), o)) == rows(by_operators(obs.join(some, KEY), o)) != []


def test_only_observations_are_dealt(spark):
    """Neither windows nor their days are shuffled: one deal of the series, whatever the strategy."""
    obs = observations(spark)
    for strategy in ("both", "cluster"):
        assert exchanges(windows.acceptance_windows(obs, WindowOptions(strategy=strategy))) == 1


def test_a_series_without_counts_has_bounds_of_zero(spark):
    obs = spark.createDataFrame([(1, 0.0, 0), (1, 4.0, 0), (2, 0.0, 3)], "series_id long, d double, n long")
    got = rows(windows.acceptance_windows(obs, WindowOptions(grid_step_days=1.0)))
    assert {x[3:] for x in got if x[0] == 1} == {(0, 0)} and any(x[0] == 2 for x in got)


def scored(spark, options, chunk=None, monkeypatch=None):
    rng = np.random.default_rng(2)
    obs = spark.createDataFrame([(s, float(d), int(n)) for s in (1, 2) for d, n in zip((0, 6, 7, 15), rng.integers(1, 4, 4), strict=True)], "series_id long, d double, n long")
    ev = [(s, f"t{i}", float(np.round(t, 3))) for s in (1, 2, 3) for i in range(40) for t in rng.uniform(-1, 16, rng.integers(1, 9))]
    ev += [(1, "t3", None), (1, None, 2.0), (None, "t3", 2.0), (2, "none", None)]
    return obs, spark.createDataFrame(ev, "series_id long, traj_id string, t double"), ev


OPTIONS = {i: windows.with_option(WindowOptions(strategy="cluster", include_global_total=False, grid_step_days=1.0), baseline_p=p, h_max=3.0) for i, p in enumerate((0.3, 0.9, 1.5))} | {7: WindowOptions(grid_step_days=1.0, h_max=3.0, baseline_p=2.0)}


def test_scores_of_parts_of_a_series(spark, monkeypatch):
    """Trajectories of a series that are dealt to several tasks give the scores of one; no time is no event, and no id is a trajectory without events."""
    obs, events, ev = scored(spark, OPTIONS)
    got = lambda: {(r[KEY], r["option_id"]): (r["accepted"], pytest.approx(r["objective"])) for r in option_rows.score_options(obs, events, OPTIONS).collect()}
    want = {}
    for oid, o in OPTIONS.items():
        win = rows(windows.acceptance_windows(obs, o))
        for s in (1, 2):
            times = {i: [t for q, j, t in ev if q == s and j == i and t is not None and i is not None] for i in {j for q, j, _ in ev if q == s}}
            kept = [ts for ts in times.values() if all(L <= sum(a <= t <= b for t in ts) <= U for q, a, b, L, U in win if q == s)]
            seen, y, l2 = sorted((r["d"], r["n"]) for r in obs.filter(F.col(KEY) == s).collect()), 0, []
            for d, n in seen:
                y += n
                l2.append((y - sum(t <= d for ts in kept for t in ts) / max(1, len(kept))) ** 2)
            if kept:
                want[s, oid] = (len(kept), np.mean(l2) + max(0, 80 - len(kept)) ** 2)
    assert got() == want and len(want) > 4
    monkeypatch.setattr(option_rows, "CHUNK", 9)
    assert got() == want


def test_scores_deal_observations_and_events_alone(spark):
    """Windows of options, most of the rows, are used where they are made."""
    obs, events, _ = scored(spark, OPTIONS)
    assert exchanges(option_rows.score_options(obs, events, OPTIONS)) <= 6  # large series and their broadcast, for both sides; the series; the sums of their parts


def test_a_query_of_best_options_is_a_small_plan(spark):
    """Both options of the default strategy and the choice of the best; the plan had 432 deals of rows."""
    obs, events, _ = scored(spark, OPTIONS)
    best = option_rows.best_options(option_rows.score_options(obs, events, {0: OPTIONS[7], 1: OPTIONS[1]}))
    assert exchanges(best) <= 7


def test_bands_of_windows_are_a_small_plan(spark):
    """Windows meet observations and their curve in one task; the plan had 30 deals of rows and made the grid three times."""
    obs = observations(spark)
    win = obs.filter("d IS NOT NULL").select(KEY, F.floor("d").cast("double").alias("a"), (F.col("d") + 2).alias("b")).union(obs.select(KEY, F.col("d").alias("a"), F.lit(None).cast("double").alias("b")))
    o = WindowOptions(grid_step_days=1.0)
    got = windows.segment_bands(obs, win, o)
    assert exchanges(got) == 1
    curve = windows.monotone_interpolant(obs.filter("d IS NOT NULL"), 1.0).collect()
    grid = {}
    for r in sorted(curve, key=lambda r: r["i"]):
        grid.setdefault(r[KEY], []).append((r["x"], r["v"]))
    at = lambda s, t: grid[s][int(np.clip(np.floor(t - grid[s][0][0] + 0.5), 0, len(grid[s]) - 1))][1]
    want = sorted((r[KEY], r["a"], r["b"], round(e, 6)) for r in win.collect() if r["b"] is not None and r[KEY] in grid and r[KEY] is not None and (e := at(r[KEY], r["b"]) - at(r[KEY], r["a"])) > 1e-9)
    assert sorted((r[KEY], r["a"], r["b"], round(r["E"], 6)) for r in got.collect()) == want != []


def test_options_do_not_deal_windows(spark):
    """Windows of options come from one deal of the series, for shared options as for those of single series; the plan had 68."""
    obs = observations(spark)
    table = option_rows.option_table(spark, OPTIONS)
    for options in (table, table.withColumn(KEY, F.col("option_id") % 3)):
        assert exchanges(option_rows.windows_by_option(obs, options)) == 1
    got = option_rows.windows_by_option(obs, table.withColumn(KEY, F.col("option_id") % 3)).collect()
    for oid, o in OPTIONS.items():
        assert sorted((r["a"], r["b"], r["L"], r["U"]) for r in got if r["option_id"] == oid) == sorted((r["a"], r["b"], r["L"], r["U"]) for r in windows.acceptance_windows(obs.filter(F.col(KEY) == oid % 3), o).collect())


def test_clusters_alone_are_dealt_once(spark):
    """Over a series of 3,000 days: each window was a row for each of its days."""
    obs = spark.createDataFrame([(s, float(d), 1) for s in (1, 2) for d in range(s, 3000, 211)], "series_id long, d double, n long")
    o = WindowOptions(strategy="cluster")
    got = windows.acceptance_windows(obs, o)
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString() and rows(got) == rows(by_operators(obs, o))


def test_segments_of_long_series(spark):
    """Curves of more points than a block of ends, against a plain search; grids are made where they are cut, so only observations are dealt."""
    rng = np.random.default_rng(8)
    data = [(s, float(d), int(n)) for s, last in ((1, 150), (2, 300)) for d, n in zip(sorted({0, last, *rng.choice(last, 8)}), rng.integers(1, 9, 10), strict=False)]
    obs = spark.createDataFrame(data, "series_id long, d double, n long")
    got = windows.segment_windows(obs, WindowOptions(grid_step_days=1.0, min_seg_days=5.0))
    assert exchanges(got) == 1
    curve = windows.monotone_interpolant(obs, 1.0).toPandas().sort_values("i")
    for s, own in curve.groupby(KEY):
        x, v = own["x"].to_numpy(), own["v"].to_numpy()
        n = len(x)
        cost = np.full((n, n), np.inf)
        for i in range(n):
            for j in range(i + 5, n):
                cost[i, j] = ((v[i : j + 1] - np.linspace(v[i], v[j], j - i + 1)) ** 2).sum()
        two = (cost[0][:, None] + cost).min(axis=0)
        sse = [cost[0, -1], two[-1], (two + cost[:, -1]).min()]
        k = int(np.argmin([n * np.log(max(e / n, 1e-12)) + 2 * (q + 1) * np.log(n) for q, e in enumerate(sse)]))
        ends = sorted((r["a"], r["b"]) for r in got.filter(F.col(KEY) == s).collect())
        assert len(ends) == k + 1 and sum(cost[int(a - x[0]), int(b - x[0])] for a, b in ends) == pytest.approx(sse[k], abs=1e-6)
