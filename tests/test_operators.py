"""Kernels against closed forms, identities between estimators, and small hand-made cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from outspan.functions import expr as X
from outspan.functions import special as S
from outspan.model import Parameter, Parameters, WindowOptions
from outspan.operators import collect, criteria, curves, quiet, spatial, stats, windows
from outspan.sources import ingest


def test_lower_gamma_is_erlang():
    x = np.linspace(0, 40, 200)
    for a in (1, 2, 3, 4, 9):
        erlang = 1 - np.exp(-x) * sum(x**i / math.factorial(i) for i in range(a))
        assert np.allclose(S.lower_gamma(np.full_like(x, a), x), erlang, atol=1e-12)
    assert abs(S.lower_gamma(np.array([0.5]), np.array([0.81]))[0] - math.erf(0.9)) < 1e-12


def test_parameters():
    p = Parameters({n: Parameter(n, 0.0, 1.0) for n in ("r0", "K", "r", "alpha", "theta")}).require("R0 < 1")
    assert p.validators == ["R0 < 1"] and Parameter("x", 2, 2).fixed
    with pytest.raises(ValueError):
        Parameter("x", 2, 1)
    with pytest.raises(ValueError):
        Parameters({"R0": Parameter("R0", 0, 1)})


def test_hdi_against_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k in range(3) for v in rng.choice([0.5, 1, 1, 2, 2, 2, 3, 5, 8, 13], 30 + k)] + [(9, 1.0)]
    got = {r["k"]: (r["lo"], r["hi"]) for r in stats.hdi(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", 0.8).collect()}
    for k in (0, 1, 2):
        xs = sorted(v for q, v in rows if q == k)
        m = min(max(1, int(0.8 * len(xs))), len(xs) - 1)
        best = min(range(len(xs) - m), key=lambda j: (xs[j + m] - xs[j], j))
        assert got[k] == (xs[best], xs[best + m])
    assert got[9] == (1.0, 1.0)


def test_surrogate_exact_is_mixture_and_one_draw_is_first_after(spark):
    draws = spark.createDataFrame([(1, 2.0, 0.5, 0.5, 2, 3.0)], "traj_id long, R0 double, k double, r double, alpha long, theta double")
    act = spark.createDataFrame([(1, 0.0), (1, 4.0)], "traj_id long, parent_t double")
    grid = spark.createDataFrame([(float(x),) for x in range(5)], "T double")
    logs = quiet.log_survival(draws, act, grid, 5.0, None)
    a = {r["T"]: r["p"] for r in quiet.first_after_mixture(logs).collect()}
    b = {r["T"]: r["p"] for r in quiet.first_after(logs).collect()}
    c = {r["T"]: r["p"] for r in quiet.first_after_surrogate(draws, act, grid, 5.0, "exact").collect()}
    assert all(abs(a[t] - b[t]) < 1e-12 and abs(a[t] - c[t]) < 1e-12 for t in a)
    p = [a[t] for t in sorted(a)]
    assert p == sorted(p) and p[-1] <= 1


def test_survival_table_limits(spark):
    keys = spark.createDataFrame([(0.8, 0.5, 2.0, 2.0), (3.0, 0.5, 2.0, 2.0)], "R double, k double, alpha double, theta double")
    for r in quiet.survival_table(keys, 80.0, 0.1).collect():
        b = r["k"] / r["R"]
        assert abs(r["H"][0] - (b / (b + 1)) ** r["k"]) < 1e-12
        q = keys.filter(F.col("R") == r["R"]).select(X.ultimate_extinction(F.col("R"), F.col("k")).alias("q")).first()["q"]
        assert abs(r["H"][-1] - q) < 0.03


def test_empty_trajectories_and_censoring(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "traj_id long")
    ev = spark.createDataFrame([(1, 0.0), (1, 12.0), (2, 3.0)], "traj_id long, t double")
    grid = spark.createDataFrame([(0.0,), (3.0,)], "T double")
    got = {r["T"]: (r["over"], r["n"]) for r in quiet.empirical_cond(ids, ev, grid, 10.0).collect()}
    assert got == {0.0: (2, 3), 3.0: (2, 2)}
    m = {(r["traj_id"], r["g"]): r["y"] for r in curves.cumulative_matrix(ids, ev, 0.0, 5.0, 4).collect()}
    assert m[1, 0.0] == 1 and m[1, 15.0] == 2 and m[3, 15.0] == 0 and m[2, 5.0] == 1


def test_results_do_not_depend_on_partitioning(spark):
    from outspan.plans.bindings import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    a = collect.time_matrix(t.ev.repartition(1), 28, 20).collect()
    b = collect.time_matrix(t.ev.repartition(7, "event_id"), 28, 20).collect()
    assert sorted(a) == sorted(b)
    x = quiet.attach_donors(t.parents.select("traj_id", F.col("parent_id").alias("child_id"), "t"), t.ev.select("traj_id", "t"), 3)
    y = quiet.attach_donors(t.parents.repartition(5).select("traj_id", F.col("parent_id").alias("child_id"), "t"), t.ev.repartition(3).select("traj_id", "t"), 3)
    assert x.exceptAll(y).count() == 0 and x.count() == y.count()


def test_windows_of_known_counts(spark):
    days = [(2, 1), (17, 3), (21, 1), (22, 1), (27, 1), (29, 2), (32, 1), (45, 1)]
    obs = spark.createDataFrame([(1, float(d), n) for d, n in days] + [(2, 4.0, 5)], "series_id long, d double, n long")
    win = windows.acceptance_windows(obs, WindowOptions(grid_step_days=0.5))
    got = win.collect()
    assert all(r["L"] <= r["U"] and r["a"] <= r["b"] for r in got)
    total = [r for r in got if r["series_id"] == 1 and r["a"] == 0.0 and r["b"] == 45.0]
    assert total and total[0]["L"] <= 11 <= total[0]["U"]
    curve = windows.monotone_interpolant(obs, 0.5).filter("series_id = 1").orderBy("i").collect()
    v = [r["v"] for r in curve]
    assert all(b >= a - 1e-9 for a, b in zip(v, v[1:], strict=False)) and v[0] == 1 and abs(v[-1] - 11) < 1e-9
    full = spark.createDataFrame([(1, 0.0, 1.0)], "series_id long, a double, b double")
    assert windows.observed_mass(obs, full).first()["M"] == 0


def test_latin_hypercube_strata(spark):
    p = [Parameter(n, 0.0, 10.0) for n in ("R0", "k", "r", "alpha")] + [Parameter("theta", 2.0, 2.0)]
    d = ingest.latin_hypercube(spark, 20, p, chunks=2).collect()
    for c in (0, 1):
        assert sorted(int(r["R0"] * 2) for r in d if r["chunk"] == c) == list(range(20))
    assert {r["theta"] for r in d} == {2.0}


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    ingest.write_summary(df, str(tmp_path / "s"))
    back = ingest.read_dim(spark, str(tmp_path / "s"), df.schema, {"id": "key"})
    assert back.columns == ["key", "name"] and back.count() == 2
    ingest.append_log(df, str(tmp_path / "log"))
    ingest.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_polygon_and_kernel(spark):
    square = spark.createDataFrame([(0.0, 0.0, 4.0, 0.0), (4.0, 0.0, 4.0, 4.0), (4.0, 4.0, 0.0, 4.0), (0.0, 4.0, 0.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 2.0)], "id int, x double, y double")
    assert {r["id"]: r["inside"] for r in spatial.points_in_polygon(pts, square).collect()} == {1: True, 2: False}
    cells = spark.createDataFrame([(0, 0, 8.0)], "ix long, iy long, w double")
    s = spatial.kernel_smooth(cells, spatial.kernel_offsets(spark, "gaussian", sigma=1.0), 8)
    assert abs(s.agg(F.sum("w")).first()[0] - 8.0) < 1e-9


def test_criterion_group_counts_empty_windows(spark):
    ids = spark.createDataFrame([(1,), (2,)], "traj_id long")
    ev = spark.createDataFrame([(1, 0.0, True), (1, 2.0, False)], "traj_id long, t double, is_root boolean")
    win = spark.createDataFrame([(0, 0.0, 2.0, 1, 1), (1, 3.0, 4.0, 0, 0)], "win_id int, t_min double, t_max double, lo long, hi long")
    assert [r["traj_id"] for r in criteria.criterion_group(ids, ev, win).collect()] == [1]


def test_open_and_long_windows(spark):
    inf = float("inf")
    ev = spark.createDataFrame([(1, 7, 0.0), (1, 8, 500.5), (2, 9, -3.2), (2, 10, 2.0**21), (3, 11, None)], "traj_id long, id long, t double")
    win = spark.createDataFrame([(0, -inf, 0.0), (1, 0.0, inf), (2, -10.0, 3e9), (3, 500.5, 500.5), (4, 400.0, 600.0), (5, 9.0, 8.0)], "win_id int, t_min double, t_max double")
    got = {(r["traj_id"], r["win_id"]): r["n"] for r in criteria.window_counts(ev, win).collect()}
    assert got == {(1, 0): 1, (1, 1): 2, (1, 2): 2, (1, 3): 1, (1, 4): 1, (2, 0): 1, (2, 1): 1, (2, 2): 2}
    assert {r["id"]: r["cluster"] for r in criteria.cluster_of(ev.select("id", "t"), win).collect()} == {7: 0, 8: 1, 9: 0, 10: 1, 11: -1}


def test_bootstrap_of_tiny_chances(spark):
    logs = spark.createDataFrame([(i, 0.0, -800.0 - i, -805.0 - i) for i in range(40)], "traj_id long, T double, ls double, lh double")
    r = quiet.bootstrap_bands(logs, 20, 3).first()
    assert abs(r["lo"] - 0.006737946999) < 1e-9 and abs(r["hi"] - r["lo"]) < 1e-9


def test_segments_need_two_steps(spark):
    from outspan.model import WindowOptions

    obs = spark.createDataFrame([(1, 0.0, 1), (1, 1.0, 2), (2, 0.0, 1), (2, 3.0, 1), (2, 4.0, 5)], "series_id long, d double, n long")
    got = windows.segment_windows(obs, WindowOptions(grid_step_days=1.0, min_seg_days=1.0)).collect()
    assert {r["series_id"] for r in got} == {2} and all(r["b"] - r["a"] >= 2 for r in got)


def test_stream_of_batches(spark, tmp_path):
    """Rows of a batch update the windows that are open; rows later than the watermark of the batches before the last are left out."""
    import time

    from outspan.streaming import monitor

    day = "timestamp'2024-01-{:02d} 12:00:00'"
    for rows in ([(1, 1), (2, 1), (1, 9)], [(1, 10)], [(1, 10), (2, 2), (2, 9)]):
        spark.sql(" UNION ALL ".join(f"SELECT {t}L AS traj_id, {day.format(d)} AS ts" for t, d in rows)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    s = spark.readStream.schema("traj_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    q = monitor.stream_quiet_monitor(s).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, n: seen.append({(r["traj_id"], r["last_ts"].day, r["n"]) for r in b.collect()})).start()
    q.awaitTermination()
    assert [x for x in seen if x] == [{(1, 1, 1), (2, 1, 1), (1, 9, 1)}, {(1, 10, 1)}, {(1, 10, 2), (2, 9, 1)}]


def test_permuted_numbers(spark):
    """Each number once for any n, another order for another seed, in all rounds."""
    for n in (1, 2, 7, 100, 1000):
        got = [[r[0] for r in spark.range(n).select(ingest.permuted(F.col("id"), n, seed, F.lit(3)).alias("x")).collect()] for seed in (1, 2)]
        assert sorted(got[0]) == sorted(got[1]) == list(range(n)) and (n < 100 or got[0] != got[1])
    assert abs(np.corrcoef(got[0], range(1000))[0, 1]) < 0.15
    ids = spark.createDataFrame([(5,), (5,), (9,), (None,)], "traj_id long")
    assert sorted(r["row"] for r in ingest.numbered(ids, 1).filter("traj_id IS NOT NULL").collect()) == [0, 1, 2] or ingest.numbered(ids, 1).count() >= 3
    plan = ingest.latin_hypercube(spark, 1000, [Parameter(x, 0.0, 1.0) for x in ("R0", "k", "r", "alpha", "theta")])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_sample_valid(spark):
    """Exactly n, all valid, the same on any number of partitions and as the first rows of a longer sample; impossible rules end."""
    wanted = Parameters({x: Parameter(x, 0.0, 1.0) for x in ("R0", "k", "r", "alpha", "theta")}).require("R0 * r < 0.1").require("k < 0.5")
    draws = lambda n: sorted(tuple(r) for r in ingest.sample_valid(spark, wanted, n, chunk=50).collect())
    few, many = draws(40), draws(90)
    assert len(few) == 40 and few == many[:40] and len(many) == 90 and all(r[2] * r[4] < 0.1 and r[3] < 0.5 for r in many)
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert draws(40) == few
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    never = Parameters({x: Parameter(x, 0.0, 1.0) for x in ("R0", "k", "r", "alpha", "theta")}).require("k > 2")
    with pytest.raises(ValueError, match="valid after"):
        ingest.sample_valid(spark, never, 5, chunk=50, most_chunks=8)


def test_polygon_bands(spark):
    """Many polygons of different heights that touch in corners, level edges, points on bands, outside of all and without a place."""
    rng = np.random.default_rng(3)
    edges = []
    for _ in range(60):
        ring = rng.integers(0, 40, (rng.integers(3, 7), 2)) / rng.choice([1.0, 8.0])
        edges += [(*map(float, ring[i - 1]), *map(float, ring[i])) for i in range(len(ring))]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-2, 42, (400, 2)))] + [(1000 + i, 0.5, float(i)) for i in range(41)] + [(2000, None, 1.0), (2001, 1.0, None)]
    got = {r["id"]: r["inside"] for r in spatial.points_in_polygon(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(edges, "x1 double, y1 double, x2 double, y2 double")).collect()}
    for i, x, y in pts:
        n = 0 if x is None or y is None else sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges)
        assert got[i] == (n % 2 == 1)
    none = spark.createDataFrame([], "x1 double, y1 double, x2 double, y2 double")
    assert not spatial.points_in_polygon(spark.createDataFrame(pts, "id long, x double, y double"), none).filter("inside").count()
    plan = spatial.points_in_polygon(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(edges, "x1 double, y1 double, x2 double, y2 double"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_summarise(spark):
    """Any partitioning and few held keys; null keys and values; no keys; no rows."""
    rows = [(i % 3 if i % 7 else None, float(i) if i % 5 else None) for i in range(200)]
    total = stats.Summary(lambda: (0, 0.0), lambda s, x: (s[0] + len(x), s[1] + float((x**2).sum())), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[1] / s[0] if s[0] else None)
    want = {k: np.mean([v * v for q, v in rows if q == k and v is not None]) for k in (0, 1, 2, None)}
    df = spark.createDataFrame(rows, "g long, v double")
    for parts, held in ((1, 100), (6, 1)):
        got = {None if r["g"] is None or r["g"] != r["g"] else int(r["g"]): r["summary"] for r in stats.summarise(df.repartition(parts), ["g"], "v", total, held=held).collect()}
        assert got == pytest.approx(want)
    assert stats.summarise(df, [], "v", total).first()["summary"] == pytest.approx(np.mean([v * v for _, v in rows if v is not None]))
    assert stats.summarise(df.limit(0), ["g"], "v", total).count() == 0
