"""Ranks by buckets against plain sorting, with hot keys, ties, nulls, infinities and crowded values."""

import numpy as np
import pytest

from outspan.operators import ranks, stats

INF, NAN = float("inf"), float("nan")


def _values():
    rng = np.random.default_rng(5)
    out = [("hot", float(x)) for x in rng.lognormal(0, 4, 900)]
    out += [("crowd", 1e9 + float(x)) for x in rng.normal(0, 1e-3, 200)] + [("crowd", -1e300), ("crowd", 1e300)]
    out += [("ties", float(x)) for x in rng.integers(0, 4, 300)] + [("one", 7.0), (None, 1.0), (None, 3.0), (None, 2.0)]
    return out + [("hot", None), ("empty", None)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_values(), "k string, v double")


def _by_key():
    keys = {k for k, _ in _values()}
    return {k: np.sort([v for q, v in _values() if q == k and v is not None]) for k in keys}


def test_percentiles(table):
    got = {r["k"]: r for r in ranks.percentiles(table, ["k"], "v", {"a": 0.0, "b": 0.31, "c": 0.5, "d": 1.0}, n="n").collect()}
    for key, v in _by_key().items():
        assert got[key]["n"] == sum(k == key for k, _ in _values())
        for name, p in (("a", 0.0), ("b", 0.31), ("c", 0.5), ("d", 1.0)):
            want = np.percentile(v, 100 * p) if len(v) else None
            assert got[key][name] == (pytest.approx(want, rel=1e-12) if want is not None else None)


def test_percentiles_of_odd_rows(spark):
    odd = spark.createDataFrame([(INF,), (-INF,), (NAN,), (0.0,), (-2.0,)], "v double")
    r = ranks.percentiles(odd, [], "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 1.0}).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (-INF, -2.0, 0.0, INF) and np.isnan(r["e"])
    assert [x for x in ranks.percentiles(odd.limit(0), [], "v", {"a": 0.5}, n="n").first()] == [0, None]
    assert ranks.percentiles(table_empty := odd.selectExpr("1 AS k", "v").limit(0), ["k"], "v", {"a": 0.5}).count() == 0 and table_empty.columns == ["k", "v"]


@pytest.mark.parametrize("mass", [0.1, 0.5, 0.95])
def test_shortest(table, mass):
    got = {r["k"]: (r["lo"], r["hi"]) for r in stats.hdi(table, ["k"], "v", mass).collect()}
    for key, v in _by_key().items():
        n = len(v)
        if not n:
            assert key not in got
            continue
        m = 0 if n == 1 else min(max(int(np.floor(mass * n)), 1), n - 1)
        i = int(np.argmin(v[m:] - v[: n - m]))
        assert got[key] == (v[i], v[i + m])


def test_no_task_holds_a_key(spark):
    """Most of a key's rows lie in small buckets, for skewed values too."""
    one = spark.range(20000).selectExpr("1 AS k", "exp(20 * rand(3)) AS v", "1 AS c")
    out = ranks.cumulated(one, ["k"], "v", "c", "upto", "N")
    assert out.count() == 20000 and out.agg({"upto": "max"}).first()[0] == 20000
    ends = one.selectExpr("min(v) AS __least", "max(v) AS __most")
    sizes = ranks.attach(one, ends, []).withColumn("b", ranks._bucket(one["v"])).groupBy("b").count()
    assert sizes.agg({"count": "max"}).first()[0] < 1000


def test_chronological_order(spark):
    from outspan.operators import curves

    snaps = spark.createDataFrame([(1, 3.0, 2), (2, 1.0, 9), (1, 3.0, 1), (2, 2.0, 0)], "series_id int, t_star double, snap_id int")
    assert [(r["t_star"], r["snap_id"]) for r in curves.chronological(snaps).collect()] == [(1.0, 9), (2.0, 0), (3.0, 1), (3.0, 2)]


def test_weighted_path_without_weights(spark):
    """Far events have no weight left: then those with an event count alike; where all are censored, everybody."""
    from outspan.operators import curves

    grid = spark.createDataFrame([(0.0,), (900.0,), (2000.0,)], "T double")
    first = spark.createDataFrame([(1000.0, 2.0), (1000.0, 4.0), (None, 9.0)], "first_post double, x double")
    got = {r["T"]: (r["n"], r["mean"]) for r in curves.timepath_weighted(first, "x", grid, 0.5).collect()}
    assert got == {0.0: (3, 3.0), 900.0: (3, 3.0), 2000.0: (1, 9.0)}
