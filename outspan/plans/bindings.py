"""How the given tables are read as event histories, in Spark and as common table expressions for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

T_STAR, EDGE_STAR = 20.0, 60.0

SPARK = {
    "entities": "SELECT DISTINCT user_id AS traj_id FROM {events}",
    "ev": "SELECT user_id AS traj_id, event_id, event_type, (unix_micros(cast(ts AS timestamp)) - unix_micros(timestamp'2024-01-01 00:00:00')) / 86400e6 AS t, cast(ts AS timestamp) AS ts FROM {events}",
    "customers": "SELECT c_custkey AS traj_id FROM {customer}",
    "parents": "SELECT o_custkey AS traj_id, o_orderkey AS parent_id, datediff(o_orderdate, date'1995-01-01') / 30e0 AS t FROM {orders}",
    "edges": "SELECT o_custkey AS traj_id, o_orderkey AS parent_id, datediff(o_orderdate, date'1995-01-01') / 30e0 AS parent_t, datediff(l_shipdate, date'1995-01-01') / 30e0 AS child_t, cast(o_orderkey * 8 + l_linenumber AS bigint) AS child_id FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate",
    "draws": "SELECT c_custkey AS traj_id, 0.25e0 + 14.75e0*((c_custkey*7919)%1000)/1000e0 AS R0, 0.2e0 + 9.8e0*((c_custkey*104729)%1000)/1000e0 AS k, 0.01e0 + 0.98e0*((c_custkey*1299709)%997)/997e0 AS r, cast(1+(c_custkey*31)%4 AS bigint) AS alpha, 1e0+((c_custkey*17)%100)/10e0 AS theta FROM {customer}",
    "observations": "SELECT o_custkey AS series_id, o_orderdate AS ts, datediff(o_orderdate, date'1992-01-01') / 10e0 AS d, count(*) AS n FROM {orders} GROUP BY o_custkey, o_orderdate",
    "herds": "SELECT s_suppkey AS herd_id, s_nationkey AS herd_type, 16.1e0+6.8e0*((s_suppkey*37)%101)/101e0 AS lon, 45.7e0+2.9e0*((s_suppkey*53)%103)/103e0 AS lat, cast(1+(s_suppkey*13)%200 AS bigint) AS herd_size FROM {supplier}",
}

DUCK = {
    "entities": "SELECT DISTINCT user_id AS traj_id FROM events",
    "ev": "SELECT user_id AS traj_id, event_id, event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6 AS t, ts FROM events",
    "customers": "SELECT c_custkey AS traj_id FROM customer",
    "parents": "SELECT o_custkey AS traj_id, o_orderkey AS parent_id, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate::TIMESTAMP) / 30e0 AS t FROM orders",
    "edges": "SELECT o_custkey AS traj_id, o_orderkey AS parent_id, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate::TIMESTAMP) / 30e0 AS parent_t, date_diff('day', TIMESTAMP '1995-01-01', l_shipdate::TIMESTAMP) / 30e0 AS child_t, CAST(o_orderkey * 8 + l_linenumber AS BIGINT) AS child_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate",
    "draws": "SELECT c_custkey AS traj_id, 0.25e0 + 14.75e0*((c_custkey*7919)%1000)/1000e0 AS R0, 0.2e0 + 9.8e0*((c_custkey*104729)%1000)/1000e0 AS k, 0.01e0 + 0.98e0*((c_custkey*1299709)%997)/997e0 AS r, CAST(1+(c_custkey*31)%4 AS BIGINT) AS alpha, 1e0+((c_custkey*17)%100)/10e0 AS theta FROM customer",
    "observations": "SELECT o_custkey AS series_id, o_orderdate AS ts, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate::TIMESTAMP) / 10e0 AS d, count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate",
    "herds": "SELECT s_suppkey AS herd_id, s_nationkey AS herd_type, 16.1e0+6.8e0*((s_suppkey*37)%101)/101e0 AS lon, 45.7e0+2.9e0*((s_suppkey*53)%103)/103e0 AS lat, CAST(1+(s_suppkey*13)%200 AS BIGINT) AS herd_size FROM supplier",
}


class Tables:
    """The bound tables of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SPARK:
            raise AttributeError(name)
        text = SPARK[name]
        needs = [t for t in ("events", "orders", "lineitem", "customer", "supplier") if "{" + t + "}" in text]
        return self.spark.sql(text, **{t: self.raw(t) for t in needs})

    def grid(self, start: float, stop: float, step: float, name: str = "T") -> DataFrame:
        n = int(round((stop - start) / step)) + 1
        return self.spark.range(n).select((F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias(name))


def with_(names: str, body: str, *extra: tuple[str, str]) -> str:
    """SQL with the named bindings, then the extra expressions, before ``body``."""
    ctes = [f"{n} AS ({DUCK[n]})" for n in names.split()] + [f"{n} AS ({q})" for n, q in extra]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def grid_sql(start: float, stop: float, step: float, name: str = "T") -> str:
    n = int(round((stop - start) / step)) + 1
    return f"SELECT CAST({start}e0 + i * {step}e0 AS DOUBLE) AS {name} FROM range({n}) g(i)"


def erlang(x: str, a: str = "alpha", th: str = "theta") -> str:
    """Gamma distribution for shapes 1 to 4."""
    z = f"(({x}) / ({th}))"
    return f"(CASE WHEN ({x}) <= 0 THEN 0e0 ELSE 1 - exp(-{z}) * (1 + CASE WHEN {a} > 1 THEN {z} ELSE 0 END + CASE WHEN {a} > 2 THEN {z} * {z} / 2 ELSE 0 END + CASE WHEN {a} > 3 THEN {z} * {z} * {z} / 6 ELSE 0 END) END)"


def thinned_sql(x: str, rate: float, shape: float, n: int, of: str) -> str:
    """Rows of ``of`` with fx, the integral of the gamma density times Weibull survival: Simpson's rule in the root of the age, which makes both smooth."""
    v = f"(j * sqrt({x}) / {n})"
    f = f"(CASE WHEN j IN (0, {n}) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * 2 * pow({v}, 2 * alpha - 1) * exp(-{v} * {v} / theta - pow({v} * {v} * {rate}, {shape})))"
    return f"SELECT *, sqrt({x}) / {3 * n} * list_sum(list_transform(range({n + 1}), lambda j: {f})) / (pow(theta, alpha) * CASE WHEN alpha < 3 THEN 1 WHEN alpha < 4 THEN 2 ELSE 6 END) AS fx FROM {of}"
