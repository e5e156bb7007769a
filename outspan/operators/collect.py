"""Collectors: histograms, time matrices and counts over kept trajectories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(v: Column, bins: int, lo: float, hi: float) -> Column:
    """Bin number; hi belongs to the last one, values outside and NaN have none."""
    b = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("long")
    return F.when(v.isNotNull() & ~F.isnan(v) & v.between(lo, hi), b)


def hist1d(df: DataFrame, expr: str, bins: int, lo: float, hi: float) -> DataFrame:
    b = bin_of(F.expr(expr).cast("double"), bins, lo, hi)
    return df.select(b.alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


def hist2d(df: DataFrame, ex: str, ey: str, bins: int, x: tuple[float, float], y: tuple[float, float], weight: str | None = None) -> DataFrame:
    w = F.sum(F.expr(weight)).alias("w") if weight else F.count("*").alias("n")
    cells = df.withColumn("bx", bin_of(F.expr(ex).cast("double"), bins, *x)).withColumn("by", bin_of(F.expr(ey).cast("double"), bins, *y))
    return cells.filter("bx IS NOT NULL AND by IS NOT NULL").groupBy("bx", "by").agg(w)


def hist_density(hist: DataFrame, bins: int, lo: float, hi: float) -> DataFrame:
    """Centres and densities of all bins, zeros where nothing fell."""
    width = (hi - lo) / bins
    every = hist.sparkSession.range(bins).withColumnRenamed("id", "bin")
    total = hist.agg(F.sum("n").alias("total"))
    out = every.join(hist, "bin", "left").crossJoin(F.broadcast(total))
    d = F.when(F.col("total") > 0, F.coalesce("n", F.lit(0)) / (F.col("total") * width)).otherwise(0.0)
    return out.select("bin", (lo + (F.col("bin") + 0.5) * width).alias("centre"), d.alias("density"))


def day_state(events: DataFrame, T: int, cutoff: int) -> DataFrame:
    """Per trajectory the last day and the first day after the cutoff, T + 1 without one; days are clamped to [0, T + 1]."""
    day = F.greatest(F.lit(0), F.least(F.floor("t"), F.lit(T + 1))).cast("long")
    e = events.withColumn("day", day)
    first = F.min(F.when((F.col("day") > cutoff) & (F.col("day") <= T), F.col("day")))
    return e.groupBy("traj_id").agg(F.greatest(F.max("day"), F.lit(0)).cast("long").alias("last_day"), F.coalesce(first, F.lit(T + 1)).cast("long").alias("first_after"))


def time_matrix(events: DataFrame, T: int, cutoff: int) -> DataFrame:
    return day_state(events, T, cutoff).groupBy("last_day", "first_after").agg(F.count("*").alias("n"))


def active_set_size(entities: DataFrame, edges: DataFrame, t: float) -> DataFrame:
    n = edges.filter((F.col("parent_t") <= t) & (F.col("child_t") > t)).groupBy("traj_id").agg(F.count("*").alias("n"))
    return entities.join(n, "traj_id", "left").select("traj_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def first_generation(edges: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Children of a root at time 0."""
    return edges.filter((F.col("parent_t") < eps) & (F.col("child_t") > eps))


def acceptance_counts(df: DataFrame, ok: str, chunk: Column) -> DataFrame:
    return df.groupBy(chunk.alias("chunk")).agg(F.count_if(F.col(ok)).alias("accepted"), F.count("*").alias("processed"))


@dataclass(frozen=True)
class Collector:
    """A named aggregate over a trajectory's events; a group of them runs in one pass."""

    name: str
    expr: Column

    def aggregate(self) -> Column:
        return self.expr.alias(self.name)


def collect_group(entities: DataFrame, events: DataFrame, collectors: list[Collector]) -> DataFrame:
    return entities.join(events.groupBy("traj_id").agg(*[c.aggregate() for c in collectors]), "traj_id", "left")


def matrix_extinction(matrix: DataFrame, T: int) -> DataFrame:
    """From a time matrix, p(d): of those without an event after the cutoff up to day d the share that never has one; 1 if there is none, 0 everywhere if the matrix is empty."""
    by = matrix.groupBy("first_after").agg(F.sum("n").alias("n"))
    days = matrix.sparkSession.range(T + 1).select(F.col("id").alias("d"))
    both = days.select("d", F.lit(None).cast("long").alias("n"), F.lit(True).alias("probe")).union(by.select("first_after", "n", F.lit(False)))
    later = Window.orderBy(F.col("d").desc()).rangeBetween(Window.unboundedPreceding, -1)  # one row a day
    never = by.filter(F.col("first_after") == T + 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("never"))
    total = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    out = both.withColumn("quiet", F.sum("n").over(later)).filter("probe").crossJoin(F.broadcast(never)).crossJoin(F.broadcast(total))
    p = F.when(F.col("total") == 0, 0.0).when(F.coalesce("quiet", F.lit(0)) == 0, 1.0).otherwise(F.col("never") / F.col("quiet"))
    return out.select("d", p.alias("p"))
