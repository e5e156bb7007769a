"""Cumulative curves over grids, their distances and bands, and paths over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import gaussian_distance_weight
from .criteria import small
from .nested import percentiles_reaching, reach, reaching
from .ranks import attach, percentiles
from .stats import weighted_tail_mean_band


def cumulative_matrix(entities: DataFrame, events: DataFrame, start: float, step: float, n: int) -> DataFrame:
    """Events up to each grid point start + i * step, i < n, for every trajectory: counts by the first grid point at or after the event,
    then a running sum over the dense grid."""
    i = F.greatest(F.lit(0), F.ceil((F.col("t") - start) / step)).cast("long")
    i = F.when((i > 0) & (start + (i - 1) * step >= F.col("t")), i - 1).otherwise(F.when(start + i * step < F.col("t"), i + 1).otherwise(i))
    counts = events.select("traj_id", i.alias("i")).filter(F.col("i") < n).groupBy("traj_id", "i").agg(F.count("*").alias("c"))
    dense = entities.select("traj_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i"))
    w = Window.partitionBy("traj_id").orderBy("i")
    return dense.join(counts, ["traj_id", "i"], "left").select("traj_id", "i", (F.lit(float(start)) + F.col("i") * F.lit(float(step))).alias("g"), F.sum(F.coalesce("c", F.lit(0))).over(w).cast("long").alias("y"))


def mean_cumulative(entities: DataFrame, events: DataFrame, evals: DataFrame) -> DataFrame:
    """Mean over all trajectories of the events up to each evaluation time ``g``; nothing is expanded by trajectory."""
    steps = small(evals.select("g").distinct())
    total = entities.agg(F.count("*").alias("N"))
    w = Window.orderBy("g")  # one row an evaluation time
    bounds = steps.withColumn("low", F.lag("g").over(w))
    hits = events.groupBy("t").agg(F.count("*").alias("c")).join(F.broadcast(bounds), (F.col("t") <= F.col("g")) & (F.col("low").isNull() | (F.col("t") > F.col("low"))), "right")
    per = hits.groupBy("g").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"))
    return per.withColumn("s", F.sum("c").over(w)).crossJoin(F.broadcast(total)).select("g", (F.col("s") / F.col("N")).alias("mean"))


def median_cumulative(matrix: DataFrame) -> DataFrame:
    return percentiles(matrix, ["g"], "y", {"median": 0.5})


def l2_distance(a: DataFrame, b: DataFrame, on: str, accepted: int | None = None, least: int = 80) -> DataFrame:
    """Mean squared difference of columns a and b, plus a penalty if fewer than ``least`` were accepted."""
    d = a.join(b, on).agg(F.avg(F.pow(F.col("a") - F.col("b"), F.lit(2))).alias("l2"))
    return d if accepted is None or accepted >= least else d.withColumn("l2", F.col("l2") + float((least - accepted) ** 2))


def tail_mean_band(matrix: DataFrame, p: float, by: str = "g", value: str = "y") -> DataFrame:
    """Mean, and means of the lowest and highest tails of share (1 - p) / 2, drawn in by p^0.7. Works on run lengths: groups hold one
    row for each different value."""
    runs = matrix.groupBy(by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    up = w.orderBy(value)
    runs = runs.withColumn("N", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(up))
    m = F.greatest(F.lit(1), F.ceil(F.col("N") * F.lit((1 - p) / 2))).cast("long")
    low = F.greatest(F.lit(0), F.least(F.col("c"), m - (F.col("upto") - F.col("c"))))
    high = F.greatest(F.lit(0), F.least(F.col("c"), F.col("upto") - (F.col("N") - m)))
    out = runs.groupBy(by).agg((F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), (F.sum(F.col(value) * low) / F.sum(low)).alias("lo"), (F.sum(F.col(value) * high) / F.sum(high)).alias("hi"))
    if p >= 0.999:
        return out.select(by, "mean", F.col("mean").alias("lo"), F.col("mean").alias("hi"))
    s = p**0.7
    return out.select(by, "mean", (F.col("mean") + (F.col("lo") - F.col("mean")) * s).alias("lo"), (F.col("mean") + (F.col("hi") - F.col("mean")) * s).alias("hi"))


def cond_cumulative(first: DataFrame, events: DataFrame, t_star: float, Ts: DataFrame, start: float, step: float, n: int) -> DataFrame:
    """For each T the mean number of events since t_star by relative time, over trajectories that stay quiet for T."""
    quiet = lambda T: F.col("first_post").isNull() | (F.col("first_post") > T)
    reached = reach(first.select("traj_id", "first_post"), Ts, quiet)
    total = reaching(reached, Ts, [], {"N": F.count("*")}).filter("N > 0").select("T", "N")
    rel = events.filter(F.col("t") > t_star).select("traj_id", F.greatest(F.lit(0), F.ceil((F.col("t") - t_star - start) / step)).cast("long").alias("i"))
    own = rel.groupBy("traj_id", "i").agg(F.count("*").alias("c")).join(reached.select("traj_id", "__i"), "traj_id")
    hits = reaching(own, Ts, ["i"], {"c": F.sum("c")}).select("T", "i", "c")
    dense = total.select("T", "N", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i"))
    w = Window.partitionBy("T").orderBy("i")
    return dense.join(hits, ["T", "i"], "left").select("T", (F.lit(float(start)) + F.col("i") * F.lit(float(step))).alias("g"), (F.sum(F.coalesce("c", F.lit(0))).over(w) / F.col("N")).alias("mean"), F.col("N").alias("n"))


def first_crossing(curve: DataFrame, level: float, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """First x with y >= level, interpolated from the point before; no row for a curve that never gets there."""
    w = Window.partitionBy(*keys).orderBy(x)
    c = curve.withColumn("px", F.lag(x).over(w)).withColumn("py", F.lag(y).over(w)).filter(F.col(y) >= level)
    at = F.when(F.col("px").isNull() | (F.col("py") >= level) | (F.col(y) == F.col("py")), F.col(x)).otherwise(F.col("px") + (level - F.col("py")) * (F.col(x) - F.col("px")) / (F.col(y) - F.col("py")))
    return c.groupBy(*keys).agg(F.min_by(at, F.col(x)).alias("crossing"))


def acceptance_ratio_path(first: DataFrame, grid: DataFrame, processed: Column | int) -> DataFrame:
    """Survivors of each T over the processed total. Each first event is counted at the first T that it doesn't survive, so a row for
    each trajectory and T is never made; the grid is one array."""
    grid_row = F.broadcast(grid.agg(F.array_sort(F.collect_set("T")).alias("__ts")))
    at = F.when(F.col("first_post").isNull(), F.size("__ts")).otherwise(F.size(F.filter("__ts", lambda x: x < F.col("first_post"))))
    ended = first.crossJoin(grid_row).groupBy(at.alias("__i")).agg(F.count("*").alias("__n"))
    slots = grid_row.select(F.posexplode(F.concat("__ts", F.array(F.lit(None).cast("double")))).alias("__i", "T"))  # the last slot: those who survive all
    left = slots.join(ended, "__i", "left").withColumn("__later", F.coalesce(F.sum("__n").over(Window.orderBy(F.col("__i").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a T
    return left.filter("T IS NOT NULL").select("T", (F.col("__later") / processed).alias("ratio"))


def horizon_days(obs: DataFrame, windows: DataFrame, safety: float = 1.0) -> DataFrame:
    """Per series: the later of the observed span and the last window's end, plus the largest gap and a margin, in whole days."""
    w = Window.partitionBy("series_id").orderBy("d")
    gaps = obs.withColumn("gap", F.lead("d").over(w) - F.col("d")).groupBy("series_id").agg((F.max("d") - F.min("d")).alias("span"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap"))
    ends = windows.groupBy("series_id").agg(F.max("t_max").alias("end"))
    return gaps.join(ends, "series_id", "left").select("series_id", F.ceil(F.greatest("span", F.coalesce("end", F.lit(0.0))) + F.ceil("gap") + safety).cast("long").alias("horizon"))


def segment_grid(snaps: DataFrame, step: float) -> DataFrame:
    """Rows (snap_id, T, x) for snapshots (snap_id, t_star, next_t): quiet times from 0 to the next snapshot in even steps of about ``step``,
    and the time x on the common axis. Snapshots without a time to come have none."""
    n = F.greatest(F.lit(1), F.floor(F.col("next_t") / step) + 1)
    rows = snaps.filter("next_t > 0").withColumn("n", n).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    T = F.when(F.col("n") > 1, F.col("next_t") * F.col("j") / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(0.0)
    return rows.select("snap_id", T.alias("T"), (F.col("t_star") + T).alias("x"))


def snapshot_first_post(entities: DataFrame, events: DataFrame, snaps: DataFrame) -> DataFrame:
    """Rows (snap_id, traj_id, first_post) of every entity and snapshot (snap_id, t_star): time to the first event after the cutoff. Each event
    meets the snapshots once, in the task that reads it, and only the least time of each pair is shuffled."""
    after = events.crossJoin(F.broadcast(snaps.select("snap_id", "t_star"))).filter(F.col("t") > F.col("t_star"))
    least = after.groupBy("snap_id", "traj_id").agg(F.min(F.col("t") - F.col("t_star")).alias("first_post"))
    return entities.crossJoin(F.broadcast(snaps.select("snap_id"))).join(least, ["snap_id", "traj_id"], "left")


def _survivors(first: DataFrame, grid: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Draws that are still quiet at each T; a grid with the keys has points of its own for each of them."""
    own = [k for k in keys if k in grid.columns]
    rows = first.join(grid, own) if own else first.crossJoin(F.broadcast(grid))
    return rows.filter(F.col("first_post").isNull() | (F.col("first_post") > F.col("T")))


def timepath(first: DataFrame, metrics: list[str], grid: DataFrame, probs: tuple[float, ...] = (0.05, 0.5, 0.95), keys: tuple[str, ...] = ()) -> DataFrame:
    """Of each T and metric percentiles over the draws that are still quiet; ``first`` has draws joined with first_post. With keys, as of
    snapshots, the grid may have them too."""
    rows = reach(first, grid, lambda T: F.col("first_post").isNull() | (F.col("first_post") > T), keys)
    long = rows.unpivot([*keys, "__i"], metrics, "metric", "value")
    out = percentiles_reaching(long, grid, [*keys, "metric"], "value", {f"q{round(p * 1000):03d}": p for p in probs}, "n")
    return out.select(*keys, "T", "metric", "n", *[c for c in out.columns if c not in (*keys, "T", "metric", "n")])


def timepath_weighted(first: DataFrame, metric: str, grid: DataFrame, sigma: float, level: float = 0.9, keys: tuple[str, ...] = ()) -> DataFrame:
    """Of each T the weighted mean and tail-mean band of a metric over survivors with an event still to come, by how near it is to T. Equal
    weights where all of these are 0, and over all survivors where none has an event. n counts survivors. Keys as in timepath()."""
    at = [*keys, "T"]
    ends = F.col("first_post").isNotNull()
    rows = _survivors(first, grid, keys).select(*at, metric, ends.alias("__ends"), gaussian_distance_weight(F.col("first_post") - F.col("T"), sigma).alias("__w"))
    sums = rows.groupBy(*at).agg(F.count("*").alias("n"), F.max("__ends").alias("__any"), F.sum("__w").alias("__sum"))
    one = F.when(F.col("__sum") > 0, F.col("__w")).otherwise(1.0)
    weighted = attach(rows, sums, at).withColumn("__w", F.when(F.col("__ends"), one).when(~F.col("__any"), 1.0).otherwise(0.0))
    return attach(sums.select(*at, "n"), weighted_tail_mean_band(weighted, at, metric, "__w", level), at).select(*at, "n", "mean", "lo", "hi")


def chronological(snaps: DataFrame) -> DataFrame:
    return snaps.orderBy("t_star", "snap_id")


def next_gap(snaps: DataFrame, horizon: float) -> DataFrame:
    """Adds next_t (to the next snapshot; the last has the horizon), offset (sum of those before) and segment_end."""
    w = Window.partitionBy("series_id").orderBy("t_star", "snap_id")
    out = snaps.withColumn("next_t", F.coalesce(F.lead("t_star").over(w) - F.col("t_star"), F.lit(float(horizon))))
    out = out.withColumn("offset", F.coalesce(F.sum("next_t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return out.withColumn("segment_end", F.col("t_star") + F.col("next_t"))


def running_total(obs: DataFrame) -> DataFrame:
    return obs.withColumn("total", F.sum("n").over(Window.partitionBy("series_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))


def infer_pairs(events: DataFrame, t_star: float, order: str = "event_id") -> DataFrame:
    """Consecutive event times around t_star."""
    w = Window.partitionBy("traj_id").orderBy("t", order)
    return events.withColumn("prev", F.lag("t").over(w)).filter((F.col("prev") <= t_star) & (F.col("t") > t_star)).select("traj_id", "prev", F.col("t").alias("cur"))


def trapezoid_area(curve: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(x)
    step = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return curve.withColumn("__a", step).groupBy(*keys).agg(F.coalesce(F.sum("__a"), F.lit(0.0)).alias("area"))


def pool(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def online_curve(curves: DataFrame, snaps: DataFrame) -> DataFrame:
    """Snapshot curves (series_id, snap_id, T, p) in absolute time, each up to where the next begins, with the value there."""
    s = snaps.select("series_id", "snap_id", "offset", "next_t")
    c = curves.join(s, ["series_id", "snap_id"])
    w = Window.partitionBy("series_id", "snap_id").orderBy("T")
    c = c.withColumn("pT", F.lag("T").over(w)).withColumn("pp", F.lag("p").over(w))
    at = F.when((F.col("T") >= F.col("next_t")) & (F.coalesce("pT", F.lit(-1.0)) < F.col("next_t")), F.when(F.col("pT").isNull() | (F.col("T") == F.col("next_t")), F.col("p")).otherwise(F.col("pp") + (F.col("p") - F.col("pp")) * (F.col("next_t") - F.col("pT")) / (F.col("T") - F.col("pT"))))
    c = c.withColumn("end", F.max(at).over(Window.partitionBy("series_id", "snap_id")))
    return c.filter(F.col("T") <= F.col("next_t")).select("series_id", "snap_id", (F.col("offset") + F.col("T")).alias("x"), "p", F.col("end").alias("p_end"))
