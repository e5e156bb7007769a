"""Filters on trajectories: counts in windows, outcomes, scenarios, as-of counts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a broadcast table may have.
BROADCAST_ROWS = 50_000


def small(df: DataFrame) -> DataFrame:
    """Marks ``df`` for broadcast if a count proves it small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class IntervalCriterion:
    """Number of events in [t_min, t_max], both closed, lies in [lo, hi]; a root is not counted."""

    t_min: float
    t_max: float
    lo: int
    hi: int

    def aggregate(self) -> Column:
        inside = F.col("t").between(self.t_min, self.t_max)
        return F.coalesce(F.sum(F.when(inside & ~F.col("is_root"), 1)), F.lit(0)).cast("long")

    def holds(self, count: Column) -> Column:
        return count.between(self.lo, self.hi)


def mark_roots(events: DataFrame, order: str = "event_id") -> DataFrame:
    """Adds is_root: the first event of a trajectory, by time and then id."""
    first = events.groupBy("traj_id").agg(F.min(F.struct("t", order)).alias("__first"))
    return events.join(first, "traj_id").withColumn("is_root", (F.col("t") == F.col("__first.t")) & (F.col(order) == F.col(f"__first.{order}"))).drop("__first")


def index_offspring(entities: DataFrame, edges: DataFrame, lo: int, hi: int) -> DataFrame:
    """Trajectories whose root has lo to hi children; ``edges`` has is_root. No children count as 0."""
    counts = edges.filter("is_root").groupBy("traj_id").agg(F.count("*").alias("n"))
    return entities.join(counts, "traj_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).filter(F.col("n").between(lo, hi))


def criteria_counts(entities: DataFrame, events: DataFrame, criteria: list[IntervalCriterion]) -> DataFrame:
    """Counts n0, n1, … of each criterion in one pass, for every trajectory, empty ones too, and ok if all hold."""
    counts = events.groupBy("traj_id").agg(*[c.aggregate().alias(f"n{i}") for i, c in enumerate(criteria)])
    out = entities.join(counts, "traj_id", "left").select("traj_id", *[F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("long").alias(f"n{i}") for i in range(len(criteria))])
    ok = F.lit(True)
    for i, c in enumerate(criteria):
        ok = ok & c.holds(F.col(f"n{i}"))
    return out.withColumn("ok", ok)


def _bucketed(windows: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with (level, bucket) to join on: a window lies in one or two buckets as long as itself, a power of two in days, and a
    point in one bucket of each length that occurs. Longer windows than 2^20 days and open ones have one bucket."""
    days = F.col("t_max") - F.col("t_min")
    level = F.when(days <= 1, 0).when(days <= 2.0**20, F.ceil(F.log2(days))).otherwise(99).cast("int")
    at = lambda t: F.when(F.col("level") == 99, F.lit(0.0)).otherwise(F.floor(F.col(t) / F.pow(F.lit(2.0), F.col("level")))).cast("long")
    w = windows.filter("t_max >= t_min").withColumn("level", level).withColumn("bucket", F.explode(F.sequence(at("t_min"), at("t_max"))))
    levels = [r["level"] for r in w.select("level").distinct().collect()]  # 22 at most
    p = points.filter("t IS NOT NULL").withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("bucket", at("t"))
    return w, p


def window_counts(events: DataFrame, windows: DataFrame, key: str | None = None) -> DataFrame:
    """Events in each closed window by trajectory: a join on buckets of time, so that work follows the matches and not the product.
    Ends may be infinite; with ``key`` windows belong to a series."""
    w, e = _bucketed(windows, events)
    on = ["level", "bucket"] + ([key] if key else [])
    hit = e.join(small(w), on).filter(F.col("t").between(F.col("t_min"), F.col("t_max")))
    return hit.groupBy("traj_id", "win_id").agg(F.count("*").alias("n"))


def criterion_group(entities: DataFrame, events: DataFrame, windows: DataFrame) -> DataFrame:
    """Trajectories that satisfy every row of a window table of any size."""
    counts = window_counts(events.filter(~F.col("is_root")), windows)
    checked = counts.join(small(windows), "win_id")
    # A window without events is met where lo <= 0; those are counted, not expanded.
    met = checked.groupBy("traj_id").agg(F.count_if(F.col("n").between(F.col("lo"), F.col("hi"))).alias("met"), F.count_if(F.col("lo") <= 0).alias("zero_seen"))
    totals = windows.agg(F.count("*").alias("all"), F.count_if((F.col("lo") <= 0) & (F.col("hi") >= 0)).alias("zero"))
    out = entities.join(met, "traj_id", "left").crossJoin(F.broadcast(totals))
    zero_ok = F.col("zero") - F.coalesce("zero_seen", F.lit(0))
    return out.filter(F.coalesce("met", F.lit(0)) + zero_ok == F.col("all")).select("traj_id")


def outcome_label(entities: DataFrame, events: DataFrame, accepted: DataFrame, t_run: float, max_cases: int) -> DataFrame:
    """REJECTED, CAPPED_AT_MAX_CASES, CAPPED_AT_T_RUN or ACCEPTED."""
    cases = events.groupBy("traj_id").agg(F.count("*").alias("cases"), F.max("t").alias("last"))
    ok = accepted.select("traj_id").distinct().withColumn("ok", F.lit(True))
    out = entities.join(cases, "traj_id", "left").join(ok, "traj_id", "left")
    label = F.when(F.col("ok").isNull(), "REJECTED").when(F.col("cases") >= max_cases, "CAPPED_AT_MAX_CASES").when(F.col("last") > t_run, "CAPPED_AT_T_RUN").otherwise("ACCEPTED")
    return out.select("traj_id", F.coalesce("cases", F.lit(0)).cast("long").alias("cases"), label.alias("outcome"))


def first_post(entities: DataFrame, events: DataFrame, t_star: float) -> DataFrame:
    """Time from t_star to the first event after it, NULL without one; and the last event."""
    agg = events.groupBy("traj_id").agg(F.min(F.when(F.col("t") > t_star, F.col("t") - t_star)).alias("first_post"), F.max("t").alias("last_t"))
    return entities.join(agg, "traj_id", "left")


def quiet_for(entities: DataFrame, events: DataFrame, t_star: float, T: float) -> DataFrame:
    """Trajectories without an event in (t_star, t_star + T]; all at T = 0."""
    if T <= 0:
        return entities
    return entities.join(events.filter((F.col("t") > t_star) & (F.col("t") <= t_star + T)), "traj_id", "left_anti")


def observation_prefix(obs: DataFrame, m: int) -> DataFrame:
    return obs.withColumn("rn", F.row_number().over(Window.partitionBy("series_id").orderBy("ts"))).filter(F.col("rn") <= m)


def since_axis_start(snaps: DataFrame, start: float) -> DataFrame:
    return snaps.filter(F.col("t_star") >= start)


def observed_cumulative_at(obs: DataFrame, probes: DataFrame) -> DataFrame:
    """As-of sum: of each probe (series_id, ts) the counts up to and at its time."""
    rows = obs.select("series_id", "ts", F.col("n").cast("long").alias("n"), F.lit(0).alias("probe")).unionByName(probes.select("series_id", "ts", F.lit(0).cast("long").alias("n"), F.lit(1).alias("probe")))
    w = Window.partitionBy("series_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cum", F.sum("n").over(w)).filter("probe = 1").select("series_id", "ts", "cum").distinct()


def apply_scenario(draws: DataFrame, changes: list[tuple[float, str, str | None]], params: tuple[str, ...] = ("R0", "r")) -> DataFrame:
    """Piecewise-constant parameters of each draw: rows (traj_id, t_from, t_to, params). A change (time, parameter, expression) sees the
    current values; an expression of None restores the original."""
    df = draws.select("traj_id", *[F.col(p).alias(f"__o_{p}") for p in params], *params)
    pieces, names = [], list(params)
    ordered = sorted(enumerate(changes), key=lambda c: (c[1][0], c[0]))
    start: float | None = None
    stages = [(None, {p: p for p in names})]
    current = {p: p for p in names}
    for n, (_, (t, param, expr)) in enumerate(ordered):
        col = f"__{param}_{n}"
        if expr is None:
            df = df.withColumn(col, F.col(f"__o_{param}"))
        else:
            shadow = df.select("*", *[F.col(current[p]).alias(f"__v_{p}") for p in names])
            text = expr
            for p in names:
                text = re.sub(rf"\b{p}\b", f"__v_{p}", text)
            df = shadow.withColumn(col, F.expr(text)).drop(*[f"__v_{p}" for p in names])
        current = current | {param: col}
        stages.append((t, dict(current)))
    for i, (t, cols) in enumerate(stages):
        until = stages[i + 1][0] if i + 1 < len(stages) else None
        start = t
        pieces.append(F.struct(F.lit(start).cast("double").alias("t_from"), F.lit(until).cast("double").alias("t_to"), *[F.col(cols[p]).cast("double").alias(p) for p in names]))
    return df.select("traj_id", F.explode(F.array(*pieces)).alias("piece")).select("traj_id", "piece.*")


def params_at(events: DataFrame, pieces: DataFrame) -> DataFrame:
    """The parameters that hold at each event: a change applies from its time on."""
    inside = (F.col("t_from").isNull() | (F.col("t") >= F.col("t_from"))) & (F.col("t_to").isNull() | (F.col("t") < F.col("t_to")))
    return events.join(pieces, "traj_id").filter(inside)


def cluster_of(points: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds cluster: the least win_id with t_min <= t <= t_max, or -1; points have an id."""
    w, p = _bucketed(windows.select("win_id", "t_min", "t_max"), points)
    hit = p.join(small(w), ["level", "bucket"]).filter(F.col("t").between(F.col("t_min"), F.col("t_max"))).groupBy("id").agg(F.min("win_id").alias("cluster"))
    return points.join(hit, "id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
