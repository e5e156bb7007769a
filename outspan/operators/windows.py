"""Acceptance windows from observed counts: clusters, segments, gaps, unions and their bands. Everything is keyed by series_id; times
are days (d) since the series' origin."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import series
from ..functions.expr import wilson_halfwidth
from ..model import WindowOptions

KEY = "series_id"


def _w(order: str = "d") -> Window:
    return Window.partitionBy(KEY).orderBy(order)


def neighbour_gaps(obs: DataFrame) -> DataFrame:
    return obs.withColumn("gap_prev", F.col("d") - F.lag("d").over(_w())).withColumn("gap_next", F.lead("d").over(_w()) - F.col("d"))


def merge_intervals(win: DataFrame, slack: float = 0.0) -> DataFrame:
    """Union of intervals (a, b) that overlap, touch or are at most ``slack`` apart, by series."""
    w = Window.partitionBy(KEY).orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("a") > before + slack), 1).otherwise(0)
    marked = win.withColumn("__new", new)
    island = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(KEY, "__island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("__island")


def close_gaps(win: DataFrame, days: float) -> DataFrame:
    return merge_intervals(win, days)


def max_gap(obs: DataFrame) -> DataFrame:
    gaps = obs.withColumn("gap", F.lead("d").over(_w()) - F.col("d"))
    return gaps.groupBy(KEY).agg(F.ceil(F.coalesce(F.max("gap"), F.lit(0.0))).cast("long").alias("max_gap"))


def top_unions(cand: DataFrame, k: int | Column) -> DataFrame:
    """k candidates of most gain by series; ties by start and end."""
    w = Window.partitionBy(KEY).orderBy(F.col("gain").desc(), "a", "b")
    return cand.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def union_windows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(KEY, "a", "b").union(b.select(KEY, "a", "b")).distinct()


def fold_bounds(cand: DataFrame) -> DataFrame:
    """One bound for each (series, a, b), in the order of ``ord``: the tightest so far, or the loosest where that is empty."""
    step = lambda acc, x: F.when(
        acc.isNull(), F.struct(x["L"].alias("L"), x["U"].alias("U"))
    ).otherwise(
        F.when(F.greatest(acc["L"], x["L"]) <= F.least(acc["U"], x["U"]), F.struct(F.greatest(acc["L"], x["L"]).alias("L"), F.least(acc["U"], x["U"]).alias("U"))).otherwise(
            F.struct(F.least(acc["L"], x["L"]).alias("L"), F.greatest(acc["U"], x["U"]).alias("U"))
        )
    )
    rows = cand.groupBy(KEY, "a", "b").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("L").cast("long").alias("L"), F.col("U").cast("long").alias("U")))).alias("c"))
    start = F.expr("CAST(NULL AS struct<L: bigint, U: bigint>)")
    return rows.withColumn("f", F.aggregate("c", start, step)).select(KEY, "a", "b", F.col("f.L").alias("L"), F.col("f.U").alias("U"))


def observed_mass(obs: DataFrame, win: DataFrame, *also: str) -> DataFrame:
    """Counts by day, each day's split by its overlap with (a, b]; the day of the last observation counts whole. The join is on days
    that a window touches. Windows differ by their ends and the columns ``also``, which stay."""
    days = obs.groupBy(KEY, F.floor("d").cast("long").alias("day")).agg(F.sum("n").alias("c"))
    w = win.select(KEY, "a", "b", *also).distinct().withColumn("day", F.explode(F.sequence(F.floor("a").cast("long"), F.greatest(F.floor("a"), F.ceil("b")).cast("long"))))
    part = F.greatest(F.lit(0.0), F.least(F.col("b"), F.col("day") + 1.0) - F.greatest(F.col("a"), F.col("day").cast("double")))
    return w.join(days, [KEY, "day"], "left").groupBy(KEY, "a", "b", *also).agg(F.sum(F.coalesce("c", F.lit(0)) * part).alias("M"))


def band(mass: DataFrame, total: DataFrame, o: WindowOptions = WindowOptions(), y: str = "M", m: str = "M") -> DataFrame:
    """Lower and upper counts: the share's Wilson half-width relative to it widens the baseline tolerance."""
    z = o.z_alpha
    df = mass.join(total.select(KEY, F.col("N").cast("double").alias("N")), KEY)
    share = F.col(y) / F.col("N")
    h = F.least(F.lit(o.h_max), wilson_halfwidth(share, "N", z) / F.greatest(share, F.lit(o.eps_share)))
    p = F.lit(o.baseline_p) + h
    return df.withColumn("L", F.greatest(F.lit(0), F.floor((1 - p) * F.col(m))).cast("long")).withColumn("U", F.ceil((1 + p) * F.col(m)).cast("long")).drop("N")


def totals(obs: DataFrame) -> DataFrame:
    return obs.groupBy(KEY).agg(F.sum("n").alias("N"), F.min("d").alias("first"), F.max("d").alias("last"))


def cluster_windows(obs: DataFrame, o: WindowOptions = WindowOptions()) -> DataFrame:
    """A window about each observation, half the larger of z * sigma and a share of the neighbouring gaps; overlapping ones merge."""
    z = o.z_beta
    g = neighbour_gaps(obs)
    nw = o.neighbor_weight
    side = F.when(F.col("gap_prev").isNotNull() & F.col("gap_next").isNotNull(), nw * (F.col("gap_prev") + F.col("gap_next")) / 4).otherwise(F.coalesce(nw * F.coalesce("gap_prev", "gap_next") / 2, F.lit(0.0)))
    half = F.greatest(F.lit(z * o.sigma_days), side)
    return merge_intervals(g.select(KEY, (F.col("d") - half).alias("a"), (F.col("d") + half).alias("b")))


def monotone_slopes(obs: DataFrame) -> DataFrame:
    """Knots (d, y) of cumulative counts with the slopes of a monotone cubic: harmonic means inside, one-sided and limited at the ends.
    Needs two different times; other series give no knots."""
    pts = obs.groupBy(KEY, "d").agg(F.sum("n").cast("double").alias("n"))
    w = _w()
    y = pts.withColumn("y", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("c", F.count("*").over(Window.partitionBy(KEY))).filter("c >= 2")
    y = y.withColumn("h1", F.lead("d").over(w) - F.col("d")).withColumn("s1", (F.lead("y").over(w) - F.col("y")) / F.col("h1"))
    y = y.withColumn("h0", F.lag("h1").over(w)).withColumn("s0", F.lag("s1").over(w)).withColumn("h2", F.lead("h1").over(w)).withColumn("s2", F.lead("s1").over(w))
    y = y.withColumn("hm", F.lag("h0").over(w)).withColumn("sm", F.lag("s0").over(w))

    def end(ha, hb, sa, sb):
        m = ((2 * F.col(ha) + F.col(hb)) * F.col(sa) - F.col(ha) * F.col(sb)) / (F.col(ha) + F.col(hb))
        m = F.when(F.col(sb).isNull(), F.col(sa)).when(F.signum(m) != F.signum(sa), 0.0).when((F.signum(sa) != F.signum(sb)) & (F.abs(m) > 3 * F.abs(F.col(sa))), 3 * F.col(sa)).otherwise(m)
        return m

    w1, w2 = 2 * F.col("h1") + F.col("h0"), F.col("h1") + 2 * F.col("h0")
    inner = F.when((F.col("s0") * F.col("s1")) <= 0, 0.0).otherwise((w1 + w2) / (w1 / F.col("s0") + w2 / F.col("s1")))
    slope = F.when(F.col("s0").isNull(), end("h1", "h2", "s1", "s2")).when(F.col("s1").isNull(), end("h0", "hm", "s0", "sm")).otherwise(inner)
    return y.select(KEY, "d", "y", slope.alias("m"))


def monotone_interpolant(obs: DataFrame, step: float | Column) -> DataFrame:
    """The cubic on a grid of ``step`` from the first to the last observation."""
    w = _w()
    k = monotone_slopes(obs).withColumn("d1", F.lead("d").over(w)).withColumn("y1", F.lead("y").over(w)).withColumn("m1", F.lead("m").over(w)).withColumn("first", F.min("d").over(Window.partitionBy(KEY)))
    k = k.filter(F.col("d1").isNotNull() | (F.col("d") > F.col("first")))
    lo = F.ceil((F.col("d") - F.col("first")) / step - 1e-9).cast("long")
    hi = F.when(F.col("d1").isNull(), lo).otherwise(F.ceil((F.col("d1") - F.col("first")) / step - 1e-9).cast("long") - 1)
    g = k.withColumn("lo", lo).withColumn("hi", hi).filter("hi >= lo").withColumn("i", F.explode(F.sequence("lo", "hi")))
    x = F.col("first") + F.col("i") * step
    g = g.withColumn("x", x).filter(F.col("d1").isNotNull() | (F.abs(F.col("x") - F.col("d")) < 1e-9))
    h = F.coalesce(F.col("d1") - F.col("d"), F.lit(1.0))
    t = F.greatest(F.lit(0.0), (F.col("x") - F.col("d")) / h)
    h00, h10, h01, h11 = 2 * t**3 - 3 * t**2 + 1, t**3 - 2 * t**2 + t, 3 * t**2 - 2 * t**3, t**3 - t**2
    v = h00 * F.col("y") + h10 * h * F.col("m") + h01 * F.coalesce("y1", "y") + h11 * h * F.coalesce("m1", F.lit(0.0))
    return g.select(KEY, "i", "x", v.alias("v"))


def _rows(obs: DataFrame) -> DataFrame:
    return obs.select(KEY, F.col("d").cast("double").alias("d"), F.col("n").cast("double").alias("n"))


def _schema(df: DataFrame, *columns: str, key: str = KEY) -> T.StructType:
    """The key and further columns, as "name type"."""
    kinds = {"double": T.DoubleType(), "long": T.LongType()}
    return T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(*c.split()[:1], kinds[c.split()[1]]) for c in columns)])


def _table(key: pa.ChunkedArray, **columns: np.ndarray) -> pa.Table:
    return pa.table({KEY: key, **columns})


def segment_windows(obs: DataFrame, o: WindowOptions = WindowOptions()) -> DataFrame:
    """Ends of the best fit of the interpolant by 1 to kmax chords, each at least min_seg_days and two steps long, none for a shorter series; the number by
    n log(mse) + 2 K log n. One small dynamic programme a series, over its grid, which is made where the programme runs."""

    def kernel(table: pa.Table, start: np.ndarray) -> Iterator[pa.Table]:
        s = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(table))))
        each = lambda v: np.full(len(start), v)
        g, a, b = series.segments(s, series.floats(table["d"]), np.nan_to_num(series.floats(table["n"])), each(o.grid_step_days), each(o.min_seg_days), each(o.kmax))
        yield _table(table[KEY].take(pa.array(start[g])), a=a, b=b)

    return series.by_series(_rows(obs).filter("d IS NOT NULL"), [KEY], ["d"], kernel, _schema(obs, "a double", "b double"))


def gap_windows(clusters: DataFrame, scale: float | Column) -> DataFrame:
    """A window in the middle of each gap between clusters, half at most the scaled gap and half the median cluster; slivers are left out."""
    w = Window.partitionBy(KEY)
    g = clusters.withColumn("next", F.lead("a").over(w.orderBy("a"))).withColumn("med", F.percentile(F.col("b") - F.col("a"), F.lit(0.5)).over(w))
    half = F.least(scale * (F.col("next") - F.col("b")), F.col("med") / 2)
    mid = F.when(F.col("next").isNotNull() & (half > 1e-3), (F.col("b") + F.col("next")) / 2)
    return g.select(KEY, (mid - half).alias("a"), (mid + half).alias("b")).filter("a IS NOT NULL")


def union_candidates(bands: DataFrame, obs: DataFrame, o: WindowOptions = WindowOptions(), longest: int = 5) -> DataFrame:
    """Runs of up to five consecutive windows without a gap above a day, with the bound of the union and what it gains on the sum."""
    w = Window.partitionBy(KEY).orderBy("a", "b")
    r = bands.select(KEY, "a", "b", "L", "U").withColumn("breaks", F.when(F.col("a") - F.lag("b").over(w) > 1, 1).otherwise(0)).withColumn("run", F.sum("breaks").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Each window carries the runs that begin with it, so nothing is joined.
    ends = [F.when(F.lead("run", k).over(w) == F.col("run"), F.struct(F.lead("b", k).over(w).alias("b"), *[F.sum(c).over(w.rowsBetween(0, k)).alias(f"sum{c}") for c in ("L", "U")])) for k in range(longest)]
    runs = r.withColumn("ends", F.array(*ends)).select(KEY, "a", F.explode(F.filter("ends", lambda e: e.isNotNull())).alias("e")).select(KEY, "a", "e.*")
    own = band(observed_mass(obs, runs, "sumL", "sumU"), totals(obs), o)
    c = own.withColumn("L", F.greatest("L", "sumL")).withColumn("U", F.least("U", "sumU"))
    c = c.withColumn("gain", (F.col("sumU") - F.col("sumL")) - (F.col("U") - F.col("L"))).filter((F.col("gain") > 0) & (F.col("L") <= F.col("U")))
    return top_unions(c, o.max_unions_to_keep).select(KEY, "a", "b", "L", "U", "gain")


def option_arrays(options: list[dict]) -> dict[str, np.ndarray]:
    """Fields of options, with the normal quantiles z_alpha and z_beta, as arrays over them."""
    return {k: np.array([o[k] for o in options]) for k in (*(f.name for f in fields(WindowOptions)), "z_alpha", "z_beta")}


def acceptance_windows(obs: DataFrame, o: WindowOptions = WindowOptions()) -> DataFrame:
    """Acceptance bounds (a, b, L, U) of each series: bands of clusters, segments and gaps, unions, the total, folded by interval. A series is dealt to a task once, as
    its observations, and all steps run there over batches of series (``functions/series.py``)."""
    own = option_arrays([asdict(o) | {"z_alpha": o.z_alpha, "z_beta": o.z_beta}])

    def kernel(table: pa.Table, start: np.ndarray) -> Iterator[pa.Table]:
        s = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(table))))
        seen = series.Observed(s, series.floats(table["d"]), series.floats(table["n"]), len(start))
        for part, (g, a, b, L, U) in seen.windows(np.arange(len(start)), {k: np.repeat(v, len(start)) for k, v in own.items()}):
            yield _table(table[KEY].take(pa.array(start[part][g])), a=a, b=b, L=L, U=U)

    return series.by_series(_rows(obs).filter(F.col(KEY).isNotNull()), [KEY], ["d"], kernel, _schema(obs, "a double", "b double", "L long", "U long"))


def segment_bands(obs: DataFrame, win: DataFrame, o: WindowOptions = WindowOptions()) -> DataFrame:
    """Bands whose expected mass is the interpolant's difference; windows with hardly any are skipped. Observations and windows of a series meet in one task."""
    none = F.lit(None).cast("double")
    rows = _rows(obs).select(KEY, F.lit(0).alias("kind"), F.col("d").alias("x"), F.col("n").alias("y"), none.alias("b"))
    rows = rows.unionByName(win.select(KEY, F.lit(1).alias("kind"), F.col("a").cast("double").alias("x"), none.alias("y"), F.col("b").cast("double").alias("b"))).filter(F.col(KEY).isNotNull())
    own = option_arrays([asdict(o) | {"z_alpha": o.z_alpha, "z_beta": o.z_beta}])

    def kernel(table: pa.Table, start: np.ndarray) -> Iterator[pa.Table]:
        s = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(table))))
        kind, x, y, b = table["kind"].to_numpy(), *(series.floats(table[c]) for c in "xyb")
        seen = series.Observed(s[kind == 0], x[kind == 0], y[kind == 0], len(start))
        g, i, t, v = series.interpolant(seen.s, seen.d, seen.n, np.full(len(start), o.grid_step_days))
        points = np.bincount(g, minlength=len(start))
        first = np.cumsum(points) - points
        at = np.flatnonzero((kind == 1) & (points[s] > 0) & ~np.isnan(x) & ~np.isnan(b))
        s, a, b = s[at], x[at], b[at]
        f = first[s]

        def value(c: np.ndarray) -> np.ndarray:
            place = (c - t[f]) / o.grid_step_days
            near = np.trunc(place) + np.where(np.abs(place - np.trunc(place)) >= 0.5, np.sign(place), 0.0)
            return v[f + np.clip(near, 0, points[s] - 1).astype(np.int64)]

        E = value(b) - value(a)
        at = np.flatnonzero(E > 1e-9)
        s, a, b, E = s[at], a[at], b[at], E[at]
        M = seen.days.mass(s, a, b)
        L, U = series.band(M, E, seen.N[s], {k: np.repeat(w, len(s)) for k, w in own.items()})
        yield _table(table[KEY].take(pa.array(start[s])), a=a, b=b, E=E, M=M, L=L, U=U)

    return series.by_series(rows, [KEY], ["kind", "x"], kernel, _schema(obs, "a double", "b double", "E double", "M double", "L long", "U long"))


def with_option(o: WindowOptions, **changes) -> WindowOptions:
    return replace(o, **changes)


def spec_sweep(draws: DataFrame, specs: dict[str, list[str]]) -> DataFrame:
    """Draws that each spec's expressions keep, as rows (spec, draw): one pass over the draws for all specs."""
    flags = [F.when(F.expr(" AND ".join(f"({e})" for e in exprs) or "true"), F.lit(name)) for name, exprs in specs.items()]
    return draws.withColumn("spec", F.explode(F.filter(F.array(*flags), lambda x: x.isNotNull())))
