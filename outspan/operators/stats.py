"""Summaries of samples: quantiles, shortest intervals, weighted bands, densities, goodness of fit. All are by key columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import derived_metrics, is_finite, nb_between, nb_tail_ge
from ..functions.special import normal_cdf
from ..session import ship
from .criteria import small
from .ranks import attach, cumulated, percentiles, shortest_window, value_runs


def to_long(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(ids, metrics, "metric", "value")


def hdi(df: DataFrame, keys: list[str], value: str, mass: float) -> DataFrame:
    """Shortest interval over m = clamp(floor(mass * n), 1, n - 1) steps of the sorted sample; one value is a point."""
    m = F.when(F.col("N") == 1, 0).otherwise(F.least(F.greatest(F.floor(F.col("N") * F.lit(mass)), F.lit(1)), F.col("N") - 1))
    return shortest_window(df, keys, value, m)


def pointwise_hpd(df: DataFrame, keys: list[str], value: str, level: float) -> DataFrame:
    """Shortest interval that holds q = max(1, floor(level * n)) points, cut to [0, 1]."""
    q = F.greatest(F.lit(1), F.floor(F.col("N") * F.lit(level)))
    out = shortest_window(df, keys, value, q - 1)
    return out.withColumn("lo", F.greatest("lo", F.lit(0.0))).withColumn("hi", F.least("hi", F.lit(1.0)))


def equal_tailed(df: DataFrame, keys: list[str], value: str, probs: tuple[float, ...]) -> DataFrame:
    return percentiles(df, keys, value, {f"q{round(p * 1000):03d}": p for p in probs})


def summary_row(df: DataFrame, keys: list[str], value: str, masses: tuple[float, ...]) -> DataFrame:
    """Median, and for each mass the equal-tailed and the shortest interval."""
    probs = [(f"et_lo_{round(m * 100)}", (1 - m) / 2) for m in masses] + [(f"et_hi_{round(m * 100)}", (1 + m) / 2) for m in masses]
    out = percentiles(df, keys, value, {"median": 0.5} | dict(probs), n="n")
    for m in masses:
        h = hdi(df, keys, value, m).withColumnsRenamed({"lo": f"hdi_lo_{round(m * 100)}", "hi": f"hdi_hi_{round(m * 100)}"})
        out = out.join(h, keys)
    return out


METRICS = ("R0", "k", "r", "alpha", "theta", "Re", "reduction", "gt_mean", "gt_sd", "gt_cv", "gt_mode", "R0_k", "Re_k", "p0", "growth", "elasticity", "p_ge_5", "p_ge_10", "p_1_4")


def posterior_table(draws: DataFrame, masses: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Summary of 19 metrics of the draws, and the chance that Re is below 1."""
    full = derived_metrics(draws).withColumn("p_ge_5", nb_tail_ge(5, "R0", "k")).withColumn("p_ge_10", nb_tail_ge(10, "R0", "k")).withColumn("p_1_4", nb_between(1, 4, "R0", "k"))
    table = summary_row(to_long(full, ["traj_id"], list(METRICS)), ["metric"], "value", masses)
    p = full.agg(F.avg((F.col("Re") < 1).cast("double")).alias("p_re_below_1"))
    return table.crossJoin(F.broadcast(p))


def spec_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Median and 95 % interval by spec and quantity."""
    long = to_long(df, ["spec", "traj_id"], metrics)
    return percentiles(long, ["spec", "metric"], "value", {"median": 0.5, "q025": 0.025, "q975": 0.975}, n="n")


def spec_wide(summary: DataFrame, metrics: list[str]) -> DataFrame:
    return summary.groupBy("spec").pivot("metric", metrics).agg(F.first("median"))


def delta_to_baseline(summary: DataFrame, baseline: str, value: str = "median") -> DataFrame:
    """Adds delta to the baseline spec of the same metric; NULL if either is not finite."""
    base = summary.filter(F.col("spec") == baseline).select("metric", F.col(value).alias("__base"))
    d = F.when(is_finite(value) & is_finite("__base"), F.col(value) - F.col("__base"))
    return summary.join(small(base), "metric", "left").withColumn("delta", d).drop("__base")


def interval_report(draws: DataFrame, metrics: list[str], mass: float = 0.8, factor: float = 1.2) -> DataFrame:
    """Shortest interval and the same widened about its middle."""
    h = hdi(to_long(draws, ["traj_id"], metrics), ["metric"], "value", mass)
    mid, half = (F.col("lo") + F.col("hi")) / 2, (F.col("hi") - F.col("lo")) / 2 * factor
    return h.withColumn("wide_lo", mid - half).withColumn("wide_hi", mid + half)


def metric_bounds(df: DataFrame, keys: list[str], value: str, pad: float = 0.08, share: str | None = None) -> DataFrame:
    """Pooled 0.5 % and 99.5 % quantiles, padded; those of the metric ``share`` are cut to [0, 1]."""
    q = percentiles(df.filter(is_finite(value)), keys, value, {"a": 0.005, "b": 0.995})
    lo, hi = F.col("a") - pad * (F.col("b") - F.col("a")), F.col("b") + pad * (F.col("b") - F.col("a"))
    if share:
        cut = F.col(keys[0]) == share
        lo, hi = F.when(cut, F.greatest(lo, F.lit(0.0))).otherwise(lo), F.when(cut, F.least(hi, F.lit(1.0))).otherwise(hi)
    return q.select(*keys, lo.alias("lo"), hi.alias("hi"))


def prob_true(df: DataFrame, expr: str) -> DataFrame:
    return df.agg(F.avg(F.expr(expr).cast("double")).alias("p"))


def _weighted(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    clean = df.filter(is_finite(value) & is_finite(weight) & (F.col(weight) > 0)).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    return cumulated(clean, keys, value, "w", "cum", "total")


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float) -> DataFrame:
    """Least value whose cumulative weight reaches q of the total."""
    return _weighted(df, keys, value, weight).filter(F.col("cum") >= q * F.col("total") - 1e-12).groupBy(*keys).agg(F.min(value).alias("quantile"))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    clean = df.filter(is_finite(value) & is_finite(weight) & (F.col(weight) > 0))
    return clean.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def weighted_tail_mean_band(df: DataFrame, keys: list[str], value: str, weight: str, p: float) -> DataFrame:
    """Weighted mean, and means of the values whose cumulative weight stays within the tail mass (1 - p) / 2 or reaches the total without it, at
    least one value at either end, drawn in by p^0.7."""
    r = _weighted(df, keys, value, weight)
    tail = F.col("total") * F.lit((1 - p) / 2)
    low = (F.col("cum") <= tail) | (F.col(value) == F.col("__least"))
    high = (F.col("cum") >= F.col("total") - tail) | (F.col(value) == F.col("__most"))
    mean = lambda c: F.sum(F.when(c, F.col(value) * F.col("w"))) / F.sum(F.when(c, F.col("w")))
    out = r.groupBy(*keys).agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("mean"), mean(low).alias("lo"), mean(high).alias("hi"))
    s = 0.0 if p >= 0.999 else p**0.7
    return out.select(*keys, "mean", (F.col("mean") + (F.col("lo") - F.col("mean")) * s).alias("lo"), (F.col("mean") + (F.col("hi") - F.col("mean")) * s).alias("hi"))


def binned_stats(hist: DataFrame, keys: list[str], level: float, method: str = "symmetric") -> DataFrame:
    """Mean, median and interval of bin centres (centre, n) as if repeated n times, by ranks in cumulative counts."""
    over = Window.partitionBy(*keys)
    h = hist.filter("n > 0").withColumn("upto", F.sum("n").over(over.orderBy("centre"))).withColumn("__N", F.sum("n").over(over))
    # The value at sorted position r (from 0): the first centre with upto > r.
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("centre")))
    pos = {p: (F.col("__N") - 1) * F.lit(p) for p in (0.5, (1 - level) / 2, (1 + level) / 2)}
    aggs = [(F.sum(F.col("centre") * F.col("n")) / F.sum("n")).alias("mean")]
    for name, p in (("median", 0.5), ("lo", (1 - level) / 2), ("hi", (1 + level) / 2)):
        aggs += [at(F.floor(pos[p])).alias(f"{name}_a"), at(F.ceil(pos[p])).alias(f"{name}_b"), F.max(pos[p] - F.floor(pos[p])).alias(f"{name}_f")]
    out = h.groupBy(*keys).agg(*aggs)
    mix = lambda n: (F.col(f"{n}_a") + F.col(f"{n}_f") * (F.col(f"{n}_b") - F.col(f"{n}_a"))).alias(n)
    out = out.select(*keys, "mean", mix("median"), mix("lo"), mix("hi"))
    if method == "symmetric":
        return out
    full = h.select(*keys, F.col("centre").alias("v"), "upto", "__N", F.col("n").alias("c"))
    m = F.when(F.col("__N") == 1, 0).otherwise(F.least(F.greatest(F.floor(F.col("__N") * F.lit(level)), F.lit(1)), F.col("__N") - 1)).cast("long")
    starts = full.withColumn("rank", F.col("upto") - F.col("c") + 1 + m).filter(F.col("rank") <= F.col("__N")).select(*keys, "rank", F.col("v").alias("a"), F.lit(None).cast("double").alias("b"))
    both = starts.union(full.select(*keys, F.col("upto").alias("rank"), F.lit(None).cast("double"), F.col("v")))
    w = Window.partitionBy(*keys).orderBy(F.col("rank").desc()).rangeBetween(Window.unboundedPreceding, 0)
    best = both.withColumn("end", F.min("b").over(w)).filter("a IS NOT NULL").groupBy(*keys).agg(F.min(F.struct((F.col("end") - F.col("a")).alias("d"), F.col("a").alias("a"), F.col("end").alias("e"))).alias("s"))
    return out.drop("lo", "hi").join(best.select(*keys, F.col("s.a").alias("lo"), F.col("s.e").alias("hi")), keys)


def simultaneous_band(curves: DataFrame, draw: str, x: str, y: str, level: float, eps: float = 1e-9) -> DataFrame:
    """Mean curve with a band of c standard deviations, c so that the share ``level`` of draws stays inside everywhere."""
    m = curves.groupBy(x).agg(F.avg(y).alias("mean"), F.greatest(F.coalesce(F.stddev_samp(y), F.lit(0.0)), F.lit(eps)).alias("sd"))
    z = attach(curves, m, [x]).groupBy(draw).agg(F.max(F.abs(F.col(y) - F.col("mean")) / F.col("sd")).alias("worst"))
    c = percentiles(z, [], "worst", {"c": level})
    cover = z.crossJoin(F.broadcast(c)).agg(F.avg((F.col("worst") <= F.col("c")).cast("double")).alias("coverage"), F.first("c").alias("c"))
    lo, hi = F.col("mean") - F.col("c") * F.col("sd"), F.col("mean") + F.col("c") * F.col("sd")
    return m.crossJoin(F.broadcast(cover)).select(x, "mean", F.greatest(lo, F.lit(0.0)).alias("lo"), F.least(hi, F.lit(1.0)).alias("hi"), "coverage")


def bandwidth(df: DataFrame, keys: list[str], value: str, rule: str = "scott") -> DataFrame:
    """Scott's rule over the sample deviation, or Silverman's over the lesser of the population deviation and the quartile distance / 1.34;
    without a distance between quartiles the deviation alone, and 1 where that is 0 too."""
    base = df.groupBy(*keys).agg((F.stddev_samp(value) if rule == "scott" else F.stddev_pop(value)).alias("sd"), F.count("*").alias("n"))
    shrink = F.pow(F.col("n").cast("double"), F.lit(-0.2))
    if rule == "scott":
        return base.select(*keys, (F.col("sd") * shrink).alias("bw"), "n")
    both = attach(base, percentiles(df, keys, value, {"q1": 0.25, "q3": 0.75}), keys)
    sigma = F.when(F.col("q3") > F.col("q1"), F.least("sd", (F.col("q3") - F.col("q1")) / 1.34)).otherwise(F.col("sd"))
    return both.select(*keys, (0.9 * F.when(sigma == 0, 1.0).otherwise(sigma) * shrink).alias("bw"), "n")


def kernel(u: Column, kind: str) -> Column:
    if kind == "gaussian":
        return F.exp(-0.5 * u * u) / math.sqrt(2 * math.pi)
    return F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0)


def kde(df: DataFrame, keys: list[str], value: str, grid: DataFrame, rule: str = "scott", kind: str = "gaussian", bounds: tuple[float, float] | None = None, method: str = "none", per_bandwidth: int | None = None) -> DataFrame:
    """Kernel density on the grid (column x, of a checked size). Equal values are weighted, not repeated.

    With ``per_bandwidth`` each value is shared between the two nearest nodes, so many to a bandwidth, in the task that reads it, and only nodes
    meet the grid: shuffle and work follow the range in bandwidths, not the sample. The error falls with the square of the number: at 512
    it is below 5e-7 of the kernel's peak for the Gaussian; a kernel with an edge has up to 1.5 / (4 * 512) of the share of values at a grid
    point's edge on top. Values further than 10^15 nodes from 0 are taken there.

    ``reflect`` adds the sample mirrored at both bounds, as far from them as 0.4 of the sample's range, and takes the bandwidth of both
    together; ``truncate`` divides each kernel by its mass inside the bounds. With bounds nothing is outside, and the area counts
    between the grid points inside only. The result has area 1 by the trapezoid rule."""
    if bounds and method == "reflect":
        a, b = bounds
        ends = df.groupBy(*keys).agg((0.4 * (F.max(value) - F.min(value))).alias("__near"))
        ranged = attach(df.select(*keys, value), ends, keys)
        low = ranged.withColumn(value, 2 * a - F.col(value)).filter(F.col(value) > a - F.col("__near"))
        high = ranged.withColumn(value, 2 * b - F.col(value)).filter(F.col(value) < b + F.col("__near"))
        df = ranged.unionByName(low).unionByName(high).drop("__near")
    bw = bandwidth(df, keys, value, rule)
    v = attach(df.select(*keys, value, F.lit(1).alias("c")) if per_bandwidth else df.groupBy(*keys, value).agg(F.count("*").alias("c")), bw, keys)
    weight = F.col("c")
    if bounds and method == "truncate":
        a, b = bounds
        v = v.withColumn("mass", normal_cdf((b - F.col(value)) / F.col("bw")) - normal_cdf((a - F.col(value)) / F.col("bw")))
        weight = F.col("c") / F.greatest("mass", F.lit(1e-15))
    v = v.withColumn("wt", weight)
    if per_bandwidth:
        place = F.least(F.greatest(F.col(value) / (F.col("bw") / per_bandwidth), F.lit(-1e15)), F.lit(1e15))
        v = v.withColumn("__at", place).withColumn("__node", F.floor("__at"))
        ends = [F.struct((F.col("__node") + i).alias("node"), (F.col("wt") * F.abs(1 - i - (F.col("__at") - F.col("__node")))).alias("wt")) for i in (0, 1)]
        v = v.select(*keys, "bw", "n", F.explode(F.array(*ends)).alias("e")).groupBy(*keys, "bw", "n", "e.node").agg(F.sum("e.wt").alias("wt"))
        v = v.withColumn(value, F.col("node") * (F.col("bw") / per_bandwidth))
    rows = v.crossJoin(F.broadcast(grid))
    d = rows.groupBy(*keys, "x").agg((F.sum(F.col("wt") * kernel((F.col("x") - F.col(value)) / F.col("bw"), kind)) / F.max(F.col("n") * F.col("bw"))).alias("density"))
    inside = F.col("x").between(*bounds) if bounds else F.lit(True)
    d = d.withColumn("density", F.when(inside, F.col("density")).otherwise(0.0)).withColumn("__in", inside)
    w = Window.partitionBy(*keys, "__in").orderBy("x")
    area = d.withColumn("a", F.when(F.col("__in"), (F.col("x") - F.lag("x").over(w)) * (F.col("density") + F.lag("density").over(w)) / 2))
    total = area.withColumn("area", F.sum("a").over(Window.partitionBy(*keys)))
    return total.select(*keys, "x", F.when(F.col("area") > 0, F.col("density") / F.col("area")).otherwise(F.col("density")).alias("density"))


def fd_bins(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Freedman-Diaconis number of bins, between 30 and 120."""
    width = 2 * (F.col("q3") - F.col("q1")) * F.pow(F.col("n").cast("double"), F.lit(-1 / 3))
    spans = df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("span"))
    both = attach(spans, percentiles(df, keys, value, {"q1": 0.25, "q3": 0.75}, n="n"), keys)
    return both.select(*keys, F.when(width > 0, F.least(F.greatest(F.ceil(F.col("span") / width), F.lit(30)), F.lit(120))).otherwise(30).cast("long").alias("bins"))


def fit_r1(df: DataFrame, value: str, dist: str, bins: int, lo: float, hi: float) -> DataFrame:
    """1 - SSE / TSS of the density histogram against a density fitted by moments: normal, exponential or lognormal."""
    from .collect import hist1d, hist_density

    h = hist_density(hist1d(df, value, bins, lo, hi), bins, lo, hi)
    x = F.col("centre")
    if dist == "lognormal":
        mom = df.filter(F.col(value) > 0).agg(F.avg(F.log(value)).alias("mu"), F.stddev_pop(F.log(value)).alias("sd"))
        pdf = F.when(x > 0, F.exp(-0.5 * F.pow((F.log(x) - F.col("mu")) / F.col("sd"), F.lit(2))) / (x * F.col("sd") * math.sqrt(2 * math.pi))).otherwise(0.0)
    else:
        mom = df.agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"))
        pdf = F.when(x >= 0, F.exp(-x / F.col("mu")) / F.col("mu")).otherwise(0.0) if dist == "exponential" else F.exp(-0.5 * F.pow((x - F.col("mu")) / F.col("sd"), F.lit(2))) / (F.col("sd") * math.sqrt(2 * math.pi))
    r = h.crossJoin(F.broadcast(mom)).select("density", pdf.alias("pdf"))
    return r.agg((1 - F.sum(F.pow(F.col("density") - F.col("pdf"), F.lit(2))) / (F.sum(F.col("density") * F.col("density")) - F.sum("density") * F.sum("density") / F.count("*"))).alias("r1"))


def ks_distance(df: DataFrame, keys: list[str], value: str, cdf: Column) -> DataFrame:
    """Largest |i / N - F(x_i)| over the sorted sample, i from 1, and the critical value 1.63 / sqrt(N). Of equal values the first and last ranks decide."""
    r = value_runs(df, keys, value).withColumn("F", cdf)
    d = F.greatest(F.abs(F.col("upto") / F.col("N") - F.col("F")), F.abs((F.col("upto") - F.col("c") + 1) / F.col("N") - F.col("F")))
    return r.groupBy(*keys).agg(F.max(d).alias("ks"), (1.63 / F.sqrt(F.max("N"))).alias("critical"))


def chi2_gof(counts: DataFrame, n: str = "n", e: str = "e") -> DataFrame:
    """Chi-squared with cells of expectation below 5 merged into one."""
    cell = F.when(F.col(e) < 5, F.lit("tail")).otherwise(F.col("value").cast("string"))
    m = counts.groupBy(cell.alias("cell")).agg(F.sum(n).alias("o"), F.sum(e).alias("e"))
    return m.agg(F.sum(F.when(F.col("e") > 0, F.pow(F.col("o") - F.col("e"), F.lit(2)) / F.col("e"))).alias("chi2"), F.count("*").alias("cells"))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"))


class Summary:
    """A summary of the user's own over one column, in parts: ``init`` gives an empty state, ``update`` takes a NumPy array of values into it, ``merge`` joins
    two states, ``finish`` makes the number. States must be picklable and small."""

    def __init__(self, init, update, merge, finish):
        self.init, self.update, self.merge, self.finish = init, update, merge, finish


def summarise(df: DataFrame, keys: list[str], value: str, summary: Summary, name: str = "summary", held: int = 100_000) -> DataFrame:
    """By key the summary of the values that are not null; null where finish() gives none. Each task reads its rows once and passes on
    one state a key, or more where it meets over ``held`` keys; only states are shuffled, so a key with most rows stays spread over tasks."""
    import pickle

    import pandas as pd
    import pyarrow as pa
    from pyspark.sql import types as T

    ship(df.sparkSession)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"))
    fields = [f for f in rows.schema.fields if f.name != "__v"]
    partial = T.StructType([*fields, T.StructField("__state", T.BinaryType())])

    def parts(batches):
        states: dict = {}
        schema = None
        for b in batches:
            schema = b.select(keys).schema
            frame = b.to_pandas()
            for key, own in frame.groupby(keys, dropna=False, sort=False)["__v"] if keys else [((), frame["__v"])]:
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                state = states[key] if key in states else summary.init()
                states[key] = summary.update(state, own.dropna().to_numpy())
            if len(states) > held:
                yield flush(states, schema)
        if states:
            yield flush(states, schema)

    def flush(states, schema):
        cols = list(zip(*states, strict=True)) if keys else []
        out = [pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)] + [pa.array([pickle.dumps(s) for s in states.values()], pa.binary())]
        states.clear()
        return pa.RecordBatch.from_arrays(out, names=[*keys, "__state"])

    def join(frame):
        state = summary.init()
        for s in frame["__state"]:
            state = summary.merge(state, pickle.loads(s))
        return pd.DataFrame({**{k: [frame[k].iloc[0]] for k in keys}, name: [summary.finish(state)]})

    states = rows.mapInArrow(parts, partial)
    return states.groupBy(*keys).applyInPandas(join, T.StructType([*fields, T.StructField(name, T.DoubleType())]))
