"""Column expressions: derived metrics, negative-binomial probabilities, time and interval arithmetic."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def C(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def eval_expr(df: DataFrame, name: str, expr: str) -> DataFrame:
    """Adds the value of an SQL expression over the columns; a power is ``power(x, y)``."""
    return df.withColumn(name, F.expr(expr).cast("double"))


def nb_p_zero(R, k) -> Column:
    return F.pow(C(k) / (C(k) + C(R)), C(k))


def nb_pmf(n: int, R, k) -> Column:
    """Negative-binomial probability of n with mean R and dispersion k, by the recurrence in n."""
    p = nb_p_zero(R, k)
    for i in range(1, n + 1):
        p = p * (C(k) + F.lit(float(i - 1))) / F.lit(float(i)) * (C(R) / (C(k) + C(R)))
    return p


def nb_between(a: int, b: int, R, k) -> Column:
    return reduce(lambda x, y: x + y, [nb_pmf(i, R, k) for i in range(a, b + 1)], F.lit(0.0))


def nb_tail_ge(m: int, R, k) -> Column:
    return F.lit(1.0) - nb_between(0, m - 1, R, k)


def euler_lotka_growth(R, a, th) -> Column:
    return (F.pow(C(R), F.lit(1.0) / C(a)) - 1) / C(th)


def derived_metrics(draws: DataFrame) -> DataFrame:
    """Adds what follows from the five parameters."""
    re = F.col("r") * F.col("R0")
    return draws.withColumns(
        {
            "Re": re,
            "reduction": 1 - F.col("r"),
            "gt_mean": F.col("alpha") * F.col("theta"),
            "gt_sd": F.sqrt("alpha") * F.col("theta"),
            "gt_cv": 1 / F.sqrt("alpha"),
            "gt_mode": (F.col("alpha") - 1) * F.col("theta"),
            "R0_k": F.col("R0") / F.col("k"),
            "Re_k": re / F.col("k"),
            "p0": F.pow(F.col("k") / (F.col("k") + re + 1e-12), F.col("k")),
            "growth": euler_lotka_growth("R0", "alpha", "theta"),
            "elasticity": F.col("alpha") * (F.pow(F.col("R0"), 1 / F.col("alpha")) - 1),
        }
    )


def days_since(ts, start, whole: str = "") -> Column:
    """Days between timestamps: fractional, or with ``floor`` or ``ceil``."""
    d = (F.unix_micros(C(ts).cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86400e6)
    return {"": d, "floor": F.floor(d), "ceil": F.ceil(d)}[whole]


def day_floor(ts) -> Column:
    return F.date_trunc("day", C(ts))


def day_ceil(ts) -> Column:
    """The next midnight; midnight itself stays."""
    floor = day_floor(ts)
    return F.when(C(ts) == floor, floor).otherwise(floor + F.expr("INTERVAL 1 DAY"))


def z_value(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)


def wilson_halfwidth(p, n, z: float) -> Column:
    n = C(n)
    return F.when(n > 0, z * F.sqrt(C(p) * (1 - C(p)) / n + z * z / (4 * n * n)) / (1 + z * z / n))


def wilson_interval(p, n, z: float) -> tuple[Column, Column]:
    """Bounds in [0, 1]; NULL without trials."""
    n = C(n)
    centre = F.when(n > 0, (C(p) + z * z / (2 * n)) / (1 + z * z / n))
    half = wilson_halfwidth(p, n, z)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def interp_array(values, x, h: float) -> Column:
    """Linear interpolation of an array on the grid 0, h, 2h, …, held constant outside."""
    v, pos = C(values), C(x) / h
    last = F.size(v) - 1
    i = F.greatest(F.lit(0), F.least(F.floor(pos).cast("int"), last))
    j = F.least(i + 1, last)
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), pos - i))
    return F.get(v, i) * (1 - w) + F.get(v, j) * w


def gaussian_distance_weight(d, sigma: float) -> Column:
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    return F.when(is_finite(d), F.exp(-0.5 * F.pow(C(d) / sigma, F.lit(2)))).otherwise(0.0)


def expand_interval(lo, hi, f: float) -> tuple[Column, Column]:
    mid, half = (C(lo) + C(hi)) / 2, (C(hi) - C(lo)) / 2 * f
    return mid - half, mid + half


def web_mercator(lon, lat) -> tuple[Column, Column]:
    radius = 6378137.0
    return radius * F.radians(C(lon)), radius * F.log(F.tan(F.lit(3.141592653589793 / 4) + F.radians(C(lat)) / 2))


def surface_norm(df: DataFrame, col: str, kind: str, out: str) -> DataFrame:
    """Adds the value scaled: linear (as is), max (by the largest, unless it is 0), sigmoid, or 1 - exp(-x)."""
    x = F.col(col)
    if kind == "max":
        top = df.agg(F.max(x).alias("__top"))
        return df.crossJoin(F.broadcast(top)).withColumn(out, F.when(F.col("__top") > 0, x / F.col("__top")).otherwise(x)).drop("__top")
    return df.withColumn(out, {"linear": x, "sigmoid": 1 / (1 + F.exp(-x)), "exp": 1 - F.exp(-x)}[kind])


def options_merge(base: Column, override: Column) -> Column:
    """Entries of both maps; those of ``override`` win."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(override, k)), override)


def options_scale(options: Column, names: list[str], factor: float) -> Column:
    return F.transform_values(options, lambda k, v: F.when(k.isin(names), v * factor).otherwise(v))


def ultimate_extinction(R, k, steps: int = 200) -> Column:
    """Least fixed point of q = (b / (b + 1 - q))^k with b = k / R, from q = 0; 1 where R <= 1."""
    b = C(k) / C(R)
    q = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), lambda acc, _: F.pow(b / (b + 1 - acc), C(k)))
    return F.when(C(R) <= 1, F.lit(1.0)).otherwise(q)


def is_finite(x) -> Column:
    c = C(x)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite_only(df: DataFrame, col: str) -> DataFrame:
    return df.filter(is_finite(col))


def prior_validator(draws: DataFrame, exprs: list[str]) -> DataFrame:
    """Draws for which all expressions hold; an empty list keeps all."""
    return draws.filter(reduce(lambda a, b: a & b, [F.expr(e) for e in exprs], F.lit(True)))
