"""Spatial risk from weighted points: dimension joins, grids, smoothing and surfaces."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .criteria import small


def join_dims(fact: DataFrame, dims: list[tuple[DataFrame, str]]) -> DataFrame:
    """Inner joins on named keys; dimensions of a checked size are broadcast."""
    for d, key in dims:
        fact = fact.join(small(d), key)
    return fact


def grid_cells(spark: SparkSession, bbox: tuple[float, float, float, float], n: int, buffer: float = 5000.0) -> DataFrame:
    """n by n cells (ix, iy) with their centres over the box (x0, y0, x1, y1) and a buffer."""
    x0, y0, x1, y1 = bbox[0] - buffer, bbox[1] - buffer, bbox[2] + buffer, bbox[3] + buffer
    ids = spark.range(n * n)
    ix, iy = F.floor(F.col("id") / n), F.col("id") % n
    return ids.select(ix.alias("ix"), iy.alias("iy"), (x0 + (ix + 0.5) * (x1 - x0) / n).alias("cx"), (y0 + (iy + 0.5) * (y1 - y0) / n).alias("cy"))


def cell_of(x: Column, lo: float, hi: float, n: int) -> Column:
    """Cell number; the last edge is closed, outside there is none."""
    c = F.least(F.floor((x - lo) / (hi - lo) * n), F.lit(n - 1)).cast("long")
    return F.when(x.between(lo, hi), c)


def weighted_cells(points: DataFrame, bbox: tuple[float, float, float, float], n: int, weight: str = "w") -> DataFrame:
    cells = points.select(cell_of(F.col("x"), bbox[0], bbox[2], n).alias("ix"), cell_of(F.col("y"), bbox[1], bbox[3], n).alias("iy"), F.col(weight).alias("w"))
    return cells.filter("ix IS NOT NULL AND iy IS NOT NULL").groupBy("ix", "iy").agg(F.sum("w").alias("w"))


#: Bands that the height of all polygons is cut to, at most.
BANDS = 4096


def points_in_polygon(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds inside: an odd number of polygon edges (x1, y1, x2, y2) crosses the ray to the right of the point. Points have an id.

    Edges are dealt to bands of height, about as high as an edge is on average, and meet the points of their bands only; which of them
    cross is checked exactly. Sizes of either side are free; level edges cross nothing, points without a place are outside."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    steep = edges.filter(F.col("y1") != F.col("y2"))
    about = steep.agg(F.min(low).alias("lo"), F.max(high).alias("hi"), F.avg(high - low).alias("mean")).first()
    if about["lo"] is None:
        return points.withColumn("inside", F.lit(False))
    tall = max(about["mean"], (about["hi"] - about["lo"]) / BANDS)
    band = lambda y: F.floor((y - about["lo"]) / tall)
    dealt = steep.withColumn("__band", F.explode(F.sequence(band(low), band(high))))
    placed = points.filter(F.col("y").between(about["lo"], about["hi"])).select("id", F.col("x").alias("__x"), F.col("y").alias("__y"), band(F.col("y")).alias("__band"))
    above = (F.col("y1") > F.col("__y")) != (F.col("y2") > F.col("__y"))
    at = (F.col("x2") - F.col("x1")) * (F.col("__y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    hits = placed.join(dealt, "__band").filter(above & (F.col("__x") < at)).groupBy("id").agg((F.count("*") % 2 == 1).alias("inside"))
    return points.join(hits, "id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def population_weights(herds: DataFrame, params: DataFrame, types: list[int], normalise: bool = True) -> DataFrame:
    """w * size^p by type for the selected types, over the mean of the selected unless that is 0."""
    w = herds.filter(F.col("herd_type").isin(types)).join(small(params), "herd_type").withColumn("raw", F.col("weight") * F.pow(F.col("herd_size").cast("double"), F.col("power")))
    if not normalise:
        return w.withColumn("w", F.col("raw"))
    mean = w.agg(F.avg("raw").alias("mean"))
    return w.crossJoin(F.broadcast(mean)).withColumn("w", F.when(F.col("mean") != 0, F.col("raw") / F.col("mean")).otherwise(F.col("raw"))).drop("mean")


def kernel_offsets(spark: SparkSession, kind: str, *, sigma: float = 2.0, a: float = 1.0, gamma: float = 2.0, radius: int | None = None) -> DataFrame:
    """Offsets (dx, dy, kw) of a Gaussian cut at four sigma, or of a power law 1 / (d + a)^gamma within a radius; weights add to 1."""
    r = int(4 * sigma + 0.5) if kind == "gaussian" else (radius or 10)
    side = 2 * r + 1
    ids = spark.range(side * side).select((F.floor(F.col("id") / side) - r).alias("dx"), (F.col("id") % side - r).alias("dy"))
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    raw = F.exp(-d2 / (2 * sigma * sigma)) if kind == "gaussian" else F.when(d2 <= r * r, F.pow(F.sqrt(d2) + a, F.lit(-gamma))).otherwise(0.0)
    k = ids.withColumn("kw", raw).filter("kw > 0")
    total = k.agg(F.sum("kw").alias("s"))
    return k.crossJoin(F.broadcast(total)).select("dx", "dy", (F.col("kw") / F.col("s")).alias("kw"))


def kernel_smooth(cells: DataFrame, kernel: DataFrame, n: int, border: str = "reflect") -> DataFrame:
    """Smoothed cells: each non-empty cell spreads over the kernel's offsets; past the border indices are reflected (…1 0 | 0 1…) or lost."""
    s = cells.crossJoin(F.broadcast(kernel)).withColumn("jx", F.col("ix") + F.col("dx")).withColumn("jy", F.col("iy") + F.col("dy"))

    def fold(c: str) -> Column:
        m = F.pmod(F.col(c), F.lit(2 * n))
        return F.when(m < n, m).otherwise(2 * n - 1 - m)

    if border == "reflect":
        s = s.withColumn("jx", fold("jx")).withColumn("jy", fold("jy"))
    else:
        s = s.filter(F.col("jx").between(0, n - 1) & F.col("jy").between(0, n - 1))
    return s.groupBy(F.col("jx").alias("ix"), F.col("jy").alias("iy")).agg(F.sum(F.col("w") * F.col("kw")).alias("w"))


def risk_surface(infect: DataFrame, suscept: DataFrame, time: float = 1.0, mask: DataFrame | None = None) -> DataFrame:
    """risk = I * S with both over their largest value, and p = 1 - exp(-time * risk); NULL outside the mask (ix, iy). Cells that only
    one surface has are 0."""
    top = lambda df, a: df.crossJoin(F.broadcast(df.agg(F.max("w").alias("top")))).select("ix", "iy", F.when(F.col("top") > 0, F.col("w") / F.col("top")).otherwise(F.col("w")).alias(a))
    both = top(infect, "i").join(top(suscept, "s"), ["ix", "iy"], "full").select("ix", "iy", (F.coalesce("i", F.lit(0.0)) * F.coalesce("s", F.lit(0.0))).alias("risk"))
    out = both.withColumn("p", 1 - F.exp(-time * F.col("risk")))
    if mask is not None:
        m = mask.select("ix", "iy").distinct().withColumn("__in", F.lit(True))
        out = out.join(small(m), ["ix", "iy"], "left").select("ix", "iy", F.when(F.col("__in"), F.col("risk")).alias("risk"), F.when(F.col("__in"), F.col("p")).alias("p"))
    return out


def type_defaults(herds: DataFrame, order: str) -> DataFrame:
    """The first row of each type by an explicit order."""
    return herds.withColumn("__rn", F.row_number().over(Window.partitionBy("herd_type").orderBy(order))).filter("__rn = 1").drop("__rn")


def scale_ratio(lat: float) -> float:
    """Metres of the projection for a metre on the ground at a latitude."""
    return 1 / math.cos(math.radians(lat))
