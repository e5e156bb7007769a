"""Statistics over nested sets: of each grid point T the rows that reach it, as trajectories that are still quiet.

The sets shrink as T rises, so a row is told once how many points it reaches. Sums are made by that number and added from the last point down;
percentiles find the bucket of their rank from such sums and look at the rows of that bucket alone. No row is repeated for each point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import attach, between_ranks, dealt, holds_rank


def _points(grid: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """The different points in one array, for each of the keys that the grid has, and those keys."""
    own = [k for k in keys if k in grid.columns]
    # The grid is small: one task gathers it without a shuffle.
    return grid.coalesce(1).groupBy(*own).agg(F.array_sort(F.collect_set(F.col("T").cast("double"))).alias("__ts")), own


def reach(df: DataFrame, grid: DataFrame, there: Callable[[Column], Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds __i, the number of points that the row reaches; ``there`` of a point must not turn true again once it is false. Rows whose keys
    have no point go; a null counts as false."""
    points, own = _points(grid, list(keys))
    return attach(df, points, own).withColumn("__i", F.size(F.filter("__ts", there))).drop("__ts")


def reaching(rows: DataFrame, grid: DataFrame, keys: list[str], sums: dict[str, Column], whole: dict[str, str] | None = None) -> DataFrame:
    """Of each key and point T the sums (whole numbers, by name) over the rows that reach it; ``whole`` names sums over all rows of the key."""
    points, own = _points(grid, keys)
    parts = rows.groupBy(*keys, "__i").agg(*[c.cast("long").alias(n) for n, c in sums.items()])
    # One entry for each number of points, whatever the rows of the key.
    per = attach(parts.groupBy(*keys).agg(F.collect_list(F.struct("__i", *sums)).alias("__parts")).filter(F.size("__parts") > 0), points, own)
    at = per.select(*keys, F.posexplode("__ts").alias("__pos", "T"), "__parts")
    add = lambda of, name: F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[name], F.lit(0).cast("long")))
    here = F.filter("__parts", lambda x: x["__i"] > F.col("__pos"))
    return at.select(*keys, "__pos", "T", *[add(here, n).alias(n) for n in sums], *[add(F.col("__parts"), n).alias(m) for n, m in (whole or {}).items()])


def percentiles_reaching(rows: DataFrame, grid: DataFrame, keys: list[str], value: str, probs: dict[str, float], n: str) -> DataFrame:
    """Exact percentiles over the rows that reach each point, linear between ranks, and their number ``n``, nulls included; points that no row
    reaches have none. Each row is shuffled by its value once, and again only if its bucket holds a rank that is asked for."""
    runs = rows.select(*keys, "__i", F.col(value).cast("double").alias("__v")).groupBy(*keys, "__i", "__v").agg(F.count("*").alias("__c"))
    runs = runs.withColumn("__a", F.when(F.col("__v").isNull(), F.lit(0).cast("long")).otherwise(F.col("__c")))
    runs = dealt(runs, keys, "__v", "__a").drop("__least", "__most")
    buckets = reaching(runs, grid, [*keys, "__bucket"], {"__a": F.sum("__a"), "__c": F.sum("__c")})
    at = Window.partitionBy(*keys, "T")
    up = at.orderBy("__bucket")
    sums = buckets.withColumn("__before", F.sum("__a").over(up) - F.col("__a")).withColumn("__N", F.sum("__a").over(at)).withColumn("__rows", F.sum("__c").over(at))
    total = sums.filter("__rows > 0").select(*keys, "T", "__rows").distinct()
    wanted = F.lit(False)
    for p in probs.values():
        place = (F.col("__N") - 1) * F.lit(float(p))
        for rank in (F.floor(place), F.ceil(place)):
            wanted = wanted | holds_rank(rank, F.col("__before") + F.col("__a"), F.col("__a"))
    hit = sums.filter(wanted).select(*keys, "__bucket", "__pos", "T", "__before", "__N")
    inside = attach(runs, hit, [*keys, "__bucket"]).filter(F.col("__i") > F.col("__pos"))
    inside = inside.groupBy(*keys, "T", "__bucket", "__before", "__N", "__v").agg(F.sum("__a").alias("__a"))
    w = Window.partitionBy(*keys, "T", "__bucket").orderBy("__v")
    found = between_ranks(inside.withColumn("__upto", F.col("__before") + F.sum("__a").over(w)), [*keys, "T"], probs)
    names = [f"__right{i}" for i in range(len(keys) + 1)]
    right = found.withColumnsRenamed(dict(zip([*keys, "T"], names, strict=True)))
    match = [total[k].eqNullSafe(right[m]) for k, m in zip([*keys, "T"], names, strict=True)]
    return total.join(right, match, "left").select(*[total[k] for k in [*keys, "T"]], F.col("__rows").alias(n), *probs)
