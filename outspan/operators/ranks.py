"""Ranks, running sums and exact percentiles by key, without a task that holds a whole key.

Rows with equal values are aggregated first. The others are dealt to buckets that follow the order of the values; sums before a bucket
come from one row a bucket, those inside it from a window over key and bucket. So a key with a third of all rows is spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import is_finite

#: Buckets of equal width between the least and the greatest value of a key, and of equal numbers of ranks.
BUCKETS = 256
#: Further cuts toward both ends, eight for each halving of the distance, for values that crowd at one of them.
TAIL_CUTS, TAIL_BITS = 8, 40


def attach(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``other``, which has one row for each of the keys; null keys meet. Spark broadcasts ``other`` where it is small."""
    if not keys:
        return df.crossJoin(F.broadcast(other))
    names = [f"__key{i}" for i in range(len(keys))]
    right = other.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    match = [df[k].eqNullSafe(right[n]) for k, n in zip(keys, names, strict=True)]
    return df.join(right, match).drop(*names)


def _bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises; null first, not-a-number last."""
    # Halves, so that the width of any two doubles is one too.
    u = (value / 2 - F.col("__least") / 2) / (F.col("__most") / 2 - F.col("__least") / 2)
    u = F.when(F.col("__most") > F.col("__least"), u).otherwise(0.0)
    tail = lambda x: F.floor(F.log2(1 + x * float(1 << TAIL_BITS)) * TAIL_CUTS)
    inner = F.floor(u * BUCKETS) + tail(u) - tail(1 - u)
    last = BUCKETS + 2 * TAIL_CUTS * (TAIL_BITS + 1)
    return F.when(value.isNull(), -last - 1).when(F.isnan(value), last + 1).when(value == float("-inf"), -last).when(value == float("inf"), last).otherwise(inner).cast("long")


def dealt(rows: DataFrame, keys: list[str], value: str, amount: str) -> DataFrame:
    """Adds __bucket, which never falls as the value rises within a key, and the key's least and greatest finite value."""
    # The amount is named here too, so that this reads the same columns as what follows and Spark runs ``rows`` once for both.
    finite = F.when(is_finite(value) & (F.col(amount) >= 0), F.col(value))
    ends = rows.groupBy(*keys).agg(F.min(finite).alias("__least"), F.max(finite).alias("__most"))
    return attach(rows, ends, keys).withColumn("__bucket", _bucket(F.col(value)))


def cumulated(rows: DataFrame, keys: list[str], value: str, amount: str, upto: str, total: str) -> DataFrame:
    """Adds the sum of ``amount`` over rows (never negative) of the key up to this value, and over all. Each value of a key has one row. Columns __least
    and __most are the key's least and greatest finite value."""
    placed = dealt(rows, keys, value, amount)
    sums = placed.groupBy(*keys, "__bucket").agg(F.sum(amount).alias("__sum"))
    over = Window.partitionBy(*keys)
    before = F.sum("__sum").over(over.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "__bucket", before.alias("__before"), F.sum("__sum").over(over).alias(total))
    inside = F.sum(amount).over(Window.partitionBy(*keys, "__bucket").orderBy(value))
    out = attach(placed, sums, [*keys, "__bucket"])
    return out.withColumn(upto, F.when(F.col("__before").isNull(), inside).otherwise(F.col("__before") + inside)).drop("__bucket", "__before")


def value_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Different finite values with their count c, the count upto them and the total N: what rank-based statistics need."""
    runs = df.filter(is_finite(value)).groupBy(*keys, value).agg(F.count("*").alias("c"))
    return cumulated(runs, keys, value, "c", "upto", "N").drop("__least", "__most")


def holds_rank(rank: Column, upto: Column, amount: Column) -> Column:
    """Whether a run of ``amount`` values, ``upto`` with those before it, has the rank, counted from 0."""
    return (upto > rank) & (upto - amount <= rank)


def between_ranks(runs: DataFrame, keys: list[str], probs: dict[str, float], *more: Column) -> DataFrame:
    """By key the percentiles of runs __v of __a values, __upto with those before them, of __N; further aggregates as given."""
    aggs = list(more)
    for i, p in enumerate(probs.values()):
        at = (F.col("__N") - 1) * F.lit(float(p))
        value = lambda rank: F.max(F.when(holds_rank(rank, F.col("__upto"), F.col("__a")), F.col("__v")))
        aggs += [value(F.floor(at)).alias(f"__lo{i}"), value(F.ceil(at)).alias(f"__hi{i}"), F.max(at).alias(f"__at{i}")]
    out = runs.groupBy(*keys).agg(*aggs)
    for i, name in enumerate(probs):
        lo, hi, at = F.col(f"__lo{i}"), F.col(f"__hi{i}"), F.col(f"__at{i}")
        out = out.withColumn(name, F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)).drop(f"__lo{i}", f"__hi{i}", f"__at{i}")
    return out


def percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], n: str | None = None) -> DataFrame:
    """Exact percentiles by key, linear between ranks, by name; nulls don't count. ``n`` names the number of rows, nulls included."""
    runs = df.select(*keys, F.col(value).cast("double").alias("__v")).groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
    runs = runs.withColumn("__a", F.when(F.col("__v").isNull(), F.lit(0)).otherwise(F.col("__c")))
    r = cumulated(runs, keys, "__v", "__a", "__upto", "__N")
    out = between_ranks(r, keys, probs, F.sum("__c").alias("__n"))
    return out.select(*keys, *([F.coalesce("__n", F.lit(0)).alias(n)] if n else []), *probs)


def shortest_window(df: DataFrame, keys: list[str], value: str, offset: Column) -> DataFrame:
    """Least interval from the j-th to the (j + offset)-th sorted value, the first of equals; offset is a column of N."""
    r = value_runs(df, keys, value).withColumn("__m", offset.cast("long"))
    part = lambda rank: F.floor((rank - 1) * BUCKETS / F.col("N"))
    first = F.col("upto") - F.col("c") + 1
    none = F.lit(None).cast("double")
    # Of starts with equal values the first has the nearest right end, so each run has one start.
    starts = r.withColumn("rank", first + F.col("__m")).filter(F.col("rank") <= F.col("N")).select(*keys, "rank", part(F.col("rank")).alias("__part"), F.col(value).alias("a"), none.alias("b"))
    # A run is there in every part of the ranks that it reaches.
    ends = r.select(*keys, F.col("upto").alias("rank"), F.explode(F.sequence(part(first), part(F.col("upto")))).alias("__part"), none.alias("a"), F.col(value).alias("b"))
    # The right end of a start is the first run whose last rank is at or after it: a running minimum from the largest rank down.
    w = Window.partitionBy(*keys, "__part").orderBy(F.col("rank").desc()).rangeBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(ends).withColumn("end", F.min("b").over(w)).filter(F.col("a").isNotNull())
    return found.groupBy(*keys).agg(F.min(F.struct((F.col("end") - F.col("a")).alias("width"), F.col("a").alias("a"), F.col("end").alias("end"))).alias("s")).select(*keys, F.col("s.a").alias("lo"), F.col("s.end").alias("hi"))
