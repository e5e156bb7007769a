"""Reading and writing of tables, grids and reproducible samples."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import PARAMETERS, Parameter, Parameters


def read_dim(spark: SparkSession, path: str, schema: T.StructType, renames: dict[str, str] | None = None) -> DataFrame:
    """A CSV with a header, key columns renamed."""
    return spark.read.csv(path, header=True, schema=schema).withColumnsRenamed(renames or {})


def observations(points: DataFrame) -> DataFrame:
    """Counts above 0 by time."""
    return points.filter(F.col("n") > 0).orderBy("series_id", "ts")


def edge_log(edges: DataFrame, t_collect: float) -> DataFrame:
    return edges.filter(F.col("parent_t") <= t_collect)


def event_arrays(events: DataFrame) -> DataFrame:
    """One sorted array of times a trajectory, for hand-over at the edge of a job."""
    return events.groupBy("traj_id").agg(F.array_sort(F.collect_list("t")).alias("times"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A summary of few rows as one CSV with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


OPTION_FIELDS = (
    ("objective", "double"), ("accepted", "bigint"), ("sigma_days", "double"), ("beta", "double"), ("neighbor_weight", "double"), ("grid_step_days", "double"),
    ("min_seg_days", "double"), ("kmax", "bigint"), ("baseline_p", "double"), ("alpha", "double"), ("h_max", "double"), ("eps_share", "double"),
    ("include_gap_windows", "boolean"), ("include_union_windows", "boolean"), ("max_unions_to_keep", "bigint"), ("gap_scale", "double"), ("include_global_total", "boolean"),
)


def decode_optimizer_rows(rows: DataFrame, col: str = "fields") -> DataFrame:
    """Positional arrays of numbers to named, typed option columns; integers are rounded, flags are set from one half on."""
    out = []
    for i, (name, kind) in enumerate(OPTION_FIELDS):
        x = F.get(F.col(col), F.lit(i)).cast("double")
        out.append({"double": x, "bigint": F.round(x).cast("bigint"), "boolean": x >= 0.5}[kind].alias(name))
    return rows.select(*[c for c in rows.columns if c != col], *out)


def digest(seed: int, *cols) -> Column:
    """MD5 of seed and columns, joined by colons: the same for any partitioning and engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))


def unit_hash(seed: int, *cols) -> Column:
    """A number in [0, 1): the first 40 bits of the digest."""
    return F.conv(F.substring(digest(seed, *cols), 1, 10), 16, 10).cast("double") / F.lit(float(1 << 40))


def first_n(ids: DataFrame, n: int, *tables: DataFrame) -> list[DataFrame]:
    """Rows of the first n trajectories in each table."""
    few = F.broadcast(ids.select("traj_id").distinct().orderBy("traj_id").limit(n))
    return [t.join(few, "traj_id", "left_semi") for t in tables]


def min_required(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("traj_id").limit(n)


def choose(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """n ids without replacement, all if there are fewer."""
    return ids.orderBy(digest(seed, "traj_id"), "traj_id").limit(n)


#: Rounds of permuted(); each moves about half of all numbers.
SWAPS = 12


def permuted(x: Column, n: int, seed: int, *cols) -> Column:
    """A permutation of 0 to n - 1 by number, without sorting: each round pairs x with k - x modulo n, and a digit of their digest says whether the
    two change places. Seed and ``cols`` choose the permutation."""
    keys = [int(hashlib.md5(f"{seed}:{r}".encode()).hexdigest()[:10], 16) * n >> 40 for r in range(SWAPS)]

    def swap(v: Column, r: Column) -> Column:
        other = (F.get(F.array(*[F.lit(k).cast("long") for k in keys]), r) - v + n) % n
        return F.when(F.substring(digest(seed, *cols, r, F.greatest(v, other)), 1, 1) >= "8", other).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), F.lit(SWAPS - 1)), x.cast("long"), swap)


def numbered(ids: DataFrame, seed: int, key: str = "traj_id", name: str = "row") -> DataFrame:
    """Adds numbers from 0 in the order of the key's hash. They come from the sizes of 1024 parts of the hash, so that nothing is sorted in one task."""
    ids = ids.withColumn("__h", unit_hash(seed, F.col(key))).withColumn("__cell", F.floor(F.col("__h") * 1024))
    sizes = ids.groupBy("__cell").agg(F.count("*").alias("__c"))
    first = sizes.select("__cell", (F.sum("__c").over(Window.orderBy("__cell")) - F.col("__c")).alias("__first"))  # 1024 rows at most
    inside = F.row_number().over(Window.partitionBy("__cell").orderBy("__h", key))
    return ids.join(F.broadcast(first), "__cell").withColumn(name, F.col("__first") + inside - 1).drop("__h", "__cell", "__first")


def latin_hypercube(spark: SparkSession, n: int, priors: list[Parameter], chunks: int = 1, seed: int = 1, scramble: bool = True) -> DataFrame:
    """In each chunk of n draws every parameter has one value in each of n strata of its range."""
    if {p.name for p in priors} != set(PARAMETERS):
        raise ValueError(f"needs {PARAMETERS}")
    df = spark.range(n * chunks).withColumn("chunk", F.floor(F.col("id") / n)).withColumn("row", F.col("id") % n)
    return _stratified(df, n, priors, seed, scramble)


def latin_hypercube_of(ids: DataFrame, priors: list[Parameter], seed: int = 1) -> DataFrame:
    """A draw for each trajectory of ``ids``, all of them one chunk."""
    rows = numbered(ids.select(F.col("traj_id").alias("id"), F.lit(0).cast("long").alias("chunk")), seed, "id")
    return _stratified(rows, max(1, ids.count()), priors, seed, True)


def _stratified(df: DataFrame, n: int, priors: list[Parameter], seed: int, scramble: bool) -> DataFrame:
    for i, p in enumerate(priors):
        if p.fixed:
            df = df.withColumn(p.name, F.lit(float(p.lo)))
            continue
        stratum = permuted(F.col("row"), n, seed, F.lit(i), "chunk") if scramble else F.col("row")
        df = df.withColumn(p.name, F.lit(p.lo) + (stratum + unit_hash(seed + 1, F.lit(i), "id")) / n * (p.hi - p.lo))
    return df.select(F.col("id").alias("traj_id"), "chunk", *PARAMETERS)


def sample_valid(spark: SparkSession, parameters: Parameters, n: int, chunk: int = 10_000, seed: int = 1, most_chunks: int = 1_000_000) -> DataFrame:
    """The first n draws, by number, that all validators accept: hypercubes of ``chunk`` draws are drawn, tested and counted until there are
    enough. A draw follows from seed and number alone, so more chunks or other partitions change none of them. One count a chunk reaches the driver."""
    priors = list(parameters.ranges.values())
    valid = lambda chunks: latin_hypercube(spark, chunk, priors, chunks, seed).filter(parameters.valid())
    chunks = max(1, -(-n // chunk))
    while True:
        counts = sorted((r["chunk"], r["count"]) for r in valid(chunks).groupBy("chunk").count().collect())
        total = sum(c for _, c in counts)
        if total >= n:
            break
        if chunks >= most_chunks:
            raise ValueError(f"{total} of {n} draws are valid after {chunks} chunks")
        chunks = min(most_chunks, max(2 * chunks, -(-chunks * n * 11 // (10 * max(total, 1)))))
    before, cut = 0, 0
    for cut, c in counts:
        if before + c >= n:
            break
        before += c
    kept = valid(cut + 1)
    return kept.filter(F.col("chunk") < cut).unionByName(kept.filter(F.col("chunk") == cut).orderBy("traj_id").limit(n - before))


def grid(spark: SparkSession, start: float, stop: float, step: float, name: str = "T") -> DataFrame:
    """start, start + step, … up to stop."""
    return spark.range(int(round((stop - start) / step)) + 1).select((F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias(name))


def align_prefix(*tables: DataFrame) -> list[DataFrame]:
    """Rows of the trajectories that all tables have."""
    keys = tables[0].select("traj_id").distinct()
    for t in tables[1:]:
        keys = keys.join(t.select("traj_id").distinct(), "traj_id", "left_semi")
    return [t.join(keys, "traj_id", "left_semi") for t in tables]
