"""Lloyd's clustering of whole-number vectors with heap-ordered bounds.

Vectors live in blocks of BLOCK rows; a block keeps, for each cluster, a heap of its vectors by the gap between the second nearest and the
nearest centroid. A round moves the centroids; a cluster's gaps shrink by its own drift and the largest drift of the others at most,
which is added to the cluster's offset instead of being taken from its vectors. Only vectors whose gap the offset has used up are
popped and compared with all centroids again, exactly; the others can't have changed. Sums of clusters follow the vectors that move.

Blocks are made where the rows are read and never shuffled, so no cluster, however large, meets in a task; what reaches the driver
is one sum a cluster and component.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, scratch

BLOCK = 1024
LARGEST = 1 << 26  # of a component: squared distances of 64 components stay below 2^62
PLAIN = 1 << 21  # up to here products of 64 components are exact in doubles
SLACK = 1e-5  # more than rounding can take from a gap of distances below 2^31


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of v to rows of c, exactly."""
    if v.size and max(np.abs(v).max(), np.abs(c).max()) < PLAIN and v.shape[1] <= 64:
        a, b = v.astype(float), c.astype(float)
        return np.rint((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(1) for x in c], 1) if len(v) else np.zeros((0, len(c)), np.int64)


def _scan(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, the smaller number of equal ones, and the gap to the second nearest."""
    d = squared(v, c)
    near = d.argmin(1)
    least = np.take_along_axis(d, near[:, None], 1)[:, 0]
    if len(c) == 1:
        return near, np.full(len(v), np.inf)
    np.put_along_axis(d, near[:, None], np.iinfo(np.int64).max, 1)
    return near, np.sqrt(d.min(1).astype(float)) - np.sqrt(least.astype(float))


class Block:
    """Vectors with their clusters, and a heap of (gap + offset when it was taken, row) for each cluster."""

    def __init__(self, vectors: bytes, state: bytes | None, dim: int, k: int):
        self.v = np.frombuffer(vectors, np.int32).reshape(-1, dim)
        self.k, n = k, len(self.v)
        if state is None:
            self.at, self.heaps, self.sums = np.full(n, -1, np.int32), [[] for _ in range(k)], np.zeros((k, dim + 1), np.int64)
            return
        parts = np.split(np.frombuffer(state, np.uint8), np.cumsum([4 * n, 8 * n, 4 * n, 4 * k]))
        self.at = parts[0].view(np.int32).copy()
        keys, rows, ends = parts[1].view(float).tolist(), parts[2].view(np.int32).tolist(), np.cumsum(parts[3].view(np.int32)).tolist()
        self.heaps = [list(zip(keys[a:b], rows[a:b], strict=True)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        self.sums = parts[4].view(np.int64).reshape(k, dim + 1).copy()

    def step(self, centroids: np.ndarray, offsets: np.ndarray) -> int:
        """Assigns again what may have changed; the number of rows compared."""
        if len(self.v) and self.at[0] < 0:
            popped = np.arange(len(self.v))
        else:
            popped = []
            for heap, offset in zip(self.heaps, offsets.tolist(), strict=True):
                while heap and heap[0][0] <= offset + SLACK:
                    popped.append(heapq.heappop(heap)[1])
            popped = np.array(popped, np.int64)
        if not len(popped):
            return 0
        near, gap = _scan(self.v[popped].astype(np.int64), centroids)
        moved = near != self.at[popped]
        rows, old, new = popped[moved], self.at[popped[moved]], near[moved]
        counted = np.concatenate([self.v[rows].astype(np.int64), np.ones((len(rows), 1), np.int64)], 1)
        np.add.at(self.sums, new, counted)
        np.subtract.at(self.sums, old[old >= 0], counted[old >= 0])
        self.at[rows] = new
        for row, cluster, key in zip(popped.tolist(), near.tolist(), (gap + offsets[near]).tolist(), strict=True):
            heapq.heappush(self.heaps[cluster], (key, row))
        return len(popped)

    def state(self) -> bytes:
        flat = [x for h in self.heaps for x in h]
        keys, rows = np.array([x[0] for x in flat], float), np.array([x[1] for x in flat], np.int32)
        sizes = np.array([len(h) for h in self.heaps], np.int32)
        return b"".join(x.tobytes() for x in (self.at, keys, rows, sizes, self.sums))


def whole_vectors(df: DataFrame, vector: str, dim: int, scale: int) -> DataFrame:
    """Rows whose vector has exactly ``dim`` components, all there and finite, with __v, floor(scale * x) of each."""
    fine = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.coalesce(fine, F.lit(False))).withColumn("__v", F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _blocks(rows: DataFrame, key: str, dim: int) -> DataFrame:
    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("v", T.BinaryType())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, flat = b.column("id"), b.column("v").flatten().to_numpy(zero_copy_only=False)
            if len(flat) and np.abs(flat).max() > LARGEST:
                raise ValueError(f"a component beyond {LARGEST} after scaling: its squared distances don't fit")
            v = flat.astype(np.int32).reshape(-1, dim)
            for at in range(0, len(v), BLOCK):
                part = ids.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), pa.array([v[at : at + BLOCK].tobytes()], pa.binary())], names=["ids", "v"])

    return rows.select(F.col(key).alias("id"), F.col("__v").alias("v")).mapInArrow(gather, schema)


def _moved(old: list[list[int]], new: list[list[int]], offsets: np.ndarray) -> np.ndarray:
    """Offsets after the centroids' drift: a cluster's own and the largest of the others."""
    drift = np.array([math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))) for a, b in zip(old, new, strict=True)])
    other = np.array([np.delete(drift, i).max(initial=0.0) for i in range(len(drift))])
    return offsets + drift + other


def heap_clusters(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256) -> DataFrame:
    """Rows (key, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each row of ``df`` whose vector has ``dim`` finite
    components.

    Components are floor(scale * x). Centroids start as the k rows with the least SHA-256 of ``seed:key``, of equal ones by their components;
    rows without a key come last. Each of ``rounds`` rounds assigns all vectors to the nearest centroid (ties: the smaller number)
    and moves each centroid that has vectors to the floor of their mean; then they are assigned once more. Fewer rows than k give
    fewer clusters, none gives an empty result. Repeated rows count each. Further columns are dropped. A component beyond 2^26 after
    scaling is an error, as its distance wouldn't fit in a long."""
    spark = df.sparkSession
    rows = whole_vectors(df, vector, dim, scale).select(key, "__v")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), key, "__v").limit(k).select("__v").collect()
    centroids = [list(r["__v"]) for r in first]
    out_schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not centroids:
        return spark.createDataFrame([], T.StructType([*out_schema.fields, T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())]))
    with scratch():
        blocks = _blocks(rows, key, dim)
        schema = T.StructType([*blocks.schema.fields, T.StructField("state", T.BinaryType())])
        names, offsets, n = schema.fieldNames(), np.zeros(len(centroids)), len(centroids)
        blocks = materialize(blocks.withColumn("state", F.lit(None).cast("binary")), "blocks")

        def assigned(blocks: DataFrame, centroids: list[list[int]], offsets: np.ndarray) -> DataFrame:
            c = np.array(centroids, np.int64)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for i in range(b.num_rows):
                        one = b.slice(i, 1)
                        block = Block(one.column("v")[0].as_py(), one.column("state")[0].as_py(), dim, n)
                        block.step(c, offsets)
                        yield pa.RecordBatch.from_arrays([one.column("ids"), one.column("v"), pa.array([block.state()], pa.binary())], names=names)

            return blocks.mapInArrow(run, schema)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n, dim + 1), np.int64)
            for b in batches:
                for s in b.column("state"):
                    total += np.frombuffer(s.as_py()[-8 * n * (dim + 1) :], np.int64).reshape(n, dim + 1)
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total.ravel()[cells], pa.int64())], names=["cell", "x"])

        for _ in range(rounds):
            new = materialize(assigned(blocks, centroids, offsets), "blocks")
            discard(blocks)
            blocks = new
            totals = blocks.select("state").mapInArrow(sums, "cell long, x long").groupBy("cell").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
            total = {r["cell"]: int(r["x"]) for r in totals.collect()}  # clusters times components
            count = [total.get(i * (dim + 1) + dim, 0) for i in range(n)]
            moved = [[total.get(i * (dim + 1) + j, 0) // count[i] for j in range(dim)] if count[i] else centroids[i] for i in range(n)]
            offsets, centroids = _moved(centroids, moved, offsets), moved

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = np.array(centroids, np.int64)
            for b in batches:
                for i in range(b.num_rows):
                    block = Block(b.column("v")[i].as_py(), b.column("state")[i].as_py(), dim, n)
                    block.step(c, offsets)
                    apart = ((block.v.astype(np.int64) - c[block.at]) ** 2).sum(1)
                    yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1).flatten(), pa.array(block.at, pa.int32()), pa.array(apart, pa.int64())], names=out_schema.fieldNames())

        out = materialize(blocks.mapInArrow(last, out_schema), "clusters", keep=True)
    by = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one a cluster
    about = [(i, by[i], sum(by.values()), hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i in sorted(by)]
    return out.join(F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
