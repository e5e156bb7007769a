"""Exact nearest codes in Hamming distance by incremental multi-index hashing.

A code of 64 bits has SEGMENTS substrings, each indexed by value. For a query the search radius grows one substring at a time: after
radius r in substrings 0..a and r - 1 in the others every code within distance SEGMENTS * r + a has been seen, because a code further
away in all substrings is further away in sum. A query is done when its kth verified distance is within that bound, so results are
exact; no radius is given up front.

The index is dealt into blocks of distinct codes, and blocks of distinct query codes visit each. Equal codes are one entry with
their k least ids, which is all that a result can hold of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
INDEX_BLOCK, QUERY_BLOCK = 65_536, 8_192
PROBES = 2_000_000  # at once, in a task


def sign_codes(df: DataFrame, vector: str, out: str = "code") -> DataFrame:
    """``df`` with ``out``: bit i is set where component i of the vector is above 0. A null vector has a null code, components beyond
    BITS are left out, missing and null ones count as 0."""
    fields = [f for f in df.schema.fields if f.name not in (vector, out)]
    schema = T.StructType([*fields, T.StructField(out, T.LongType())])

    def run(batches):
        for b in batches:
            codes = []
            for v in b.column(vector).to_pylist():
                codes.append(None if v is None else int(np.uint64(sum(1 << i for i, x in enumerate(v[:BITS]) if x is not None and x > 0)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(codes, pa.int64())], names=schema.fieldNames())

    return df.select(*[df[f.name] for f in fields], df[vector]).mapInArrow(run, schema)


_MASKS = {}


def _masks(r: int) -> np.ndarray:
    if r not in _MASKS:
        _MASKS[r] = np.array([sum(1 << i for i in c) for c in combinations(range(WIDTH), r)], np.int64)
    return _MASKS[r]


def _segments(codes: np.ndarray) -> np.ndarray:
    return np.stack([((codes >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64) for s in range(SEGMENTS)])


def search_block(codes: np.ndarray, copies: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, entry, distance) that hold the k nearest entries, counting copies, of each query, with all ties at the last
    distance. Codes and queries are distinct unsigned integers."""
    seg, qseg = _segments(codes), _segments(queries)
    order = [np.argsort(seg[s], kind="stable") for s in range(SEGMENTS)]
    offsets = [np.searchsorted(seg[s][order[s]], np.arange((1 << WIDTH) + 1)) for s in range(SEGMENTS)]
    weight = np.minimum(copies, k)
    hist = np.zeros((len(queries), BITS + 2), np.int64)
    last = np.full(len(queries), BITS)  # distance of the kth so far
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.arange(len(queries))
    for r in range(WIDTH + 1):
        masks = _masks(r)
        for s in range(SEGMENTS):
            if not len(active):
                break
            step = max(1, PROBES // len(masks))
            for at in range(0, len(active), step):
                q = active[at : at + step]
                values = (qseg[s][q][:, None] ^ masks[None, :]).ravel()
                lo = offsets[s][values]
                n = offsets[s][values + 1] - lo
                some = np.flatnonzero(n)
                n, lo = n[some], lo[some]
                who = np.repeat(q[some // len(masks)], n)
                entry = order[s][np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                d = np.bitwise_count(codes[entry] ^ queries[who]).astype(np.int64)
                new = d <= last[who]
                who, entry, d = who[new], entry[new], d[new]
                for b in range(SEGMENTS):  # each entry counts where it is met first
                    if b != s:
                        fresh = np.bitwise_count(seg[b][entry] ^ qseg[b][who]) >= (r + 1 if b < s else r)
                        who, entry, d = who[fresh], entry[fresh], d[fresh]
                np.add.at(hist, (who, d), weight[entry])
                found.append((who, entry, d))
            full = np.cumsum(hist[active], axis=1) >= k
            last[active] = np.where(full.any(axis=1), full.argmax(axis=1), BITS)
            covered = SEGMENTS * r + s
            active = active[~(full.any(axis=1) & (last[active] <= covered))]
        if not len(active):
            break
    who, entry, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    keep = d <= last[who]
    return who[keep], entry[keep], d[keep]


def nearest(index: DataFrame, queries: DataFrame, k: int = 10, key: str = "id", code: str = "code") -> DataFrame:
    """The k nearest index rows of each query row: query_id, neighbor_id, distance, rank, by distance and then id.

    Rows with a null key or code are left out on either side. Repeated rows are rows of their own; a query that is in the index finds
    itself. With fewer than k rows in the index all are returned; empty tables give empty results."""
    spark = index.sparkSession
    entries = index.filter(index[code].isNotNull() & index[key].isNotNull()).select(index[key].alias("id"), index[code].alias("code"))
    ranked = entries.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("n") <= k)
    listed = materialize(ranked.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    asked = materialize(queries.filter(queries[code].isNotNull() & queries[key].isNotNull()).select(queries[key].alias("query_id"), queries[code].alias("code")), "asked")
    unique = asked.select("code").distinct()
    blocks = max(1, -(-listed.count() // INDEX_BLOCK))
    chunks = max(1, -(-unique.count() // QUERY_BLOCK))
    left = listed.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(blocks))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = unique.withColumn("chunk", F.pmod(F.xxhash64("code", F.lit(7)), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    id_type = entries.schema["id"].dataType
    schema = T.StructType([T.StructField("code", T.LongType()), T.StructField("neighbor_id", id_type), T.StructField("distance", T.IntegerType())])

    def run(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"code": pd.Series([], dtype="int64"), "neighbor_id": pd.Series([], dtype="int64"), "distance": pd.Series([], dtype="int32")})
        codes, asked = mine["code"].to_numpy().view(np.uint64), theirs["code"].to_numpy().view(np.uint64)
        lists = mine["ids"].to_numpy()
        sizes = np.array([len(x) for x in lists])
        who, entry, d = search_block(codes, sizes, asked, k)
        n = sizes[entry]
        flat, first = np.concatenate(lists), np.cumsum(sizes) - sizes
        ids = flat[np.repeat(first[entry] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(n) else flat[:0]
        who, d = np.repeat(who, n), np.repeat(d, n)
        o = np.lexsort((ids, d, who))
        who, d, ids = who[o], d[o], ids[o]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        top = place < k
        return pd.DataFrame({"code": theirs["code"].to_numpy()[who[top]], "neighbor_id": ids[top], "distance": d[top].astype("int32")})

    tops = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(run, schema)
    best = tops.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("distance", "neighbor_id"))).filter(F.col("rank") <= k)
    return asked.join(best, "code").select("query_id", "neighbor_id", "distance", "rank")
