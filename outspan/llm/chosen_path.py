"""Jaccard join of word n-grams by chosen paths.

A run gives each token of a set a shared random number; the set follows the tokens whose number is below 1 / (LAMBDA * its size),
and on each path the set chooses again; one that chooses nothing there goes on by a key for that, so no path ends early. Two sets of
similarity LAMBDA or more share, on average, at least one path a level, so a run finds them with a constant chance and RUNS
independent runs with all but MISS, which counts the losses of the sketches too. Buckets (sets with one path) of up to
BUCKET sets are compared, in pairs of blocks of COMPARE sets; larger ones are split by the next level first. What is still large after
LEVELS levels is compared in pairs of blocks too, so no case is dropped.

A bucket compares sketches of the sets and joins those that may be similar into candidate groups. Inside a group all sets are
compared exactly, once, in blocks: links are counted for each set, and classes are the components of the links. Equal sets are one
set throughout; copies are never paired.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, part_count, scratch, small
from .components import connected_components

WORDS_IN_GRAM = 5
LAMBDA = (4, 5)  # similarity, as a fraction
LEVELS = 3
MISS = 5e-5  # chance at most that a pair of similarity LAMBDA or more is not compared exactly; RUNS follows
BUCKET = 4096  # larger buckets are split by the next level
COMPARE = 1024  # sets of one block when a bucket's sketches are compared
BLOCK = 256  # sets of one block of an exact comparison
SKETCH = 128  # minimum hashes of a sketch, a byte each
CANDIDATE = 0.65  # share of equal sketch bytes: four deviations below the threshold

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def sketch_loss() -> float:
    """Chance that the sketches of two sets of similarity LAMBDA have too few equal bytes. All runs share it."""
    same = LAMBDA[0] / LAMBDA[1]
    same += (1 - same) / 256
    return sum(math.comb(SKETCH, k) * same**k * (1 - same) ** (SKETCH - k) for k in range(math.ceil(CANDIDATE * SKETCH)))


def run_miss(levels: int = LEVELS) -> float:
    """Chance at most that a run doesn't keep two sets of similarity LAMBDA together down to the last level.

    The worst case is a set inside the other: what both choose is limited by the larger one, 1 token on average instead of 1.11 for
    equal sizes. Below the first level they also stay together where both choose nothing."""
    j, worst = LAMBDA[0] / LAMBDA[1], 0.0
    for b in (LAMBDA[1], 10 * LAMBDA[1], 1_000_000):
        a = b * LAMBDA[0] // LAMBDA[1]
        of_a, of_b, alive = min(1.0, 1 / (j * a)), min(1.0, 1 / (j * b)), 1.0
        nothing = (1 - of_a) ** a * (1 - of_b) ** (b - a)
        for left in range(levels - 1, -1, -1):
            alive = 1 - (1 - of_b * alive) ** a + (nothing * alive if left else 0.0)
        worst = max(worst, 1 - alive)
    return worst


def expected_miss(runs: int | None = None, levels: int = LEVELS) -> float:
    """Chance at most that a pair of similarity LAMBDA is missed: no run keeps it together, or its sketches differ too much."""
    return run_miss(levels) ** (RUNS if runs is None else runs) + sketch_loss()


RUNS = math.ceil(math.log(MISS - sketch_loss()) / math.log(run_miss()))  # 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, np.uint64(base))
    p[0] = 1
    return np.multiply.accumulate(p)


_UP, _DOWN = _powers(_BASE, 1 << 18), _powers(pow(_BASE, -1, 1 << 64), 1 << 18)


def gram_set(text: str, n: int = WORDS_IN_GRAM) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of words; a text with fewer words is one gram, one without words has none."""
    x = np.frombuffer(text.encode(), np.uint8)
    word = np.zeros(len(x) + 2, bool)
    word[1:-1] = ~_IS_SPACE[x]
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = (_UP, _DOWN) if len(x) <= len(_UP) else (_powers(_BASE, len(x)), _powers(pow(_BASE, -1, 1 << 64), len(x)))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_BYTE[x] * up[: len(x)], out=sums[1:])
    h = _mix((sums[end] - sums[start]) * down[start])
    n = min(n, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        acc = (acc ^ h[i : len(h) - n + 1 + i]) * _M2 + np.uint64(i)
        acc ^= acc >> np.uint64(29)
    return np.unique(_mix(acc))


def set_key(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


_SEEDS = _mix(np.arange(1, 1 + 4096, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ROWS = (_SEEDS[1024 : 1024 + SKETCH] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def sketch(grams: np.ndarray) -> bytes:
    """A byte of the least number among the grams for each of SKETCH multipliers; grams are hashes already."""
    low = (grams >> np.uint64(16)).astype(np.uint32)
    out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        out = np.minimum(out, (low[None, i : i + 1024] * _ROWS[:, None]).min(axis=1))
    return ((out ^ (out >> np.uint32(9))) & np.uint32(255)).astype(np.uint8).tobytes()


def paths(grams: np.ndarray) -> list[list[int]]:
    """Chosen paths as lists of a key for each level. A node's random numbers are the grams times an odd number of the node's own. Below
    the first level a set that chooses nothing has a key for that; a run in which it chooses nothing at first has no path."""
    limit = np.uint64(min((1 << 64) - 1, int((1 << 64) * LAMBDA[1] / (LAMBDA[0] * len(grams)))))
    seeds, above = _SEEDS[:RUNS], [[] for _ in range(RUNS)]
    for level in range(LEVELS):
        rows, keys = [], []
        step = max(1, 2_000_000 // len(grams))
        for i in range(0, len(seeds), step):
            numbers = grams[None, :] * seeds[i : i + step, None]
            r, c = np.nonzero(numbers <= limit)
            rows.append(r + i)
            keys.append(_mix(numbers[r, c] ^ (seeds[r + i] * _M1)))
        r, k = np.concatenate(rows), np.concatenate(keys)
        if level:
            nothing = np.flatnonzero(np.bincount(r, minlength=len(seeds)) == 0)
            r, k = np.concatenate([r, nothing]), np.concatenate([k, _mix(~seeds[nothing])])
        above = [[*above[i], x] for i, x in zip(r.tolist(), k.tolist(), strict=True)]
        seeds = k | np.uint64(1)
        if not len(seeds):
            return []
    return above


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __set, the key of the text's gram set; null where the text has no word."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("__set", pa.array([set_key(gram_set(t.as_py() or "")) for t in b.column(text)], pa.binary()))

    return docs.mapInArrow(run, schema)


def _in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows with equal keys from batches sorted by them; some small groups at a time."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        first = np.zeros(t.num_rows, bool)
        first[0] = True
        for k in keys:
            c = t.column(k).combine_chunks()
            c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
            first[1:] |= np.array(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), bool)
        last = int(np.flatnonzero(first)[-1])
        if last:
            yield t.slice(0, last)
        rest = t.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def _bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    first = np.zeros(t.num_rows, bool)
    first[0] = True
    for k in keys:
        c = t.column(k).to_pylist()
        first[1:] |= np.fromiter((x != y for x, y in zip(c[1:], c, strict=False)), bool, len(c) - 1)
    return np.append(np.flatnonzero(first), t.num_rows)


def _least(similar: np.ndarray) -> np.ndarray:
    """Of each row the least row that a chain of similar ones joins it to."""
    m = len(similar)
    similar = similar | np.eye(m, dtype=bool)
    label = np.arange(m)
    while True:
        new = np.where(similar, label[None, :], m).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["p", "i", "j"]
    for t in _in_groups(batches, keys):
        sets, sketches, sizes = t.column("set").to_pylist(), t.column("sketch").to_pylist(), t.column("size").to_numpy()
        at = _bounds(t, keys)
        a, b = [], []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi - lo < 2:
                continue
            s = np.frombuffer(b"".join(sketches[lo:hi]), np.uint8).reshape(hi - lo, SKETCH)
            n = sizes[lo:hi]
            like = np.empty((hi - lo, hi - lo), bool)
            for r in range(0, hi - lo, 64):
                like[r : r + 64] = (s[r : r + 64, None, :] == s[None, :, :]).mean(axis=2) >= CANDIDATE
            like &= (np.minimum(n[:, None], n[None, :]) * LAMBDA[1] >= np.maximum(n[:, None], n[None, :]) * LAMBDA[0])
            label = _least(like)
            for x in np.flatnonzero(label != np.arange(hi - lo)):
                a.append(sets[lo + x])
                b.append(sets[lo + label[x]])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _split_blocks(df: DataFrame, by: str, n: str, block: int) -> DataFrame:
    """Each row once for each pair of blocks that its block is in; groups of ``n`` rows up to ``block`` are one block."""
    many = F.ceil(F.col(n) / block).cast("int")
    df = df.withColumn("__n", many).withColumn("__b", F.pmod(F.xxhash64("set"), F.col("__n")).cast("int"))
    df = df.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return df.withColumn("i", F.least("__b", "__o")).withColumn("j", F.greatest("__b", "__o")).drop("__n", "__o")


def candidate_groups(rows: DataFrame) -> DataFrame:
    """Rows (set, comp, n): sets that chosen paths and sketches join, their group and its size. ``rows`` may repeat sets: what moves is
    (set, path) and, for sets that meet another, one sketch."""
    levels, big = [], None
    for level in range(LEVELS):
        if level == 0:
            at = rows.select("set", F.explode(F.array_distinct(F.transform("paths", lambda p: p[0]))).alias("p")).distinct()
        else:
            # Only sets of buckets that are still large go on, by what they chose next.
            chosen = rows.join(small(big.select("set").distinct()), "set", "left_semi").select("set", F.explode("paths").alias("path"))
            chosen = chosen.select("set", F.element_at("path", level).alias("q"), F.element_at("path", level + 1).alias("next")).distinct()
            at = big.withColumnRenamed("p", "q").join(chosen, ["set", "q"]).select("set", F.col("next").alias("p")).distinct()
        counts = at.groupBy("p").agg(F.count("*").alias("n")).filter("n > 1")
        shared = materialize(at.join(counts, "p"), f"level{level}")
        levels.append(shared.filter(F.col("n") <= BUCKET) if level + 1 < LEVELS else shared)
        big = shared.filter(F.col("n") > BUCKET).select("set", "p")
        if level + 1 < LEVELS and big.limit(1).count() == 0:
            break
    members = levels[0]
    for more in levels[1:]:
        members = members.unionByName(more)
    sketches = rows.select("set", "size", "sketch").dropDuplicates(["set"])
    dealt = _split_blocks(members.join(sketches, "set"), "p", "n", COMPARE)
    dealt = dealt.select("p", "i", "j", "set", "size", "sketch").repartition(part_count(rows), "p", "i", "j").sortWithinPartitions("p", "i", "j")
    edges = dealt.mapInArrow(_bucket_edges, "a binary, b binary").distinct()
    labels = connected_components(edges, "candidates")
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    return materialize(labels.join(sizes, "label").select(F.col("node").alias("set"), F.col("label").alias("comp"), "n"), "groups")


def intersections(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersections of all pairs of sets, and of the sets: products of 0/1 matrices over the shared tokens."""
    m = len(arrays)
    sizes = np.array([len(x) for x in arrays])
    flat, owner = np.concatenate(arrays), np.repeat(np.arange(m), sizes)
    token, where, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count[where] > 1
    dense = np.cumsum(count > 1) - 1
    column, owner = dense[where[common]], owner[common]
    inter = np.zeros((m, m), np.float32)
    o = np.argsort(column, kind="stable")
    column, owner = column[o], owner[o]
    top = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, top, 4096):
        lo, hi = np.searchsorted(column, [c, c + 4096])
        part = np.zeros((m, min(4096, top - c)), np.float32)
        part[owner[lo:hi], column[lo:hi] - c] = 1
        inter += part @ part.T
    return inter.astype(np.int64), sizes


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["comp", "i", "j"]
    schema = pa.schema([("set", pa.binary()), ("links", pa.int64()), ("label", pa.binary())])
    for t in _in_groups(batches, keys):
        sets, grams, block = t.column("set").to_pylist(), t.column("grams").to_pylist(), t.column("b").to_numpy()
        i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
        at = _bounds(t, keys)
        out: list[tuple] = []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            inter, sizes = intersections([np.frombuffer(g, np.uint64) for g in grams[lo:hi]])
            union = sizes[:, None] + sizes[None, :] - inter
            like = inter * LAMBDA[1] >= union * LAMBDA[0]
            np.fill_diagonal(like, False)
            if i[lo] != j[lo]:
                like &= block[lo:hi][:, None] != block[lo:hi][None, :]
            links, label = like.sum(axis=1), _least(like)
            out += [(sets[lo + x], int(links[x]), sets[lo + label[x]]) for x in range(hi - lo)]
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _known_sets(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows (set, least, n_same, n_links, label): each gram set with its least key, its rows, its links and its component."""
    base = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("t"))
    schema = T.StructType([T.StructField("key", base.schema["key"].dataType), T.StructField("set", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("paths", T.ArrayType(T.ArrayType(T.LongType())))])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("t"):
                g = gram_set(t.as_py() or "")
                rows.append((set_key(g), len(g), sketch(g), [[_signed(x) for x in p] for p in paths(g)]) if len(g) else (None, 0, None, None))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            kinds = [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=["key", "set", "size", "sketch", "paths"])

    rows = materialize(base.mapInArrow(describe, schema), "described")
    rows = rows.filter("set IS NOT NULL")
    same = rows.groupBy("set").agg(F.min("key").alias("least"), F.count("*").alias("n_same"))
    groups = candidate_groups(rows)

    def with_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [gram_set(t.as_py() or "") for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(g) for g in grams], pa.binary()), b.column("t")], names=["set", "t"])

    def to_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("set"), b.column("comp"), b.column("n"), pa.array([gram_set(t.as_py() or "").tobytes() for t in b.column("t")], pa.binary())], names=["set", "comp", "n", "grams"])

    found = base.select("t").mapInArrow(with_grams, "set binary, t string").join(small(groups), "set").dropDuplicates(["set"])
    found = found.select("set", "comp", "n", "t").mapInArrow(to_grams, "set binary, comp binary, n long, grams binary")
    dealt = _split_blocks(found, "comp", "n", BLOCK).select("comp", "i", "j", F.col("__b").alias("b"), "set", "grams")
    dealt = dealt.repartition(part_count(docs), "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    checked = materialize(dealt.mapInArrow(_verified, "set binary, links long, label binary"), "links")
    links = checked.groupBy("set").agg(F.sum("links").alias("n_links"))
    classes = connected_components(checked.filter("set <> label").select(F.col("set").alias("a"), F.col("label").alias("b")), "classes")
    known = same.join(links, "set", "left").join(classes.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    return materialize(known, "known", keep=True)


def jaccard_classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with __set, class_id, n_links and n_same.

    n_links counts the different gram sets that are at least LAMBDA similar to the row's; n_same counts the rows with its very set;
    class_id is the least key among rows that a chain of links joins. Texts without a word have no set: no links, a class of their
    own with their own key, n_same 1. Texts of one to four words have one gram, all their words. Null keys sort last and may be a
    class's only key. Repeated rows share a class. Columns of those names are replaced; empty tables give empty results."""
    docs = docs.drop("class_id", "n_links", "n_same", "__set")
    with scratch():
        known = _known_sets(docs, text, key)
    least = known.groupBy("label").agg(F.min("least").alias("class_id"))
    known = known.join(least, "label").select(F.col("set").alias("__set"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_same")
    out = keyed(docs, text).join(known, "__set", "left")
    has = F.col("__set").isNotNull()
    return out.select(*docs.columns, "__set", F.when(has, F.col("class_id")).otherwise(F.col(key)).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_same", F.lit(1)).cast("long").alias("n_same"))
