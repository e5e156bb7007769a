"""Near-duplicate classes by b-bit minimum hashes.

A text's shingles give MINIMA minimum hashes. Bands of BAND_ROWS full minima make the candidates; what is kept of each minimum are its
BITS low bits, packed into a signature, and the share of equal cells, corrected for cells that are equal by chance, estimates the similarity of
a candidate pair by counting bits. Pairs whose estimate leaves the threshold possible are compared on their full sets.

Classes are the components of the confirmed links, so inside a class no further link is looked for: first each bucket's sets meet its
least one only, which joins large groups at a cost of one pair a set. Then buckets that still hold sets of different components compare
their signatures, in pairs of blocks, and what may be similar makes candidate groups, whose sets are compared as a whole in pairs of
blocks. A pair of blocks emits a forest, never its pairs: one row a set. Equal sets are one set throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chosen_path import _bounds, _in_groups, _least, _mix, _split_blocks, gram_set, intersections
from .common import discard, materialize, part_count, scratch, small
from .components import contracted_components

WORDS_IN_SHINGLE = 3
LEAST = (85, 100)  # similarity, as a fraction
BANDS, BAND_ROWS = 40, 6
MINIMA = BANDS * BAND_ROWS
BITS = 2  # kept of each minimum
LOST = 1e-9  # chance at most that a pair at the threshold is left out for its estimate
COMPARE = 512  # sets of one block when a bucket's signatures are compared
BLOCK = 256  # sets of one block of an exact comparison

_CELLS = 64 // BITS
LONGS = math.ceil(MINIMA / _CELLS)
_LOW = sum(1 << (BITS * i) for i in range(_CELLS))  # the lowest bit of each cell
_FACTORS = _mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _equal_share(similarity: float) -> float:
    """Expected share of equal cells: equal minima, and those that agree in the kept bits by chance."""
    return similarity + (1 - similarity) / (1 << BITS)


def _least_equal() -> int:
    """Equal cells below which a pair is left out: LOST at the threshold."""
    p, below = _equal_share(LEAST[0] / LEAST[1]), 0.0
    for m in range(MINIMA + 1):
        below += math.comb(MINIMA, m) * p**m * (1 - p) ** (MINIMA - m)
        if below > LOST:
            return m
    return MINIMA


LEAST_EQUAL = _least_equal()


def expected_miss() -> float:
    """Chance at most that a pair of similarity LEAST is not compared: no band in common, or too few equal cells."""
    return (1 - (LEAST[0] / LEAST[1]) ** BAND_ROWS) ** BANDS + LOST


def estimate(equal: float) -> float:
    """Similarity that so many equal cells stand for."""
    chance = 1 / (1 << BITS)
    return (equal / MINIMA - chance) / (1 - chance)


def minima(grams: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        np.minimum(out, (grams[None, at : at + 2048] * _FACTORS[:, None]).min(axis=1), out=out)
    return out >> np.uint64(16)


def bands(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, of its number and its minima."""
    acc = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + column)
    return acc.view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed; cells beyond the last are zero."""
    cells = np.zeros(LONGS * _CELLS, np.uint64)
    cells[:MINIMA] = least & np.uint64((1 << BITS) - 1)
    return (cells.reshape(LONGS, _CELLS) << (np.arange(_CELLS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def equal_cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal cells of signatures along the last axis."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    for i in range(1, BITS):
        x = x | (x >> np.uint64(i))
    return MINIMA - np.bitwise_count(x & np.uint64(_LOW)).sum(axis=-1, dtype=np.int64)


def _equal_cells(a: Column, b: Column) -> Column:
    """equal_cells() of two array columns."""

    def differ(i: int) -> Column:
        x = y = a[i].bitwiseXOR(b[i])
        for s in range(1, BITS):
            y = y.bitwiseOR(F.shiftrightunsigned(x, s))
        return F.bit_count(y.bitwiseAND(F.lit(_LOW)))

    return F.lit(MINIMA) - sum((differ(i) for i in range(LONGS)), F.lit(0))


def _possible(n: Column, m: Column, a: Column, b: Column) -> Column:
    """Whether sizes and signatures leave the threshold possible."""
    return (F.least(n, m) * LEAST[1] >= F.greatest(n, m) * LEAST[0]) & (_equal_cells(a, b) >= LEAST_EQUAL)


def lowered(text: str | None) -> str:
    return (text or "").encode().lower().decode()  # bytes: A to Z only


def node_of(grams: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """Two 64-bit hashes of a set, the second to tell if two sets share the first; nothing for an empty set."""
    if not len(grams):
        return None, None
    a, b = _mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), _mix(grams + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _described(docs: DataFrame, text: str, key: str) -> DataFrame:
    base = docs.select(docs[key].alias("key"), F.xxhash64(docs[text].cast("string")).alias("place"), docs[text].cast("string").alias("t"))
    added = "node long, other long, size long, cells array<long>, bands array<long>"
    schema = T.StructType([*base.schema.fields[:2], *T._parse_datatype_string(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, cells, keys = [], [], [], []
            for t in b.column("t"):
                grams = gram_set(lowered(t.as_py()), WORDS_IN_SHINGLE)
                nodes.append(node_of(grams))
                sizes.append(len(grams))
                least = minima(grams) if len(grams) else None
                cells.append(None if least is None else signature(least))
                keys.append(None if least is None else bands(least))
            long, longs = pa.int64(), pa.list_(pa.int64())
            arrays = [pa.array([x[0] for x in nodes], long), pa.array([x[1] for x in nodes], long), pa.array(sizes, long), pa.array(cells, longs), pa.array(keys, longs)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("place"), *arrays], names=schema.fieldNames())

    return base.mapInArrow(run, schema)


def _sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows (node, grams) of the nodes of ``wanted``: their sets, computed again from one text of each."""
    needed = materialize(wanted.join(nodes.select("node", "pick"), "node").select("node", F.col("pick.key").alias("key"), F.col("pick.place").alias("place")), "needed")
    base = docs.select(docs[key].alias("k"), F.xxhash64(docs[text].cast("string")).alias("p"), docs[text].cast("string").alias("t"))
    chosen = base.join(small(needed), (F.col("p") == needed["place"]) & F.col("k").eqNullSafe(needed["key"])).select("node", "t")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [gram_set(lowered(t.as_py()), WORDS_IN_SHINGLE) for t in b.column("t")]
            same = pa.array([node_of(s)[0] == n for s, n in zip(sets, b.column("node").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "grams"]).filter(same)

    return materialize(chosen.mapInArrow(grams, "node long, grams binary").dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b) of nodes those whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * LEAST[1] >= (len(x) + len(y) - both) * LEAST[0])
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _forests(batches: Iterator[pa.RecordBatch], keys: list[str], similar) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of each group of rows in turn: its nodes with the least that a chain of similar ones of other components joins them to."""
    for t in _in_groups(batches, keys):
        node, comp, block, i, j = (t.column(c).to_numpy() for c in ("set", "comp", "block", "i", "j"))
        at, a, b = _bounds(t, keys), [], []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if (comp[lo:hi] == comp[lo]).all():
                continue
            like = similar(t.slice(lo, hi - lo)) & (comp[lo:hi, None] != comp[None, lo:hi])
            if i[lo] != j[lo]:
                like &= block[lo:hi, None] != block[None, lo:hi]
            label = _least(like)
            moved = np.flatnonzero(label != np.arange(hi - lo))
            a.append(node[lo + moved])
            b.append(node[lo + label[moved]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _by_signature(t: pa.Table) -> np.ndarray:
    size, cells = t.column("size").to_numpy(), t.column("cells").combine_chunks().flatten().to_numpy().reshape(t.num_rows, LONGS)
    like = np.minimum(size[:, None], size[None, :]) * LEAST[1] >= np.maximum(size[:, None], size[None, :]) * LEAST[0]
    for at in range(0, len(size), 64):
        like[at : at + 64] &= equal_cells(cells[at : at + 64, None, :], cells[None, :, :]) >= LEAST_EQUAL
    return like


def _by_set(t: pa.Table) -> np.ndarray:
    inter, size = intersections([np.frombuffer(g.as_buffer(), np.uint64) for g in t.column("grams")])
    return inter * LEAST[1] >= (size[:, None] + size[None, :] - inter) * LEAST[0]


def _in_blocks(rows: DataFrame, by: str, block: int, parts: int, similar) -> DataFrame:
    """Edges (a, b) of the groups of ``rows`` (set, comp, n, ...) by the column ``by``, compared in pairs of blocks."""
    keys = [by, "i", "j"]
    dealt = _split_blocks(rows, by, "n", block).withColumnRenamed("__b", "block").repartition(parts, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda batches: _forests(batches, keys, similar), "a long, b long")


def _links(buckets: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """Edges (a, b) whose components are the classes: nodes that similar texts link."""
    about, parts = nodes.select("node", "size", "cells"), part_count(docs)
    to = lambda name, n, c: about.select(F.col("node").alias(name), F.col("size").alias(n), F.col("cells").alias(c))
    stars = buckets.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(to("a", "n", "x"), "a").join(to("b", "m", "y"), "b").filter(_possible(F.col("n"), F.col("m"), F.col("x"), F.col("y"))).select("a", "b")
    stars = materialize(stars, "stars")
    sets = _sets(stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct(), nodes, docs, text, key)
    links = materialize(_confirmed(stars, sets), "star-links")
    discard(sets)
    comp = contracted_components(links, "star-classes").select("node", F.col("label").alias("comp"))
    left = buckets.select("bucket", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # A bucket of two has been compared; so has one of a single component no need to be.
    mixed = left.groupBy("bucket").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("n > 2 AND lo < hi").select("bucket", "n")
    left = left.join(mixed, "bucket").join(about, "node").select("bucket", "n", F.col("node").alias("set"), "comp", "size", "cells")
    groups = contracted_components(_in_blocks(left, "bucket", COMPARE, parts, _by_signature).distinct(), "candidates")
    members = groups.join(groups.groupBy("label").agg(F.count("*").alias("n")), "label").join(comp, "node", "left")
    members = materialize(members.select("label", "n", "node", F.coalesce("comp", "node").alias("comp")), "members")
    found = members.join(_sets(members.select("node"), nodes, docs, text, key), "node").withColumnRenamed("node", "set")
    return materialize(links.unionByName(_in_blocks(found, "label", BLOCK, parts, _by_set)), "all-links")


def near_classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, n_shingles, component_id, kept), one for each row of ``docs``.

    Texts are compared by their distinct shingles of WORDS_IN_SHINGLE words, A to Z in lower case; a text with fewer words is one shingle. Links are
    pairs of similarity LEAST or more; component_id is the least key that links reach. Null and empty texts and those without a word
    have no shingles and no links: component_id is their own key. Repeated rows share a class. Null keys are never a component_id unless
    their class has no other, and such rows are not kept. Further columns are dropped. Two different sets with equal 64-bit hashes,
    which is unlikely below some billion sets, are an error and never a link."""
    with scratch():
        rows = materialize(_described(docs, text, key), "described", keep=True)
        some = rows.filter("node IS NOT NULL")
        pick = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "place"))).alias("own")
        nodes = some.groupBy("node").agg(pick, F.min("place").alias("place"), F.first("size").alias("size"), F.first("cells").alias("cells"), F.first("bands").alias("bands"), F.min("other").alias("lo"), F.max("other").alias("hi"))
        one = F.coalesce("own", F.struct(F.lit(None).cast(rows.schema["key"].dataType).alias("key"), F.col("place").alias("place")))
        nodes = materialize(nodes.select("node", one.alias("pick"), "size", "cells", "bands", (F.col("lo") != F.col("hi")).alias("clash")), "nodes")
        if nodes.filter("clash").limit(1).count():
            raise ValueError("two different sets of shingles have the same 64-bit hash")
        at = nodes.select("node", F.explode("bands").alias("bucket"))
        shared = at.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last").select("bucket", "leader")
        buckets = materialize(at.join(shared, "bucket"), "buckets")
        links = _links(buckets, nodes, docs, text, key)
        classes = contracted_components(links, "near-classes").select("node", "label")
        known = nodes.select("node", "pick.key").join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = known.groupBy("label").agg(F.min("key").alias("component_id"))
        # Only classes of several sets differ from what a set's own rows say.
        known = materialize(known.join(least, "label").select("node", "component_id"), "known", keep=True)
    out = rows.select("key", "node", F.col("size").alias("n_shingles")).join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
