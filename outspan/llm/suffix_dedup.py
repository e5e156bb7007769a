"""Removal of long repeated byte strings, by suffix buckets and a difference cover.

Which strings of ``length`` bytes of a corpus start more than once? Sorting all suffixes answers it; done in blocks, one suffix bucket
at a time is sorted, and long ties are resolved by ranks of a difference-cover sample that are computed beforehand, so memory is that
of a block.

Buckets follow content. Each window of ``length`` bytes has an anchor, its leftmost least gram of half that many bytes, so equal windows
have equal anchors at equal places and meet in one bucket; the windows around one occurrence of an anchor are its context. Contexts
that are whole equal to another need no sorting: all their windows repeat. An anchor that occurs once has no repeated window. The rest,
mostly edges of copied passages, is sorted: bytes first, and beyond the first COVER bytes by the ranks of sample positions, which any
two suffixes have in common within COVER bytes. A bucket of more than BUCKET different contexts is split first, by place and by the bytes
that all its windows at those places share; the parts go the same way as the whole. So no task holds more than a bucket and a block.

Equal contexts and texts are told by hashes: a gram's and a context's 64 bits each, and 128 bits of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chosen_path import _in_groups
from .common import materialize, part_count, scratch

LENGTH = 400
PASSAGE = 250  # bytes of a passage: fifty words of four letters and a space
COVER = 64
BUCKET = 2000  # different contexts of an anchor that are sorted together; more are split
WIDTHS = (16, 1)  # places of one part of a split bucket, and of a part's part
CHUNK = 1 << 18  # window starts of a very long text that are looked at together
CHUNK_SMALL = 1 << 15  # bytes of short texts that are looked at together
BLOCK_BYTES = 400_000  # of contexts, sorted at once
BROADCAST_KEYS = 200_000  # keys that a broadcast may hold


def difference_cover(v: int) -> list[int]:
    """Residues such that any two positions have a common distance below v to residues in it; greedy."""
    cover, missing = [0, 1], {d for d in range(v)} - {0, 1, v - 1}
    while missing:
        best = max(range(v), key=lambda c: len({(c - x) % v for x in cover} & missing) + len({(x - c) % v for x in cover} & missing))
        missing -= {(best - x) % v for x in cover} | {(x - best) % v for x in cover}
        cover.append(best)
    return sorted(set(cover))


_COVER = np.array(difference_cover(COVER))
#: By residue: distance to the next sample position, below COVER.
_NEXT = np.array([min((c - r) % COVER for c in _COVER) for r in range(COVER)])

_U = np.uint64
_TABLE = np.random.default_rng(400).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_PLACE = 19  # bits for a place in a chunk
_SIZE = (1 << _PLACE) - 1


def _powers(base: int) -> np.ndarray:
    p = np.full(_SIZE, _U(base))
    p[0] = 1
    return np.multiply.accumulate(p)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def rolling(x: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings of up to _SIZE bytes."""
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_TABLE[x] * _POWER[: len(x)], out=sums[1:])
    return _mix((sums[k:] - sums[:-k]) * _INVERSE[: len(x) - k + 1])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w consecutive ones, by running minima of blocks of w from both sides."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _signed_hash(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(data, seed) - (1 << 63)


def _signed_hashes(data: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    found = np.array([digest(data[a:z]) for a, z in zip(first.tolist(), end.tolist(), strict=True)], np.uint64)
    return (found ^ _U(1 << 63)).view(np.int64)


def _anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of up to _SIZE bytes, and of each window the place of its anchor."""
    gram = length // 2
    grams = rolling(np.frombuffer(data, np.uint8), gram)
    keys = (grams & ~_U(_SIZE)) | np.arange(len(grams), dtype=np.uint64)
    return grams, (_sliding_min(keys, length - gram + 1) & _U(_SIZE)).astype(np.int64)


def contexts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each anchor in each text: number of the text, hash of its gram, hash of its context, first and last window start, place of the gram.
    Six arrays. Texts are looked at together, CHUNK_SMALL bytes at a time; windows over an edge between two aren't theirs."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(6)]
    held: list[int] = []

    def add(data: bytes, numbers: np.ndarray, sizes: np.ndarray, before: int) -> None:
        grams, at = _anchors(data, length)
        ends = np.cumsum(sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
        edge = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
        first = np.flatnonzero(edge & (np.arange(len(at)) + length <= ends[text]))
        text = text[first]
        last = np.minimum(np.append(first[1:], len(at)) - 1, ends[text] - length)
        shift = (ends - sizes)[text] - before
        for cols, new in zip(out, (numbers[text], grams[at[first]].view(np.int64), _signed_hashes(data, first, last + length), first - shift, last - shift, at[first] - shift), strict=True):
            cols.append(new)

    def flush() -> None:
        if held:
            add(b"".join([texts[i] for i in held]), np.array(held), np.array([len(texts[i]) for i in held]), 0)
            held.clear()

    size = 0
    for i, t in enumerate(texts):
        if len(t) > CHUNK_SMALL:
            for c in range(0, len(t) - length + 1, CHUNK):
                part = t[c : c + CHUNK + length - 1]
                add(part, np.array([i]), np.array([len(part)]), c)
        elif len(t) >= length:
            if size + len(t) > CHUNK_SMALL:
                flush()
                size = 0
            held.append(i)
            size += len(t)
    flush()
    return [np.concatenate(cols) for cols in out]


def _refined(group: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Order of rows, which lie sorted by dense groups, by group and k, and their new dense groups; None if no group's rows differ in k.
    Only groups whose rows differ are sorted."""
    differ = k != k[np.flatnonzero(np.diff(group, prepend=-1))][group]
    if not differ.any():
        return None
    mixed = np.zeros(len(group), bool)
    mixed[group[differ]] = True
    rows = np.flatnonzero(mixed[group])
    order = np.arange(len(group))
    order[rows] = rows[np.lexsort((k[rows], group[rows]))]
    k = k[order]
    edge = (group[1:] != group[:-1]) | (k[1:] != k[:-1])
    return order, np.concatenate([[0], np.cumsum(edge)])


def _shared(group: np.ndarray) -> np.ndarray:
    """Whether each of some rows, sorted by group, has another of its group beside it."""
    same = np.concatenate([[False], group[1:] == group[:-1], [False]])
    return same[1:] | same[:-1]


def window_parts(length: int) -> tuple[list[tuple[int, int]], list[int]]:
    """What makes up a window of ``length`` bytes beside its first COVER ones: (distance from the next sample position, size) of sample
    ranks, sizes being COVER times a power of two, and places of its last 8-byte words. There is no gap, and nothing lies beyond the window."""
    if length < 2 * COVER:
        raise ValueError(f"length is {2 * COVER} bytes at least")
    blocks, ranks, at = (length - COVER + 1) // COVER, [], 0
    for k in range(blocks.bit_length() - 1, -1, -1):
        if blocks >> k & 1:
            ranks.append((at, COVER << k))
            at += COVER << k
    return ranks, list(range(length - 8, at - 8, -8))[::-1]


def _repeated_windows(bucket: np.ndarray, parts: list[bytes], anchors: np.ndarray, copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """repeated_in_block() as one array over the windows of all contexts, and how many windows each context has."""
    ranks, tail = window_parts(length)
    starts, pieces, end = [], [bytes(COVER)], COVER
    for p, a in zip(parts, anchors.tolist(), strict=True):
        pad = -(end + a) % COVER
        starts.append(end + pad)
        pieces += (bytes(pad), p)
        end += pad + len(p)
    top = max((size for _, size in ranks), default=COVER)
    pieces.append(bytes(top + 3 * COVER))
    word = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64)  # of 8 bytes from each place on, in the order of bytes
    for n in (1, 2, 4):
        word[:-n] = (word[:-n] << _U(8 * n)) | word[n:]

    # Ranks of the sample's first 64, 128, ... bytes; a position of the sample plus COVER is one too.
    sample = np.flatnonzero(np.isin(np.arange(COVER), _COVER)[np.arange(end + COVER) % COVER])
    group, by, size = np.zeros(len(sample), np.int64), {}, COVER
    for i in range(COVER // 8):
        if refined := _refined(group, word[sample + 8 * i]):
            order, group = refined
            sample = sample[order]
    while True:
        by[size] = np.zeros(end + top + 2 * COVER, np.int32)
        by[size][sample] = group
        if size >= top:
            break
        if refined := _refined(group, by[size][sample + size]):
            order, group = refined
            sample = sample[order]
        size *= 2
    sizes = np.array([len(p) - length + 1 for p in parts])
    which = np.repeat(np.arange(len(parts)), sizes)
    offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    p = np.array(starts)[which] + offset
    often = copies[which] > 1
    _, dense = np.unique(bucket, return_inverse=True)
    group = dense[which] * (1 << 24) + (anchors[which] - offset)
    left = np.argsort(group, kind="stable")
    left, group = left[shared := _shared(group[left])], group[left][shared]
    group = np.cumsum(np.diff(group, prepend=-1) != 0) - 1
    keys = [lambda q, i=i: word[q + 8 * i] for i in range(COVER // 8)]
    keys += [lambda q, d=d, s=s: by[s][q + _NEXT[q % COVER] + d] for d, s in ranks]
    keys += [lambda q, t=t: word[q + t] for t in tail]
    for key in keys:
        if refined := _refined(group, key(p[left])):
            order, group = refined
            shared = _shared(group)
            left, group = left[order][shared], group[shared]
            group = np.cumsum(np.diff(group, prepend=-1) != 0) - 1
    often[left] = True
    return often, sizes


def repeated_in_block(bucket: np.ndarray, parts: list[bytes], anchors: np.ndarray, copies: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Sorts the windows of contexts by bucket and content; of each context says which windows occur again in the block.

    ``anchors`` is the place of the gram in each context. Contexts lie in one buffer with their grams at multiples of COVER, so that
    windows that may be equal have equal residues and share their sample positions. Windows are told apart a key at a time; only where
    those of a group differ in it are they sorted, and those that have no equal left are done with."""
    often, sizes = _repeated_windows(bucket, parts, anchors, copies, length)
    return np.split(often, np.cumsum(sizes)[:-1])


def _runs(flags: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags of rows that have ``sizes`` of them: row, first and last place in it."""
    ends = np.cumsum(sizes)
    shift = np.arange(len(sizes))  # one unset flag between rows
    apart = np.zeros(len(flags) + len(sizes) + 1, np.int8)
    apart[np.flatnonzero(flags) + np.repeat(shift, sizes)[flags] + 1] = 1
    edge = np.flatnonzero(np.diff(apart, append=0))
    first, last = edge[::2], edge[1::2] - 1
    row = np.searchsorted(ends + shift, first, side="right")
    start = (ends - sizes + shift)[row]
    return row, first - start, last - start


KEY = ("key", "key2")  # of a text: 128 bits, in two numbers, as aggregates over numbers need no sorting
_PLACES = ("gram", "context", "n", *KEY, "lo", "hi", "anchor", "bytes")
_KINDS = (*(pa.int64(),) * 8, pa.binary())
_PLACE_SCHEMA = "gram long, context long, n long, key long, key2 long, lo long, hi long, anchor long, bytes binary"


def _batch(cols: list, names: tuple[str, ...] = _PLACES, kinds: tuple = _KINDS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def with_key(df: DataFrame, data: str, names: tuple[str, str] = KEY) -> DataFrame:
    """``df`` with the two numbers of the key of the bytes in column ``data``, half a SHA-256."""
    hashed = df.withColumn("__hash", F.sha2(data, 256))
    for at, name in zip((1, 17), names, strict=True):
        hashed = hashed.withColumn(name, F.conv(F.substring("__hash", at, 16), 16, -10).cast("long"))
    return hashed.drop("__hash")


def _bytes_of(df: DataFrame, text: str) -> Column:
    return F.coalesce(df[text].cast("string").cast("binary"), F.lit(b""))


def _describe(length: int) -> Callable:
    """Places of texts (key, key2, t): an anchor's gram and context, one occurrence a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for n in _PLACES if n not in ("n", "bytes")]
        for b in batches:
            for at in range(0, b.num_rows, 200):
                s = b.slice(at, 200)
                text, gram, context, lo, hi, anchor = contexts(s.column("t").to_pylist(), length)
                yield _batch([gram, context, *(s.column(k).to_numpy()[text] for k in KEY), lo, hi, anchor - lo], names, (pa.int64(),) * 7)

    return run


def _sorted_buckets(length: int) -> Callable:
    """Window ranges (text's key, first, last) that repeat, of contexts that occur once; input is sorted by gram."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        copies, parts, lo = t.column("n").to_numpy(), t.column("bytes").to_pylist(), t.column("lo").to_numpy()
        often, sizes = _repeated_windows(t.column("gram").to_numpy(), parts, t.column("anchor").to_numpy(), copies, length)
        row, first, last = _runs(often & np.repeat(copies == 1, sizes), sizes)
        return _batch([*(t.column(k).to_numpy()[row] for k in KEY), first + lo[row], last + lo[row]], (*KEY, "lo", "hi"), (pa.int64(),) * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500))
        held: list[pa.Table] = []
        for t in _in_groups(small, ["gram"]):  # whole buckets
            held.append(t)
            if sum(x.nbytes for x in held) > BLOCK_BYTES:
                yield solve(pa.concat_tables(held))
                held = []
        if held:
            yield solve(pa.concat_tables(held))

    return run


def _split(length: int, width: int) -> Callable:
    """Parts of contexts of large buckets: the windows at ``width`` neighbouring places. A part's bucket is the hash of the bytes that any
    window at these places covers, so equal windows stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                s = b.slice(at, 200)
                rows = []
                for gram, n, key, key2, lo, anchor, data in zip(*(s.column(c).to_pylist() for c in ("gram", "n", *KEY, "lo", "anchor", "bytes")), strict=True):
                    last = len(data) - length  # places run from anchor down to anchor - last
                    for block in range((anchor - last) // width, anchor // width + 1):
                        a, z = max(0, anchor - (block + 1) * width + 1), min(last, anchor - block * width)
                        core = data[anchor - block * width : anchor - (block + 1) * width + 1 + length]
                        part = data[a : z + length]
                        where = (gram ^ block * _BASE) & ((1 << 64) - 1)
                        rows.append((_signed_hash(core, where), _signed_hash(part, where ^ 1), n, key, key2, lo + a, lo + z, anchor - a, part))
                yield _batch(list(zip(*rows, strict=True)) if rows else [()] * len(_PLACES))

    return run


def _with(places: DataFrame, found: DataFrame, by: list[str], n: str, total: int) -> DataFrame:
    """Places whose ``by`` is in ``found`` (``by``, ``n`` places, more columns), with these. Where there are more than total / BROADCAST_KEYS
    places they number fewer than BROADCAST_KEYS and are broadcast; their places don't move, so what is frequent isn't gathered in a task."""
    hot = F.col(n) * BROADCAST_KEYS > F.lit(max(total, BROADCAST_KEYS * 100))
    frequent = F.broadcast(found.filter(hot).drop(n))
    rare = places.join(frequent.select(*by), by, "left_anti").join(found.filter(~hot).drop(n).hint("shuffle_hash"), by)
    return places.join(frequent, by).unionByName(rare)


def removed_runs(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (key, key2, runs) of texts with bytes to remove: the text's key and the maximal runs (start, end) in bytes, end exclusive. A text that two rows have is one run if it has ``length`` bytes."""
    return _removed_runs(with_key(docs.select(_bytes_of(docs, text).alias("t")), "t"), length)


def _removed_runs(base: DataFrame, length: int) -> DataFrame:
    """removed_runs() of byte strings t with their keys."""
    with scratch():
        return _runs_of_places(base, length)


def _runs_of_places(base: DataFrame, length: int) -> DataFrame:
    parts = part_count(base)
    at = [*KEY, "lo", "hi", "anchor"]
    places = base.filter(F.octet_length("t") >= length).mapInArrow(_describe(length), "gram long, context long, key long, key2 long, lo long, hi long, anchor long")
    places = materialize(places, "contexts").withColumn("n", F.lit(1).cast("long"))
    ranges = []
    for depth, width in enumerate((*WIDTHS, None)):
        total = places.agg(F.sum("n")).first()[0] or 0
        grams = places.groupBy("gram").agg(F.sum("n").alias("total"), (F.min("context") == F.max("context")).alias("whole")).filter("total > 1")
        places = materialize(_with(places, materialize(grams, "grams"), ["gram"], "total", total), "repeated")
        ranges.append(places.filter("whole").select(*KEY, "lo", "hi"))
        places = places.filter("not whole")
        # One occurrence of each kind: all columns of first() are of the same row, as in dropDuplicates().
        kinds = materialize(places.groupBy("gram", "context").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in at]), "kinds")
        again = kinds.filter("n > 1").select("gram", "context", F.col("n").alias("of"))
        ranges.append(_with(places, again, ["gram", "context"], "of", total).select(*KEY, "lo", "hi"))
        many = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.count("*").alias("of"))
        cuts = _with(kinds, many, ["gram"], "of", total)
        if depth == 0:
            cuts = materialize(_cut(base, cuts, length), "cuts")
        few = cuts if width is None else cuts.filter(F.col("kinds") <= BUCKET)
        few = few.select("gram", "bytes", "anchor", "n", *KEY, "lo").repartition(parts, "gram").sortWithinPartitions("gram")
        ranges.append(few.mapInArrow(_sorted_buckets(length), "key long, key2 long, lo long, hi long"))
        many = cuts.filter(F.col("kinds") > BUCKET)
        if width is None or many.limit(1).count() == 0:
            break
        many = many.select("gram", "n", *KEY, "lo", "anchor", "bytes")
        places, at = materialize(many.mapInArrow(_split(length, width), _PLACE_SCHEMA), "parts"), [*KEY, "lo", "hi", "anchor", "bytes"]
    found = ranges[0]
    for more in ranges[1:]:
        found = found.union(more)
    # Maximal runs: a new one starts where a range begins beyond the end of all ranges before it.
    by = Window.partitionBy(*KEY).orderBy("lo", "hi")
    far = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = found.distinct().withColumn("new", F.coalesce(F.col("lo") > far + length, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(by))
    run = island.groupBy(*KEY, "island").agg(F.min("lo").alias("start"), (F.max("hi") + length).alias("end"))
    return materialize(run.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs")), "runs", keep=True)


def _few_keys(keys: DataFrame) -> DataFrame:
    """Marks rows with keys for a broadcast if a count proves them few."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def _cut(base: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` with the bytes of each context; texts are cut where they lie unless their keys are too many for a broadcast."""
    wanted = materialize(wanted.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "n", "kinds", "lo", "hi", "anchor")).alias("want")), "wanted")
    part = base.join(_few_keys(wanted.select(*KEY)), [*KEY], "left_semi")
    part = part.withColumn("rn", F.row_number().over(Window.partitionBy(*KEY).orderBy("key"))).filter("rn = 1").drop("rn")  # one row a text, limited before the shuffle too
    names, kinds = ("gram", "bytes", "anchor", "n", "kinds", *KEY, "lo", "hi"), (pa.int64(), pa.binary(), *(pa.int64(),) * 7)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                s = b.slice(at, 100)
                want = s.column("want")
                of, w = np.repeat(np.arange(len(want)), want.value_lengths().to_numpy()), want.flatten()
                gram, n, many, lo, hi, anchor = (w.field(i).to_numpy() for i in range(6))
                texts = s.column("t").to_pylist()
                data = [texts[i][a:z] for i, a, z in zip(of.tolist(), lo.tolist(), (hi + length).tolist(), strict=True)]
                yield _batch([gram, data, anchor, n, many, *(s.column(k).to_numpy()[of] for k in KEY), lo, hi], names, kinds)

    return part.join(wanted, [*KEY]).select(*KEY, "t", "want").mapInArrow(cut, "gram long, bytes binary, anchor long, n long, kinds long, key long, key2 long, lo long, hi long")


def _nested_runs(base: DataFrame, length: int, passage: int) -> DataFrame:
    """Runs for ``length`` bytes of byte strings t with their keys, and ``parts``, those for ``passage`` bytes, fewer. Where a string occurs
    again so do all strings in it, so each longer one that does lies in a part, and only parts of ``length`` bytes are searched again, as
    strings of their own. Each occurrence of a part counts, in equal texts too."""
    parts = _removed_runs(base, passage).withColumnRenamed("runs", "parts")
    with scratch():
        long = parts.select(*KEY, F.filter("parts", lambda p: p["end"] - p["start"] >= length).alias("long")).filter("size(long) > 0")
        each = base.join(_few_keys(long), [*KEY]).select(*KEY, "t", F.explode("long").alias("p"))
        cut = F.substring("t", (F.col("p.start") + 1).cast("int"), (F.col("p.end") - F.col("p.start")).cast("int"))
        each = with_key(each.select(*KEY, F.col("p.start").alias("start"), cut.alias("t")), "t", ("part", "part2"))
        each = materialize(each, "passages")
        inner = _removed_runs(each.select(F.col("part").alias("key"), F.col("part2").alias("key2"), "t"), length)
        inner = inner.select(F.col("key").alias("part"), F.col("key2").alias("part2"), "runs")
        again = each.select(*KEY, "start", "part", "part2").distinct().join(_few_keys(inner), ["part", "part2"])
        again = again.select(*KEY, F.explode(F.transform("runs", lambda r: F.struct((r["start"] + F.col("start")).alias("start"), (r["end"] + F.col("start")).alias("end")))).alias("r"))
        runs = materialize(again.groupBy(*KEY).agg(F.sort_array(F.collect_list("r")).alias("runs")), "runs", keep=True)
    return parts.join(runs, [*KEY], "left")


def remove_repeats(docs: DataFrame, text: str = "text", *, length: int = LENGTH, digest: bool = False, passage: int | None = None) -> DataFrame:
    """``docs`` with ``removed``, an array of maximal removed runs (start, end) in bytes, and the text without them: each byte that a
    string of ``length`` bytes covers which starts anywhere else too.

    The text column holds the remaining bytes; where a run cuts a character, what is left of it is dropped from the text. With ``digest``
    there are n_bytes, n_removed, n_spans and kept_sha256 (of the exact remaining bytes) instead. With ``passage``, fewer bytes than ``length``,
    n_repeated counts the bytes that strings of ``passage`` bytes cover which start elsewhere too; they are not removed. A null text counts as empty; texts
    under ``length`` bytes keep all. Rows with equal texts are removed whole from ``length`` bytes on. Other columns stay, columns of those
    names are replaced."""
    if passage is not None and passage >= length:
        raise ValueError("passage must be shorter than length")
    extra = ("n_bytes", "n_removed", "n_spans", "kept_sha256") if digest else ("removed",)
    own = ("__key", "__key2")
    docs = docs.drop(*extra, *(("n_repeated",) if passage else ()), *own, "__runs", "__parts")
    found = ["runs", "parts"] if passage else ["runs"]
    base = with_key(docs.select(_bytes_of(docs, text).alias("t")), "t")
    runs = _nested_runs(base, length, passage) if passage else _removed_runs(base, length)
    runs = runs.select(*[F.col(k).alias(o) for k, o in zip(KEY, own, strict=True)], *[F.col(c).alias(f"__{c}") for c in found])
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    rest = [f for f in docs.schema.fields if f.name != text]
    keyed = with_key(docs.withColumn("__bytes", _bytes_of(docs, text)), "__bytes", own).drop("__bytes")
    if digest:
        new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
        schema = T.StructType([*rest, *new])
    else:
        schema = T.StructType([*docs.schema.fields, T.StructField("removed", span)])
    if passage:
        schema = schema.add("n_repeated", T.LongType())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, runs_of = b.column(text).to_pylist(), b.column("__runs").to_pylist()
            kept, cut = [], []
            for t, r in zip(texts, runs_of, strict=True):
                data, r = (t or "").encode(), r or []
                cut.append(r)
                edges = [0, *(x for s in r for x in (s["start"], s["end"])), len(data)]
                kept.append(data if not r else b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
            cols = {f.name: b.column(f.name) for f in rest}
            if digest:
                cols["n_bytes"] = pa.array([len((t or "").encode()) for t in texts], pa.int64())
                cols["n_removed"] = pa.array([sum(s["end"] - s["start"] for s in r) for r in cut], pa.int64())
                cols["n_spans"] = pa.array([len(r) for r in cut], pa.int64())
                cols["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in kept])
            else:
                cols[text] = pa.array([None if t is None else k.decode("utf-8", "ignore") for t, k in zip(texts, kept, strict=True)], pa.string())
                cols["removed"] = pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            if passage:
                cols["n_repeated"] = pa.array([sum(s["end"] - s["start"] for s in r or []) for r in b.column("__parts").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema.fields], names=schema.fieldNames())

    # Whole texts move only if what is to be removed is too much for a broadcast: a count proves keys and runs small.
    spans = sum((F.coalesce(F.array_size(f"__{c}"), F.lit(0)) for c in found), F.lit(0))
    size = runs.agg(F.count("*").alias("keys"), F.coalesce(F.sum(spans), F.lit(0)).alias("spans")).first()
    if size["keys"] <= BROADCAST_KEYS and size["spans"] <= 4 * BROADCAST_KEYS:
        runs = F.broadcast(runs)
    joined = keyed.join(runs, [*own], "left")
    return joined.select(*docs.columns, *[f"__{c}" for c in found]).mapInArrow(apply, schema)
