"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens, cut into slots of SLOT tokens. Every window of WINDOW tokens grants each source its
share of the window; a source serves a slot once its deficit, carried from window to window, has grown to it. A slot's time is
(slot + 1/2) / (target share of the source), when its cumulative deficit has grown to half of it, so that windows need no sequential pass:
slots get their place from counts of time buckets and ranks within a bucket. A source whose queue is empty leaves its turn to the
others. What is owed carries over windows and over Spark partitions.

A partition's part of a queue starts a new slot, so where a document is cut is known as soon as it is coded: ids are neither
stored nor shuffled. The last, partial slot of each source and partition is kept with its ids; these rests of a source are joined
over the partitions, cut to slots again and stand at the end of its queue. What is left of each source, less than a slot, follows at the
end, cut again at window borders, and only the last window has padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import WORDS, byte_alphabet, coder
from .common import materialize, small

WINDOW = 2048
SLOT = 256  # divides WINDOW
END = 1  # id after each document
BUCKET_SLOTS = 20_000  # slots of one time bucket, about


_TIK: dict = {}


def _encoder(path: str):
    """tiktoken over the ranks of the tokenizers file: the same ids, faster; special strings keep their ids."""
    if path not in _TIK:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, special = byte_alphabet(), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        _TIK[path] = (tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special), tuple(special))
    return _TIK[path]


def token_ids(path: str, text: str) -> np.ndarray:
    enc, special = _encoder(path)
    try:
        if any(s in text for s in special):
            return np.array(enc.encode(text, allowed_special="all"), np.uint32)
        return np.array(enc._core_bpe.encode_ordinary(text), np.uint32)
    except Exception:  # noqa: BLE001  very long runs of white space exceed its pattern's limit
        return np.frombuffer(coder(path).encode([text])[0], "<u4")
    except BaseException as e:
        if type(e).__name__ != "PanicException":
            raise
        return np.frombuffer(coder(path).encode([text])[0], "<u4")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def pack(df: DataFrame, path: str, text: str = "text", source: str = "source", carry: tuple[str, ...] = ("doc_id",), window: int = WINDOW, slot: int = SLOT, end: int = END, shares: dict[str, float] | None = None) -> DataFrame:
    """One row a piece: the ``carry`` columns, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``shares`` are target shares by source, above 0; a source without one has its share of the corpus.

    A null or empty text is the end id alone; a null source is a queue of its own, named ''. Each row of ``df`` is a document, repeated
    ones and ties of ids too. An empty table gives no piece. Names of other columns can't clash: only ``carry`` is kept."""
    fields = [df.schema[c] for c in carry]
    lists = [f"c{i}" for i in range(len(fields))]
    schema = T.StructType(
        [T.StructField(n, f.dataType) for n, f in zip(lists, fields, strict=True)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "slot", "at")]
        + [T.StructField("source", T.StringType()), T.StructField("pid", T.IntegerType()), T.StructField("full", T.BooleanType()), T.StructField("ids", T.BinaryType())]
    )
    names = schema.fieldNames()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        done: dict[str, int] = {}  # tokens of each queue so far
        open_: dict[str, list] = {}  # pieces of its slot that isn't full
        types = None

        def batch_of(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            types = types or [*(batch.column(f"__{n}").type for n in lists), *[pa.int64()] * 6, pa.string(), pa.int32(), pa.bool_(), pa.binary()]
            kept = [batch.column(f"__{n}").to_pylist() for n in lists]
            texts, sources = batch.column("__text"), batch.column("__source").to_pylist()
            out: list = []
            for i, s in enumerate(sources):
                ids = np.append(token_ids(path, texts[i].as_py() or ""), np.uint32(end)).astype("<u4")
                n, at, row = len(ids), done.get(s, 0), tuple(k[i] for k in kept)
                pieces = open_.setdefault(s, [])
                start = 0
                while start < n:
                    k, place = divmod(at + start, slot)
                    take = min(slot - place, n - start)
                    part = ids[start : start + take]
                    pieces.append((*row, start, take, _crc(part), n, k, place, s, pid, True, part))
                    start += take
                    if place + take == slot:
                        out += [(*p[:-1], None) for p in pieces]
                        pieces.clear()
                done[s] = at + n
                if len(out) > 50_000:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)
        rest = [(*p[:-2], False, p[-1].tobytes()) for pieces in open_.values() for p in pieces]
        if rest:
            yield batch_of(rest)

    lean = df.select(*[df[f.name].alias(f"__{n}") for n, f in zip(lists, fields, strict=True)], F.coalesce(df[source].cast("string"), F.lit("")).alias("__source"), df[text].cast("string").alias("__text"))
    pieces = materialize(lean.mapInArrow(cut, schema), "pieces")

    def cut_at(df: DataFrame, unit: int) -> DataFrame:
        """Pieces cut where their place, p, crosses a multiple of ``unit``; none is longer than it."""
        fit = unit - F.col("p") % unit
        part = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
        parts = F.when(F.col("length") > fit, F.array(part(F.lit(0), fit), part(fit, F.col("length")))).otherwise(F.array(part(F.lit(0), F.col("length"))))
        df = df.withColumn("part", F.explode(parts))
        df = df.withColumn("ids", F.substring("ids", (F.col("part.a") * 4 + 1).cast("int"), ((F.col("part.b") - F.col("part.a")) * 4).cast("int")))
        df = df.withColumn("start", F.col("start") + F.col("part.a")).withColumn("p", F.col("p") + F.col("part.a")).withColumn("length", F.col("part.b") - F.col("part.a"))
        return df.withColumn("ids_crc32", F.crc32("ids")).drop("part")

    full, left = F.coalesce(F.max(F.when(F.col("full"), F.col("slot") + 1)), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("length"))), F.lit(0))
    queues = pieces.groupBy("source", "pid").agg(full.alias("slots"), left.alias("left"))
    w = Window.partitionBy("source")
    queues = queues.withColumn("before", F.sum("slots").over(w.orderBy("pid")) - F.col("slots")).withColumn("left_before", F.sum("left").over(w.orderBy("pid")) - F.col("left"))
    queues = queues.withColumn("own", F.sum("slots").over(w)).withColumn("all", F.col("own") + F.floor(F.sum("left").over(w) / slot)).drop("slots", "left")
    queues = materialize(queues, "queues")
    sources = queues.groupBy("source").agg(F.max("all").alias("all"))
    n_slots = sources.agg(F.sum("all")).first()[0] or 0
    target = F.col("all") / F.lit(max(1, n_slots))
    if shares:
        named = F.create_map(*[F.lit(x) for kv in shares.items() for x in (kv[0], float(kv[1]))])
        target = F.coalesce(F.get(F.map_values(F.map_filter(named, lambda k, _: k == F.col("source"))), F.lit(0)), target)
    queues, sources = queues.withColumn("target", target), sources.withColumn("target", target)
    span = sources.filter("all > 0").agg(F.max(F.col("all") / F.col("target")).alias("v"), F.sum("target").alias("t")).first()
    until = float(span["v"] or 1.0)
    buckets = max(1, int(until * float(span["t"] or 1.0)) // BUCKET_SLOTS)
    placed = pieces.join(small(queues), ["source", "pid"])
    rests = cut_at(placed.filter("NOT full").withColumn("p", F.col("left_before") + F.col("at")), slot)
    rests = rests.withColumn("slot", F.col("own") + F.floor(F.col("p") / slot)).withColumn("at", F.col("p") % slot).drop("p")
    rests = materialize(rests, "rests")
    timed = placed.filter("full").withColumn("slot", F.col("before") + F.col("slot")).unionByName(rests.filter("slot < all")).drop("ids")
    timed = timed.withColumn("v", (F.col("slot") + 0.5) / F.col("target") / until)
    timed = timed.withColumn("bucket", F.floor(F.col("v") * buckets))
    ranked = materialize(timed.withColumn("rank", F.dense_rank().over(Window.partitionBy("bucket").orderBy("v", "source")).cast("long")), "ranked")
    per = ranked.groupBy("bucket").agg(F.max("rank").alias("n"))
    first = per.withColumn("first", F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).drop("n")  # one row a bucket
    place = ranked.join(small(first), "bucket").withColumn("p", (F.col("first") + F.col("rank") - 1) * slot + F.col("at"))
    out = [f.name for f in fields]
    rename = [F.col(n).alias(o) for n, o in zip(lists, out, strict=True)]
    last = [F.floor(F.col("p") / window).cast("long").alias("sequence_id"), (F.col("p") % window).cast("long").alias("offset"), "source"]
    main = place.select(*rename, "start", "length", "ids_crc32", "doc_tokens", *last)

    rests = rests.filter("slot >= all")
    sizes = rests.groupBy("source").agg(F.sum("length").alias("n"))
    many = max(1, rests.count() // BUCKET_SLOTS)
    sizes = sizes.withColumn("h", F.pmod(F.xxhash64("source"), F.lit(many)))
    sums = sizes.groupBy("h").agg(F.sum("n").alias("t"))
    sums = sums.withColumn("first", F.sum("t").over(Window.orderBy("h")) - F.col("t")).drop("t")  # one row a bucket
    sizes = sizes.withColumn("run", F.sum("n").over(Window.partitionBy("h").orderBy("source")) - F.col("n")).join(small(sums), "h")
    sizes = sizes.select("source", (F.col("first") + F.col("run") + F.lit(n_slots * slot)).alias("q"))
    ends = cut_at(rests.join(small(sizes), "source").withColumn("p", F.col("q") + F.col("at")), window)
    tail = ends.select(*rename, "start", "length", "ids_crc32", "doc_tokens", *last)
    return main.unionByName(tail)
