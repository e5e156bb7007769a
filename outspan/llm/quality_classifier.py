"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Cosines of random projections approximate a Gaussian kernel over standardised statistics. Partitions sum their part of the normal
equations; only these sums, whose size is FEATURES squared, come together. A fold that the regression has not seen gives counts by
score bin, and pooling adjacent violators turns them into a monotone calibration.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

FEATURES = 192
WIDTH = 2.5  # of the kernel, in standard deviations
RIDGE = 1e-3  # a training row
TRAIN_ROWS = 60_000  # labelled rows that the fit uses at most, chosen by a hash of the text's statistics
BINS = 400  # of the uncalibrated score
SEED = 20240607

_SYMBOLS = re.compile(r"[#*$%&|<>]+")
_UPPER = re.compile(r"[A-Z]+")
_PUNCT = re.compile(r"[!-/:-@\[-`{-~]+")
_DIGITS = re.compile(r"[0-9]+")


def statistics(text: str) -> list[float]:
    """Of a whole text; neither language nor source is looked at. An empty text has zeros."""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(STATS)
    letters = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    long_of = lambda p: sum(map(len, p.findall(text)))
    pairs = set(zip(words, words[1:], strict=False))
    return [
        math.log1p(n),
        letters / n,
        math.sqrt(long_of(_SYMBOLS) / chars),
        math.sqrt(long_of(_UPPER) / chars),
        math.sqrt(long_of(_PUNCT) / chars),
        math.sqrt(long_of(_DIGITS) / chars),
        math.sqrt(text.count("!") / chars),
        math.sqrt(text.count("|") / chars),
        math.sqrt(1 - len(set(lines)) / max(1, len(lines))),
        len(set(words)) / n ** 0.9,
        len(pairs) / max(1, n - 1),
        math.log1p(n / max(1, len(lines))),
        math.sqrt(text.count(".") / n),
    ]


STATS = ("log_words", "word_length", "symbols", "capitals", "punctuation", "digits", "exclamations", "bars", "repeated_lines", "distinct_words", "distinct_pairs", "line_words", "stops")


def text_vectors(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns and ``v``, the statistics of the text."""
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = pa.array([statistics(t.as_py() or "") for t in b.column("__text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), v], names=schema.fieldNames())

    return df.select(*keep, df[text].cast("string").alias("__text")).mapInArrow(run, schema)


def _projection() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(0, 1 / WIDTH, (len(STATS), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def _kernel_features(v: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    w, shift = _projection()
    z = np.clip((v - centre) / spread, -8, 8)
    return np.hstack([np.ones((len(v), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ w + shift)])


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS)) if len(column) else np.zeros((0, len(STATS)))


def pool_adjacent_violators(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Least-squares nondecreasing fit of y with weights w; x is sorted."""
    level, weight, size = [], [], []
    for yi, wi in zip(y, w, strict=True):
        level.append(yi), weight.append(wi), size.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            total = weight[-2] + weight[-1]
            level[-2] = (level[-2] * weight[-2] + level[-1] * weight[-1]) / total
            weight[-2], size[-2] = total, size[-2] + size[-1]
            level.pop(), weight.pop(), size.pop()
    return np.repeat(level, size)


def fit(train: DataFrame) -> dict:
    """A model from rows (v, y, fold): fold 0 and up; the last fold calibrates. Without rows the model gives 1/2."""
    n = train.count()
    if not n:
        return {"beta": None}
    share = min(1.0, TRAIN_ROWS / n)
    train = materialize(train.filter(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(share * 1_000_000)), "train") if share < 1 else train
    k = len(STATS)
    moments = train.agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(k)], *[F.stddev_pop(F.col("v")[i]).alias(f"s{i}") for i in range(k)]).first()
    centre = np.array([moments[f"m{i}"] for i in range(k)])
    spread = np.maximum(np.array([moments[f"s{i}"] for i in range(k)]), 0.02)
    d = FEATURES + 1
    tri = np.tril_indices(d)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((d, d)), np.zeros(d)
        for x in batches:
            z = _kernel_features(_matrix(x.column("v")), centre, spread)
            a += z.T @ z
            b += z.T @ x.column("y").to_numpy(zero_copy_only=False)
        values = np.concatenate([a[tri], b])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["i", "x"])

    fold = F.col("fold") < F.lit(3)
    parts = train.filter(fold).select("v", F.col("y").cast("double").alias("y")).coalesce(16)
    got = parts.mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
    if not len(got):
        return {"beta": None}
    a = np.zeros((d, d))
    a[tri] = got[: len(tri[0])]
    a = a + np.tril(a, -1).T
    beta = np.linalg.solve(a + RIDGE * max(1.0, a[0, 0]) * np.eye(d), got[len(tri[0]) :])
    model = {"beta": beta, "centre": centre, "spread": spread}
    raw = raw_scores(train.filter(~fold).select("v", F.col("y").cast("double").alias("y")), model, ["y"])
    bins = raw.groupBy(F.floor(F.least(F.greatest(F.col("raw"), F.lit(-0.5)), F.lit(1.5)) * BINS).alias("b")).agg(F.sum("y").alias("y"), F.count("y").alias("n")).toPandas().sort_values("b")
    if len(bins):
        x, w = (bins["b"].to_numpy() + 0.5) / BINS, bins["n"].to_numpy(float)
        y = pool_adjacent_violators(x, (bins["y"].to_numpy(float)) / w, w)
        model |= {"x": x, "y": y}
    return model


def raw_scores(df: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("raw", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"))
            raw = np.full(len(v), 0.5) if model["beta"] is None else _kernel_features(v, model["centre"], model["spread"]) @ model["beta"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(raw)], names=schema.fieldNames())

    return df.select(*keep, "v").mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document: ``keep``, fold (crc32 of the key as text, modulo 5) and score, the calibrated chance of label 1.

    Labels with a null key or label are left out; several labels of a key are averaged; those of fold 0 are never read. A null text
    counts as empty, and each row has a score, repeated rows the same one. Without usable labels every score is 1/2."""
    fold = F.coalesce(F.crc32(F.col("__key").cast("string")) % 5, F.lit(-1))
    base = docs.select(*[docs[c] for c in keep], docs[key].alias("__key"), docs[text].cast("string").alias("__t"))
    vectors = materialize(text_vectors(base, "__t", [*keep, "__key"]).withColumn("fold", fold), "vectors")
    known = labels.filter(labels[key].isNotNull() & labels[label].isNotNull()).groupBy(labels[key].alias("__key")).agg(F.avg(labels[label].cast("double")).alias("y"))
    train = vectors.filter("fold > 0").join(known, "__key").select("v", "y", (F.col("fold") - 1).alias("fold"))
    model = fit(materialize(train, "labelled"))
    out = raw_scores(vectors, model, [*keep, "fold"])
    if model.get("x") is None:
        return out.withColumn("score", F.least(F.greatest(F.col("raw"), F.lit(0.0)), F.lit(1.0)))
    xs, ys = model["x"], model["y"]

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("raw").to_numpy()
            # A small share of the raw score keeps the order inside a flat step of the calibration.
            score = 0.98 * np.interp(raw, xs, ys) + 0.02 * np.clip(raw, 0, 1)
            yield b.append_column("score", pa.array(np.clip(score, 0, 1)))

    return out.mapInArrow(calibrate, T.StructType([*out.schema.fields, T.StructField("score", T.DoubleType())]))
