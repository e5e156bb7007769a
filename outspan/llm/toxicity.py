"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Each sentence gets a logistic score from its words; noisy-or combines the sentences of a document, and the likelihood of document
labels trains the word weights. No sentence is labelled, yet the model says which sentences offend. Words come from document
frequencies by label; gradients are summed by partition, and only these sums, as many as there are words, come together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, part_count

VOCABULARY = 1024  # words and beginnings of words that the model weighs: those whose frequencies tell the labels apart best
TRAIN_ROWS = 30_000  # labelled documents that the fit uses at most, chosen by a hash of the text
STEPS = 40
RATE = 0.6
SHRINK = 2e-4  # ridge on word weights
START = -7.0  # logit of a sentence without known words, before training

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans of runs without a stop, mark or line end, in code points."""
    for m in _SENTENCE.finditer(text):
        if not m[0].isspace():
            yield m.start(), m.end()


def features_of(word: str) -> list[str]:
    """What the model may weigh of a word: its beginnings of 3 to 8 letters, which many forms share, and the whole word with its end marked."""
    return [word[:k] for k in range(3, min(8, len(word)) + 1)] + [word + "$"]


def _word_sets(texts: list[str], index: dict[str, int]) -> list[tuple[int, list[tuple[int, int, list[int]]]]]:
    """Of each text the number of sentences, and those with known words: start, end, sorted word numbers."""
    out = []
    heads = {w[:3] for w in index}
    for t in texts:
        n, found = 0, []
        low = t.lower()
        exact = len(low) == len(t)
        for a, b in sentences(t):
            n += 1
            ws = {index[x] for w in _WORD.findall(low[a:b] if exact else t[a:b].lower()) if w[:3] in heads or w + "$" in heads for x in features_of(w) if x in index}
            if ws:
                found.append((a, b, sorted(ws)))
        out.append((n, found))
    return out


def _log_clean(a: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(a))"""
    return -np.logaddexp(0, a)


def choose_words(train: DataFrame) -> list[str]:
    """Words and beginnings by the G statistic of their document counts against the labels; rows are (t, y)."""
    total = train.agg(F.sum("y").alias("t"), F.count("y").alias("n")).first()
    toxic, n = float(total["t"] or 0), float(total["n"])
    if not 0 < toxic < n:
        return []
    schema = "w string, t double, n double"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, list[float]] = {}
            for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist(), strict=True):
                for w in {x for w in set(_WORD.findall((t or "").lower())) for x in features_of(w)}:
                    c = seen.setdefault(w, [0.0, 0.0])
                    c[0] += y
                    c[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([c[0] for c in seen.values()], pa.float64()), pa.array([c[1] for c in seen.values()], pa.float64())], names=["w", "t", "n"])

    counts = train.select("t", "y").mapInArrow(count, schema).groupBy("w").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).filter("n >= 3")
    p = (F.col("t") + 0.5) / (F.col("n") + 1)
    q = toxic / n
    g = F.col("n") * (p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q)))
    return [r["w"] for r in counts.filter(p > q).orderBy(g.desc(), "w").limit(VOCABULARY).select("w").collect()]


def fit(train: DataFrame) -> dict:
    """Word weights from rows (t, y). Without both labels the model gives the share of label 1, or 0 without rows."""
    n = train.count()
    if n > TRAIN_ROWS:
        train = materialize(train.filter(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < int(1_000_000 * TRAIN_ROWS / n)), "sample")
    train = materialize(train.select("t", "y").repartition(part_count(train)), "even")  # few files may hold the sample
    words = choose_words(train)
    if not words:
        return {"words": [], "weights": np.zeros(0), "bias": START}
    index = {w: i for i, w in enumerate(words)}
    schema = T.StructType([T.StructField("y", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("words", T.ArrayType(T.IntegerType()))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _word_sets([t or "" for t in b.column("t").to_pylist()], index)
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([n for n, _ in found], pa.int64()), pa.array([[len(w) for *_, w in f] for _, f in found], pa.list_(pa.int32())), pa.array([[i for *_, w in f for i in w] for _, f in found], pa.list_(pa.int32()))], names=schema.fieldNames())

    data = materialize(train.select("t", "y").mapInArrow(features, schema).coalesce(12), "mil")
    k = len(words)
    theta = np.zeros(k + 1)
    theta[k] = START
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):

        def gradient(batches: Iterator[pa.RecordBatch], theta=theta.copy()) -> Iterator[pa.RecordBatch]:
            g = np.zeros(k + 2)
            for b in batches:
                y, n = b.column("y").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False)
                counts = np.diff(b.column("sizes").offsets.to_numpy())
                sizes, flat = b.column("sizes").flatten().to_numpy(zero_copy_only=False), b.column("words").flatten().to_numpy(zero_copy_only=False)
                doc, sent = np.repeat(np.arange(len(y)), counts), np.repeat(np.arange(len(sizes)), sizes)
                a = np.bincount(sent, theta[flat], len(sizes)) + theta[k]
                plain = n - counts
                clean = plain * _log_clean(theta[k : k + 1])[0] + np.bincount(doc, _log_clean(a), len(y))
                p = -np.expm1(np.minimum(clean, -1e-12))
                # Slope of the log likelihood in a sentence's logit, over its sigmoid.
                slope = y * np.exp(np.minimum(clean, 0)) / p - (1 - y)
                s = 1 / (1 + np.exp(-a)) * slope[doc]
                g[:k] += np.bincount(flat, s[sent], k)
                g[k] += s.sum() + (plain * slope).sum() / (1 + np.exp(-theta[k]))
                g[k + 1] += len(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 2, dtype=np.int32)), pa.array(g)], names=["i", "g"])

        g = data.mapInArrow(gradient, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas().sort_values("i")["g"].to_numpy()
        g = g[: k + 1] / max(1.0, g[k + 1])
        g[:k] -= SHRINK * theta[:k]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        theta = theta + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8) * (1 - step / (STEPS + 10))
    return {"words": words, "weights": theta[:k], "bias": float(theta[k])}


def toxicity_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document: ``keep``, fold (crc32 of the key as text, modulo 5), score, and offending: spans (start, end, score) of
    sentences that are toxic rather than not.

    Labels with a null key or label are left out; several labels of a key are averaged; those of fold 0 are never read. A null or
    empty text has no sentence: its score is 0. Repeated rows get the same score. Without labels of both kinds no word counts and
    scores stay near 0."""
    fold = F.coalesce(F.crc32(F.col("__key").cast("string")) % 5, F.lit(-1))
    base = docs.select(*[docs[c] for c in keep], docs[key].alias("__key"), docs[text].cast("string").alias("t")).withColumn("fold", fold)
    known = labels.filter(labels[key].isNotNull() & labels[label].isNotNull()).groupBy(labels[key].alias("__key")).agg(F.avg(labels[label].cast("double")).alias("y"))
    known = known.filter(F.crc32(F.col("__key").cast("string")) % 5 > 0)
    n = known.count()
    if n > TRAIN_ROWS:  # the sample is drawn before texts move
        known = known.filter(F.pmod(F.xxhash64(F.col("__key").cast("string")), F.lit(1_000_000)) < int(1_000_000 * TRAIN_ROWS / n))
    known = materialize(known, "known")
    chosen = base.filter("fold > 0").join(F.broadcast(known), "__key").select("t", "y")  # TRAIN_ROWS keys, about, at most
    model = fit(materialize(chosen, "toxic"))
    index = {w: i for i, w in enumerate(model["words"])}
    weights, bias = model["weights"], model["bias"]
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fold", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("offending", spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = -float(np.logaddexp(0, bias))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            scores, where = [], []
            for n, found in _word_sets([t or "" for t in b.column("t").to_pylist()], index):
                a = [bias + float(weights[w].sum()) for *_, w in found]
                clean = (n - len(found)) * plain + sum(-float(np.logaddexp(0, x)) for x in a)
                scores.append(float(-np.expm1(clean)))
                where.append([{"start": s, "end": e, "score": float(1 / (1 + np.exp(-x)))} for (s, e, _), x in zip(found, a, strict=True) if x >= 0])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), b.column("fold"), pa.array(scores, pa.float64()), pa.array(where, kind)], names=schema.fieldNames())

    return base.select(*keep, F.col("fold").cast("long").alias("fold"), "t").mapInArrow(run, schema)
