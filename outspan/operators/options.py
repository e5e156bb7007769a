"""Many options of acceptance windows at once: options are rows, so one plan makes and scores the windows of all of them.

An option table has ``option_id`` and a column for each field of WindowOptions; with a column ``series_id`` each option is for that
series alone, without it for all. ``z_alpha`` and ``z_beta`` hold the normal quantiles of alpha and beta.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import series
from ..model import WindowOptions
from .criteria import small
from .windows import KEY, option_arrays

_KIND = {f.name: f.type for f in fields(WindowOptions)}
FIELDS = tuple(_KIND)
_TYPES = {"float": "double", "int": "long", "bool": "boolean", "str": "string"}
SCHEMA = ", ".join(["option_id long", *(f"{c} {_TYPES[kind]}" for c, kind in _KIND.items()), "z_alpha double", "z_beta double"])
#: Accepted trajectories below which the objective takes a surcharge.
LEAST = 80
#: Events of a series from which its trajectories are dealt to several tasks, each with the series' observations.
CHUNK = 20_000


def option_table(spark: SparkSession, options: dict[int, WindowOptions]) -> DataFrame:
    return spark.createDataFrame([(oid, *asdict(o).values(), o.z_alpha, o.z_beta) for oid, o in options.items()], SCHEMA)


_NAMES = ("option_id", *FIELDS, "z_alpha", "z_beta")


class _Units:
    """The units of a batch, which are series with one of their options: options that are rows of the batch, or all of ``shared``."""

    def __init__(self, options: DataFrame):
        self.own = KEY in options.columns
        self.shared = [] if self.own else [r.asDict() for r in options.select(*_NAMES).collect()]

    def rows(self, obs: DataFrame, options: DataFrame) -> DataFrame:
        """Observations (kind 0) and, where options have a series, those (kind 2)."""
        out = obs.select(KEY, F.lit(0).alias("kind"), F.col("d").cast("double").alias("x"), F.col("n").cast("double").alias("y"))
        if self.own:
            out = out.unionByName(options.select(KEY, F.lit(2).alias("kind"), F.struct(*_NAMES).alias("option")), allowMissingColumns=True)
        return out.filter(F.col(KEY).isNotNull())

    def of(self, table: pa.Table, s: np.ndarray, kind: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Series, number and options of each unit."""
        if self.own:
            at = np.flatnonzero(kind == 2)
            own, every = s[at], table["option"].take(pa.array(at)).to_pylist()
        else:
            own, every = np.repeat(np.arange(count), len(self.shared)), self.shared
        o, ids = option_arrays(every), np.array([x["option_id"] for x in every])
        return (own, ids, o) if self.own else (own, np.tile(ids, count), {k: np.tile(v, count) for k, v in o.items()})


def _batch(table: pa.Table, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, series.Observed]:
    s = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(table))))
    kind, x = table["kind"].to_numpy(), series.floats(table["x"])
    seen = np.flatnonzero(kind == 0)
    return s, kind, x, series.Observed(s[seen], x[seen], series.floats(table["y"])[seen], len(start))


def windows_by_option(obs: DataFrame, options: DataFrame) -> DataFrame:
    """Acceptance windows (series_id, option_id, a, b, L, U) of every option. Neither the plan nor what is shuffled grows with the options: a series is dealt to a task as
    its observations, and its options meet it there. Series are cut into segments once for all options of equal step, least length and number of chords."""
    units = _Units(options)

    def kernel(table: pa.Table, start: np.ndarray) -> Iterator[pa.Table]:
        s, kind, _, seen = _batch(table, start)
        own, ids, o = units.of(table, s, kind, len(start))
        for part, (g, a, b, L, U) in seen.windows(own, o) if len(own) else ():
            yield pa.table({KEY: table[KEY].take(pa.array(start[own[part]][g])), "option_id": ids[part][g], "a": a, "b": b, "L": L, "U": U})

    kinds = T.StructType([obs.schema[KEY], options.schema["option_id"], *(T.StructField(c, k) for c, k in zip("abLU", (T.DoubleType(),) * 2 + (T.LongType(),) * 2, strict=True))])
    return series.by_series(units.rows(obs, options), [KEY], ["kind", "x"], kernel, kinds)


def _accepted(obs: DataFrame, events: DataFrame, options: DataFrame) -> DataFrame:
    """Of each series, option and part of the trajectories: how many are accepted, their cumulative counts at the observations and those observed (arrays).

    Windows are made where the trajectories are, from the series' observations, so they are never shuffled. A series with more than CHUNK events
    is dealt to several tasks by trajectory."""
    units = _Units(options)
    t = events.select(KEY, F.lit(1).alias("kind"), "traj_id", F.col("t").cast("double").alias("x")).filter(F.col(KEY).isNotNull())
    many = t.groupBy(KEY).agg(F.count("*").alias("__n")).filter(F.col("__n") > CHUNK).select(KEY, F.ceil(F.col("__n") / CHUNK).cast("int").alias("__parts"))
    many = small(many)
    dealt = t.join(many, KEY, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("traj_id"), F.col("__parts")).cast("int"), F.lit(0)))
    every = units.rows(obs, options).join(many, KEY, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    rows = every.drop("__parts").unionByName(dealt.drop("__parts"), allowMissingColumns=True)

    def kernel(table: pa.Table, start: np.ndarray) -> Iterator[pa.Table]:
        s, kind, x, seen = _batch(table, start)
        own, ids, o = units.of(table, s, kind, len(start))
        at = np.flatnonzero(kind == 1)
        # A trajectory without an id has no events, but is one.
        traj = table["traj_id"].take(pa.array(at))
        here = series.Tested(s[at], series.codes(traj), np.where(traj.is_null().to_numpy(), np.nan, x[at]), len(start))
        some = np.flatnonzero(here.many[own] * seen.size[own])
        own, ids, o = own[some], ids[some], {k: v[some] for k, v in o.items()}
        if not len(own):
            return
        slot, marks, upto, after = seen.slots(here)
        for part, win in seen.windows(own, o, here.many[own] + 1):
            mine = own[part]
            unit, q = here.accepted(mine, win)
            accepted = np.bincount(unit, minlength=len(mine))
            kept = np.flatnonzero(accepted)
            where = np.cumsum(marks[mine[kept]]) - marks[mine[kept]]
            length = int(marks[mine[kept]].sum())
            which, e = series.units(q, here.start, here.size)
            u = np.searchsorted(kept, unit[which])
            inside = slot[e] < marks[mine[kept]][u]
            c = np.cumsum(np.bincount((where[u] + slot[e])[inside], minlength=length))
            before = np.concatenate([[0], c])[where]
            c = c - np.repeat(before, marks[mine[kept]])
            _, at = series.units(mine[kept], after, marks)
            ends = pa.array(np.append(where, length).astype(np.int32))
            yield pa.table({
                KEY: table[KEY].take(pa.array(start[mine[kept]])), "option_id": ids[part][kept], "accepted": accepted[kept].astype(np.int64),
                "cum": pa.ListArray.from_arrays(ends, pa.array(c.astype(np.int64))), "y": pa.ListArray.from_arrays(ends, pa.array(upto[at])),
            })

    kinds = T.StructType([obs.schema[KEY], options.schema["option_id"], T.StructField("accepted", T.LongType()), T.StructField("cum", T.ArrayType(T.LongType())), T.StructField("y", T.ArrayType(T.DoubleType()))])
    return series.by_series(rows, [KEY, "part"], ["kind", "traj_id", "x"], kernel, kinds)


def score_options(obs: DataFrame, events: DataFrame, options: DataFrame | dict[int, WindowOptions]) -> DataFrame:
    """Rows (series_id, option_id, accepted, objective): trajectories of ``events`` that an option's windows accept, and the mean squared
    distance between observed and mean accepted cumulative counts at the observations, with a surcharge below 80. Options that accept
    none have no row."""
    if isinstance(options, dict):
        options = option_table(obs.sparkSession, options)
    parts = _accepted(obs, events, options)
    both = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    kept = parts.groupBy(KEY, "option_id").agg(F.sum("accepted").alias("accepted"), F.collect_list("cum").alias("cums"), F.first("y").alias("y"))
    cum = F.when(F.size("cums") == 1, F.col("cums")[0]).otherwise(F.aggregate(F.slice("cums", F.lit(2), F.size("cums")), F.col("cums")[0], both))
    off = F.zip_with("y", "cum", lambda y, c: F.pow(y - c / F.col("accepted"), F.lit(2)))
    l2 = F.aggregate(off, F.lit(0.0), lambda a, x: a + x) / F.size("y")
    short = F.when(F.col("accepted") < LEAST, F.pow(LEAST - F.col("accepted"), F.lit(2))).otherwise(0.0)
    return kept.withColumn("cum", cum).select(KEY, "option_id", "accepted", (l2 + short).alias("objective"))


def best_options(scored: DataFrame) -> DataFrame:
    return scored.groupBy(KEY).agg(F.min_by(F.struct("option_id", "accepted", "objective"), F.struct("objective", "option_id")).alias("b")).select(KEY, "b.*")
