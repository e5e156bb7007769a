"""Histograms, time matrices and quiet times over an event stream (traj_id, t, ts)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.collect import bin_of, day_state


def stream_hist1d(stream: DataFrame, expr: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Running histogram counts; write it in update or complete mode."""
    return stream.select(bin_of(F.expr(expr).cast("double"), bins, lo, hi).alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


def stream_day_state(stream: DataFrame, T: int, cutoff: int) -> DataFrame:
    """State of each trajectory: last day and first day after the cutoff."""
    return day_state(stream, T, cutoff)


def matrix_sink(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that turns complete trajectory states into the time matrix and hands it to ``write``."""

    def batch(df: DataFrame, batch_id: int) -> None:
        write(df.groupBy("last_day", "first_after").agg(F.count("*").alias("n")), batch_id)

    return batch


def stream_quiet_monitor(stream: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Events and last event of each trajectory by window; rows later than the watermark are dropped, and so is their state."""
    return stream.withWatermark("ts", late).groupBy("traj_id", F.window("ts", window)).agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def quiet_times(last: DataFrame, now: str = "last_ts") -> DataFrame:
    """From window rows the quiet time of each trajectory, in days, at the latest event of all."""
    per = last.groupBy("traj_id").agg(F.max(now).alias("last_ts"))
    top = per.agg(F.max("last_ts").alias("now"))
    return per.crossJoin(F.broadcast(top)).select("traj_id", ((F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 86400e6).alias("quiet_days"))


def stream_quiet_alarms(stream: DataFrame, quiet: str, late: str = "1 day") -> DataFrame:
    """Rows (traj_id, last_ts, alarm_ts): one for each event that none of its trajectory follows within ``quiet``, without waiting for the next
    event: a timer of the trajectory fires once the watermark has passed the end of the quiet time, when no earlier row can come any more.

    The state of a trajectory is the times that may still be asked for: those whose quiet time is open. It goes when all are settled, so
    trajectories that have ended hold none. Equal times count once; rows without a time or an id are left out, and rows later than the
    watermark of the batch before, which is what Spark drops; what a timer has told is never undone, as it fires by that watermark or a later one.
    Write it in append mode. Spark hands a trajectory's rows of one batch to one task, in pieces; ``late`` and ``quiet`` bound what is kept of them."""
    span = int(pd.Timedelta(quiet).value // 1000)
    if span <= 0:
        raise ValueError("quiet must be a positive span of time")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = stream.filter("ts IS NOT NULL AND traj_id IS NOT NULL").withWatermark("ts", late).select("traj_id", "ts", micros.alias("at"))

    def settle(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = np.array(state.get[0] if state.exists else [], np.int64)
        for p in () if state.hasTimedOut else parts:
            at = np.union1d(at, p["at"].to_numpy(np.int64))
        mark = state.getCurrentWatermarkMs()
        # All that can follow within the quiet time of these is known.
        done = np.searchsorted((at + span) // 1000, mark)
        lonely = np.append(np.diff(at) > span, True)[:done]
        if done == len(at):
            state.remove()
        else:
            state.update((at[done:].tolist(),))
            state.setTimeoutTimestamp(max(int((at[done] + span) // 1000), mark + 1))
        last = at[:done][lonely]
        yield pd.DataFrame({"traj_id": np.full(len(last), key[0]), "last": last, "alarm": last + span})

    kind = dict(rows.dtypes)["traj_id"]
    out = rows.groupBy("traj_id").applyInPandasWithState(settle, f"traj_id {kind}, last long, alarm long", "at array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("traj_id", F.timestamp_micros("last").alias("last_ts"), F.timestamp_micros("alarm").alias("alarm_ts"))


def quiet_alarms(events: DataFrame, quiet: str, late: str = "1 day") -> DataFrame:
    """The same rows from a table of events in the order of their times, up to where the stream's watermark would stand after the last of them."""
    span = int(pd.Timedelta(quiet).value // 1000)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    at = events.filter("ts IS NOT NULL AND traj_id IS NOT NULL").select("traj_id", micros.alias("at"))
    mark = at.agg((F.floor(F.max("at") / 1000) - pd.Timedelta(late).value // 1_000_000).alias("mark"))
    gap = at.withColumn("next", F.lead("at").over(Window.partitionBy("traj_id").orderBy("at")))
    open_ = F.col("next").isNull() | (F.col("next") - F.col("at") > span)
    rows = gap.filter(open_).crossJoin(F.broadcast(mark)).filter(F.floor((F.col("at") + span) / 1000) < F.col("mark"))
    return rows.select("traj_id", F.timestamp_micros("at").alias("last_ts"), F.timestamp_micros(F.col("at") + span).alias("alarm_ts"))
