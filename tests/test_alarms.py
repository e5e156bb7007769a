"""Quiet alarms over several batches with late rows, against the table's own alarms."""

import time

import pytest
from pyspark.sql import functions as F

from outspan.streaming import monitor


def _feed(spark, folder, batches):
    for rows in batches:
        df = spark.createDataFrame(rows, "traj_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # files are taken in the order of their times
    return spark.readStream.schema("traj_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _run(alarms, folder):
    seen = []
    q = alarms.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(lambda b, n: seen.append([(r["traj_id"], r["last_ts"].day, r["alarm_ts"].day) for r in b.collect()])).start()
    q.awaitTermination()
    return [sorted(x) for x in seen]


def at(day, hour=12):
    return f"2024-01-{day:02d} {hour:02d}:00:00"


def test_alarms(spark, tmp_path):
    """Alarms fire without a new event of their trajectory, each once; a row within the lateness prevents its alarm, a later one is dropped."""
    batches = [
        [(1, at(1)), (2, at(1)), (3, at(1)), (1, at(1)), (None, at(1)), (9, None)],
        [(2, at(3)), (1, at(6))],  # the watermark goes to the 5th: 3 is quiet from the 1st, and 1 until the 6th
        [(2, at(5, 13)), (8, at(2))],  # both in time: what is late is told by the watermark of the batch before
        [(7, at(12)), (3, at(2))],  # the 11th; 3 is late
        [(7, at(30))],  # the 29th
    ]
    seen = _run(monitor.stream_quiet_alarms(_feed(spark, tmp_path, batches), "3 days"), tmp_path)
    assert sorted(a for b in seen for a in b) == [(1, 1, 4), (1, 6, 9), (2, 5, 8), (3, 1, 4), (7, 12, 15), (8, 2, 5)]
    assert [b for b in seen if b][0] == [(1, 1, 4), (3, 1, 4)]  # without another row of theirs; the quiet time of 8 ends on the watermark, not before it
    kept = spark.createDataFrame([(t, x) for b in batches for t, x in b if (t, x) != (3, at(2))], "traj_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    table = sorted((r["traj_id"], r["last_ts"].day, r["alarm_ts"].day) for r in monitor.quiet_alarms(kept, "3 days").collect())
    assert table == sorted(a for b in seen for a in b)


def test_state_ends(spark, tmp_path):
    """When all trajectories have been told quiet no state is left but the last one's."""
    s = monitor.stream_quiet_alarms(_feed(spark, tmp_path, [[(i, at(1)) for i in range(20)], [(99, at(20))], [(99, at(21))]]), "2 days")
    q = s.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, n: b.count()).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_spans(spark):
    with pytest.raises(ValueError):
        monitor.stream_quiet_alarms(spark.readStream.format("rate").load().selectExpr("value AS traj_id", "timestamp AS ts"), "0 days")
    none = spark.createDataFrame([], "traj_id long, ts timestamp")
    assert monitor.quiet_alarms(none, "1 day").count() == 0
