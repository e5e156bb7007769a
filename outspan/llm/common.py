"""What the text operators share: scratch tables in the shared folder, and small column helpers."""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship

#: Rows that a broadcast side may have; beyond it the join is a shuffle.
BROADCAST_ROWS = 50_000


_LOCAL = threading.local()  # the open scopes: threads that run operators beside each other have their own


def _scopes() -> list[list[tuple]]:
    if not hasattr(_LOCAL, "scopes"):
        _LOCAL.scopes = []
    return _LOCAL.scopes


def materialize(df: DataFrame, tag: str, *, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there, and lost executors cost nothing
    that came before. The table is deleted when the scratch() around it ends, with ``keep`` the next one around
    that, and without any when the program ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/outspan-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = (spark._jvm, spark._jsc.hadoopConfiguration(), path)  # of the session's JVM, which outlives the session
    scopes = _scopes()[:-1] if keep else _scopes()
    if scopes:
        scopes[-1].append(made)
    else:
        atexit.register(_delete, *made)
    out = spark.read.schema(df.schema).parquet(path)
    out._outspan_table = made
    return out


def discard(table: DataFrame) -> None:
    """Deletes what materialize() wrote, before its scope ends: nothing reads it any more."""
    _delete(*table._outspan_table)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are materialized inside are gone after it, but those to keep: what follows may read only these."""
    _scopes().append([])
    try:
        yield
    finally:
        for made in _scopes().pop():
            _delete(*made)


def _delete(jvm, conf, path: str) -> None:
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # noqa: BLE001  the JVM is gone already
        return


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once a row although the body names it often."""
    return F.transform(F.array(value), body)[0]


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks ``df`` for broadcast if a count proves it small; otherwise leaves the choice of the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def part_count(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
