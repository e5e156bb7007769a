"""Registers queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bindings import Tables


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracle: dict = {}

    def query(name: str, sql: str | None = None):
        def add(f):
            queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                oracle[name] = sql
            return f

        return add

    return queries, oracle, query


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines agree."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])
