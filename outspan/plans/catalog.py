"""The registered queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from . import queries_base, queries_quiet, queries_stats, queries_windows

QUERIES: dict = {}
ORACLE: dict = {}
for _m in (queries_base, queries_stats, queries_quiet, queries_windows):
    if twice := QUERIES.keys() & _m.QUERIES.keys():
        raise ValueError(f"registered twice: {sorted(twice)}")
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
