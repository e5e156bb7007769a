import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def same_rows(df, con, sql):
    """Whether a DataFrame has the rows of the SQL, doubles to six digits."""

    def norm(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v.isoformat()[:19] if hasattr(v, "isoformat") else v

    cols = sorted(df.columns)
    got = sorted(str([norm(x) for x in r]) for r in df.select(*cols).collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    want = sorted(str([norm(x) for x in r]) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
    return got == want


@pytest.fixture
def duck():
    """A connection of its own for each test, so that an engine's fault in one can't fail others."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con
