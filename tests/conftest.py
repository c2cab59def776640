"""A local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def same_rows(spark, queries, oracles, name, sf_dir=SF):
    """Compare a query with its SQL; returns the number of rows."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{t}')")
    got = queries[name](spark, sf_dir).toPandas()
    want = con.sql(oracles[name]).df()
    assert sorted(got.columns) == sorted(want.columns), name

    def plain(v):
        if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
            v = v.tolist()
        if isinstance(v, list):
            return repr([plain(x) for x in v])
        if v is None or v is pd.NA or v != v:
            return "null"
        if isinstance(v, float):
            return f"{v:.9g}" if v else "0"
        return f"{float(v):.9g}" if isinstance(v, int) and not isinstance(v, bool) else repr(v)

    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(got) == rows(want), name
    return len(got)
