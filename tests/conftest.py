import os

import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """Runs SQL on the test tables: column names and sorted rows."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{DATA}/{f}')")

    def run(sql):
        got = con.execute(sql)
        names = [x[0] for x in got.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(names), sorted(repr(tuple(r[i] for i in order)) for r in got.fetchall())

    return run


@pytest.fixture(scope="session")
def same(duck):
    def check(df, sql):
        names = sorted(df.columns)
        want, rows = duck(sql)
        assert names == want
        assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == rows

    return check
