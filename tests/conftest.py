import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoint')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, sf, duck):
    """A check that a query and its SQL give the same rows, in any order."""

    def check(query, sql):
        df = query(spark, sf)
        names = sorted(df.columns)
        ours = sorted(str(tuple(r)) for r in df.select(*[f"`{c}`" for c in names]).collect())
        found = duck.execute(sql)
        at = [[c[0] for c in found.description].index(n) for n in names]
        assert sorted(c[0] for c in found.description) == names
        theirs = sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())
        assert ours == theirs

    return check
