import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.log.level", "ERROR").getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return [_plain(x) for x in v] if isinstance(v, list | tuple) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a query gives its SQL twin's rows."""

    def check(query, sql):
        df, twin = query(spark, SF), duck.sql(sql)
        assert sorted(df.columns) == sorted(twin.columns)
        assert rows_of(df.columns, df.collect()) == rows_of(twin.columns, twin.fetchall())

    return check
