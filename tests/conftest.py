import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYTHONPATH", str(ROOT))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def oracle(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows_of(frame, columns):
    """Rows as a multiset that doesn't tell int from long, and rounds floats."""
    from collections import Counter

    def plain(x):
        if x is None or x != x:
            return None
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, bool):
            return x
        if isinstance(x, (int, float)):
            return round(float(x), 9)
        return str(x)

    return Counter(tuple(plain(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def same_as_oracle(spark, oracle, data):
    def check(query, sql):
        got, want = query(spark, data).toPandas(), oracle.execute(sql).df()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        assert rows_of(got, columns) == rows_of(want, columns)

    return check
