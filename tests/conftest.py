import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(small):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{small}/{name}'")
    return con


def same_rows(frame, relation):
    """Whether a Spark frame and a DuckDB relation have the same rows, in any order."""
    a, b = frame.toPandas(), relation.df()
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    for c in columns:  # whole numbers with nulls come as floats from one side
        if {a[c].dtype.kind, b[c].dtype.kind} == {"f", "i"}:
            a[c], b[c] = a[c].astype("Int64"), b[c].astype("Int64")
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    assert a.equals(b), a[(a != b).any(axis=1)].head(3).to_string() + "\n" + b[(a != b).any(axis=1)].head(3).to_string()
