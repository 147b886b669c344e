"""Surrogates whose first draws give the original again: where both draws of a seed do, the next seed is tried, as in SQL."""

import duckdb
import pytest

from conftest import same_rows
from maskfold.plans.oracles import ORACLES
from maskfold.plans.queries import QUERIES

#: Customers whose passport issuer is drawn twice in a row, and one for whom it is not.
TWICE = (3008, 11488, 8)


@pytest.fixture(scope="module")
def drawn_twice(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("drawn-twice"))
    spark.createDataFrame([(k,) for k in TWICE], "c_custkey bigint").coalesce(1).write.parquet(f"{where}/customer.parquet")
    return where


@pytest.mark.parametrize("name", ["g01_surrogates", "m03_synthetic_round_trip"])
def test_original_drawn_twice(spark, drawn_twice, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{drawn_twice}/customer.parquet/*.parquet'")
    same_rows(QUERIES[name](spark, drawn_twice), con.sql(ORACLES[name]))
