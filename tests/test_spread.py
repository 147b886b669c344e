"""Tables of narrow rows come as few row groups: the work on them must still be dealt over tasks, with the rows of SQL."""

import os

import duckdb
import pytest

from conftest import same_rows
from maskfold.plans import queries
from maskfold.plans.oracles import ORACLES
from maskfold.plans.queries import QUERIES

ROWS = 2_000
SPREAD = (
    "r05_partial_mask_all",
    "s02_inspect",
    "g08_compact_names",
    "x06_decisions",
    "m03_synthetic_round_trip",
    "g12_compact_surrogates",
    "s02_inspect_consumers",
    "g01_surrogates",
    "n02_name_forms",
    "e01_people",
    "g01_compact_decisions",
    "g03_compact_inn",
)


@pytest.fixture(scope="module")
def one_group(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("one-group"))
    spark.range(ROWS).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{where}/customer.parquet")
    return where


@pytest.mark.parametrize("name", SPREAD)
def test_one_row_group_is_dealt_over_tasks(spark, one_group, name):
    done = QUERIES[name](spark, one_group)
    # a number of tasks that was asked for is not merged again, as those of a later shuffle may be
    assert "REPARTITION_BY_NUM" in done._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{one_group}/customer.parquet/*.parquet'")
    same_rows(done, con.sql(ORACLES[name]))


def test_log_of_a_stream_is_dealt_over_files(spark, small, duck, monkeypatch):
    made, real = {}, queries.new_path
    monkeypatch.setattr(queries, "new_path", lambda session, what: made.setdefault(what, real(session, what)))
    done = QUERIES["s06_vault_stream"](spark, small)
    written = [f for f in os.listdir(made["vault-log"].removeprefix("file://")) if f.endswith(".parquet")]
    assert len(written) > queries.LOG_PARTS
    same_rows(done, duck.sql(ORACLES["s06_vault_stream"]))
