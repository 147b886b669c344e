"""Every registered query against its SQL, on the smallest tables."""

import pytest

from conftest import same_rows
from maskfold.plans.oracles import ORACLES
from maskfold.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    same_rows(QUERIES[name](spark, small), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_all_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship_runs_no_python_and_no_shuffle(spark, small):
    plan = QUERIES["flagship_mask"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_round_trips_are_exact(spark, small):
    done = QUERIES["m03_synthetic_round_trip"](spark, small)
    assert done.where("not restored_exactly").count() == 0
    assert QUERIES["m02_token_round_trip"](spark, small).where("restored <> exact").count() == 0


def test_overlaps_of_all_orders_against_brute_force(spark, small):
    ranked = []
    for r in spark.read.parquet(f"{small}/orders.parquet").select("o_custkey", "o_orderkey").collect():
        k, start = r.o_orderkey, r.o_orderkey * 13 % 97
        ranked.append((r.o_custkey, -(k % 4), -(3 + k % 11), start, k % 1000003, k))
    chosen = {}
    for customer, _, length, start, _, k in sorted(ranked):
        own = chosen.setdefault(customer, [])
        if not any(s < start - length and start < e for _, s, e in own):
            own.append((str(k), start, start - length))
    want = sorted((c, *x) for c, own in chosen.items() for x in own)
    assert sorted((r.doc_id, r.value, r.start, r.end) for r in QUERIES["o1_overlaps"](spark, small).collect()) == want
