"""Numbers beside other numbers: a card must be found, and alone, whatever stands next to it. Queries over ``documents`` against their SQL."""

import duckdb
import pytest

from conftest import same_rows
from maskfold.plans.oracles import ORACLES
from maskfold.plans.queries import QUERIES

TEXTS = (
    "Al los +1 (836) 555-9331 4913187196670932 53.121.55.90 que.",
    "ensh 38.211.12.42 4366089147969128 ly",
    "th 38.253.197.126 4880761348116108",
    "t 4495589438270767 42 a.b@ex.com",
    "7536784127813050 4845168114407329",
    "4913187196670932-4366089147969128 und 4366089147969128",
    "1 909955422195631329054 4366089147969129",
    "no number",
)


@pytest.fixture(scope="module")
def neighbours(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("neighbours"))
    spark.createDataFrame([(k, TEXTS[k % len(TEXTS)]) for k in range(1, 4 * len(TEXTS) + 1)], "doc_id bigint, text string").write.parquet(f"{where}/documents.parquet")
    return where


def _equal(spark, where, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet/*.parquet'")
    same_rows(QUERIES[name](spark, where), con.sql(ORACLES[name]))


def test_cards_beside_numbers(spark, neighbours):
    _equal(spark, neighbours, "d05_card_documents")


def test_masks_beside_numbers(spark, neighbours):
    _equal(spark, neighbours, "flagship_mask")


def test_process_directions_beside_numbers(spark, neighbours):
    _equal(spark, neighbours, "t01_process_directions")


def test_process_batch_beside_numbers(spark, neighbours):
    _equal(spark, neighbours, "t02_process_batch")


def test_cards_of_short_groups_are_still_joined(spark):
    from maskfold.operators.detectors import detect

    docs = spark.createDataFrame([(1, "0000-0000-0000-0000 4366089147969128"), (2, "4366089147969128 0000 0000 0000 0000")], "doc_id bigint, text string")
    got = {r.doc_id: [c.value for c in r.candidates] for r in detect(docs, only=("card",)).collect()}
    assert got == {1: ["0000-0000-0000-0000", "4366089147969128"], 2: ["4366089147969128", "0000 0000 0000 0000"]}
