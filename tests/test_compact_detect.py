"""The compact profile searches a pattern only where a type is wanted and one of its keywords stands, and finds the same."""

from pyspark.sql import functions as F

from maskfold.operators import compact as cp

TEXTS = (
    "ИНН 7707083893, пин 1234, CVV 123, карта 4366089147969128",
    "7707083893 без слова. Родился 01.02.1990, выдан 3 марта 2010 года УМВД России по г. Москва",
    "адрес: Самара, Мира, 5-1; 100000, г. Самара, ул. Мира, д. 3, кв. 4; гражданство РФ, Россия",
    "Держатель карты IVANOV IVAN, card ИВАНОВ ИВАН " + "x" * 200 + " IVANOV PETR, инн " + "7707083893 " * 3,
    "İİİİ ИНН 7707083893 ПИН 1234",
    "",
    None,
)


def _docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")


def test_other_types_are_not_searched(spark, monkeypatch):
    searched, real = [], cp.find_spans
    monkeypatch.setattr(cp, "find_spans", lambda t, p, *more: searched.append(p) or real(t, p, *more))
    cp._candidates(F.col("text"), ("INN",))
    assert set(searched) == {cp.PATTERNS["inn"]}


def test_wanted_types_are_found_as_among_all(spark):
    for kinds in (("INN",), ("CVV", "PIN"), ("BIRTH_DATE",), ("ADDRESS", "CITIZENSHIP"), ("PASSPORT_ISSUER", "CARDHOLDER", "CARD_NUMBER")):
        wanted = F.filter("candidates", lambda c: c["type"].isin(*kinds))
        every = cp.detect(_docs(spark)).select("doc_id", F.explode(wanted).alias("c")).collect()
        assert every and sorted(every) == sorted(cp.detect(_docs(spark), only=kinds).select("doc_id", F.explode("candidates").alias("c")).collect())


def test_every_keyword_lets_its_type_through(spark):
    rows = [(kind, f"{w.upper()} х", True) for kind, (_, words) in cp.NEAR.items() for w in words] + [(kind, "х 1234 х", False) for kind in cp.NEAR]
    docs = spark.createDataFrame(rows, "kind string, text string, expected boolean")
    for kind in cp.NEAR:
        got = docs.where(F.col("kind") == kind).withColumn("got", cp.has_keyword(F.lower("text"), kind))
        assert got.where("got <> expected").count() == 0
