"""Only words beside another capitalised word are looked up, and the names found are those that Python finds."""

from pyspark.sql import functions as F

from maskfold.operators.name_runs import name_candidates, neighboured
from maskfold.operators.names import find_names

TEXTS = (
    "Анна Иван", "АннаИван Петров", "Слово. Иванов И.П. и И. П. Петров", "Иван\n\nПетров", "Иван, Петров Пётр", "Банк Иванова Мария-Анна Ивановна. Потом Юрий", "И.И. Иванов", "Иванов",
    "Иван -Петров", "Сегодня хорошая погода. Клиент ушёл", "",
)


def test_words_alone_are_not_looked_up(spark):
    docs = spark.createDataFrame([("Банк и Дом. Иван Петров и Анна, Олег\nЛев", )], "text string")
    assert [x.value for x in docs.select(neighboured(F.col("text")).alias("w")).first().w] == ["Иван", "Петров", "Олег", "Лев"]


def test_names_are_those_of_python(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", name_candidates(F.col("text")).alias("c"))
    for r in docs.collect():
        assert sorted((c.value, c.start, c.end) for c in r.c) == sorted((c[1], c[2], c[3]) for c in find_names(r.text)), r.text
