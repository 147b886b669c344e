"""The native name detector against a reading word by word, and the lexicon's expressions against its paradigms."""

import pytest
from pyspark.sql import functions as F

from maskfold.operators import morphology as m
from maskfold.operators import name_forms, names
from maskfold.operators.name_runs import name_candidates
from maskfold.sources import tables
from maskfold.sources.names_corpus import names_corpus

TEXTS = [
    "Банк направил письмо Иванову Ивану Ивановичу.", "Передать И.И. Иванову", "Шевчук Сергей Иванович пришёл", "Ковальчук Анна Петровна; И.П. Гоголь и Шевчук С.И., Гоголь Николай, Марат Сафин.",
    "Сергей Завтра и Завтра Сергей Иванович", "Иванова-Петрова Мария Ивановна и Римского-Корсакова Николая Андреевича", "Иван Петров Сергей Иванов Анна", "Клиент Сергей Иванов",
    "Зульфия Маратовна подписала, Зульфие Маратовне передали", "Иван\nПетров", "ИванПетров", "Иван  Иванович Иван Иванович Петров Павел", "И. П. Иванову, А.Смирнова, Иванову И. П. и Смирновой А.В.", "", None,
    "Петру Ильичу Чайковскому и Льву Толстому", "😀 Иван Иванов 😀 Пётр Петров", "а И. Москва", "no Cyrillic",
]


def rows(c):
    x = c.meta
    return (c.type, c.value, c.start, c.end, c.detector, c.confidence, c.det_order, (x.normalized, x.gram_case, x.gender, x.nominal_form, x.identity_key, x.known_public_figure, x.alias_type, [tuple(p) for p in x.name_parts]))


def test_names_against_a_reading_word_by_word(spark, small):
    corpus = [r.text for frame in (tables.ru_corpus(spark, small), names_corpus(spark, small)) for r in frame.collect()]
    frame = spark.createDataFrame([(t,) for t in dict.fromkeys(TEXTS + corpus)], "t string").select("t", name_candidates(F.col("t")).alias("c"))
    for r in frame.collect():
        assert [rows(c) for c in r.c or []] == names.find_names(r.t), r.t


@pytest.mark.parametrize("text,values", [
    ("Шевчук Сергей Иванович", ["Шевчук Сергей Иванович"]), ("Ковальчук Анна Петровна", ["Ковальчук Анна Петровна"]), ("И.П. Гоголь", ["И.П. Гоголь"]), ("Шевчук С.И.", ["Шевчук С.И."]),
    ("Гоголь Николай", ["Гоголь Николай"]), ("Марат Сафин", ["Марат Сафин"]), ("Завтра Сергей Иванов", ["Сергей Иванов"]), ("Сергей Завтра", []), ("а И. Москва", []),
])
def test_surnames_that_no_list_knows(text, values):
    assert [c[1] for c in names.find_names(text)] == values


def test_readings_and_cases_against_the_paradigms(spark):
    words = {f[0] for f in name_forms.forms()} | {"Магазин", "Половина", "Ан", "Новых", "Их", "Клиент", "Петров-Водкин", "Иванова-Петрова"}
    heads = ("Иванов", "Петрова", "Достоевский", "Чайковская", "Толстой", "Шостакович", "Шевченко", "Черных", "Крамской", "Ильич", "Петровна", "Шевчук")
    words |= {m.inflect(h, c, g) for h in heads for c in m.CASES for g in (m.MASC, m.FEMN)}
    for r in spark.createDataFrame([(w,) for w in sorted(words)], "w string").select("w", name_forms.readings(F.col("w")).alias("r")).collect():
        assert [tuple(x) for x in r.r] == list(dict.fromkeys((x.role, x.gender, x.case, x.nominal) for x in m.readings(r.w))), r.w
    asked = [(w, i, g, m.inflect(w, c, g)) for w in (*heads, "Лев", "Любовь", "Римский-Корсаков") for i, c in enumerate(m.CASES) for g in (m.MASC, m.FEMN, None)]
    for r in spark.createDataFrame(asked, "w string, c int, g string, want string").select("*", name_forms.declined(F.col("w"), F.col("c"), F.col("g")).alias("got")).collect():
        assert r.got == r.want, r


def test_names_run_no_python(spark, small):
    from maskfold.plans.queries import QUERIES

    for name in ("d19_names", "n02_name_forms"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
