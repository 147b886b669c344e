"""Texts with names in all forms, made from customers' keys: orders of words, cases, genders, initials, and surnames that no list knows.

One SQL expression makes them in Spark and DuckDB alike. The words come from short lists, declined by the paradigms of the lexicon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import CASES
from ..operators import morphology as m
from .tables import spread, table

SURNAMES = {
    m.MASC: ("Кузнецов", "Белинский", "Шевченко", "Лукин", "Чехов", "Черных", "Воробьёв"),
    m.FEMN: ("Кузнецова", "Белинская", "Шевченко", "Лукина", "Зорина", "Черных", "Воробьёва"),
}
GIVEN = {m.MASC: ("Андрей", "Лев", "Илья", "Игорь", "Пётр"), m.FEMN: ("Ольга", "Мария", "Любовь", "Галина", "Юлия")}
PATRONYMICS = {m.MASC: ("Ильич", "Петрович", "Андреевич"), m.FEMN: ("Ильинична", "Петровна", "Андреевна")}
#: Surnames that neither a list nor an ending tells.
UNLISTED = ("Шевчук", "Гоголь", "Ковальчук")
PREFIXES = ("Сегодня ", "Документ подписан: ", "Переведено со счёта на имя ", "")
GENDERS = (m.MASC, m.FEMN)
LAYOUTS = 9

_K = "c_custkey"
_G, _C, _L = f"({_K} % 2)", f"(CAST(floor({_K} / 2) AS BIGINT) % 6)", f"(CAST(floor({_K} / 12) AS BIGINT) % {LAYOUTS})"
#: Layouts with unlisted surnames stand in the nominative.
_CASE = f"CASE WHEN {_L} >= 7 THEN 0 ELSE {_C} END"


def _pick(words: tuple[str, ...], step: int) -> str:
    return f"split_part('{','.join(words)}', ',', CAST(1 + ({_K} * {step} + CAST(floor({_K} / 5) AS BIGINT)) % {len(words)} AS INT))"


def _form(lists: dict[str, tuple[str, ...]], step: int) -> str:
    cells = [(g * 6 + c, tuple(m.inflect(w, case, gender) for w in lists[gender])) for g, gender in enumerate(GENDERS) for c, case in enumerate(CASES)]
    return f"CASE CAST({_G} * 6 + ({_CASE}) AS INT) " + " ".join(f"WHEN {n} THEN {_pick(words, step)}" for n, words in cells) + " END"


#: Expressions over ``customer`` of the words and the layout.
PARTS = {
    "surname": _form(SURNAMES, 7), "first": _form(GIVEN, 11), "patronymic": _form(PATRONYMICS, 13), "unlisted": _pick(UNLISTED, 3),
    "prefix": f"replace({_pick(tuple(p or '-' for p in PREFIXES), 5)}, '-', '')", "layout": f"CAST({_L} AS INT)",
}
#: The mention by its words: S F P in several orders, initials before and after, unlisted surnames first and with initials.
_I = "substr(first, 1, 1) || '.'"
_J = "substr(patronymic, 1, 1) || '.'"
MENTIONS = (
    "surname || ' ' || first || ' ' || patronymic", "first || ' ' || patronymic || ' ' || surname", "first || ' ' || surname", "surname || ' ' || first", "first || ' ' || patronymic",
    f"{_I} || {_J} || ' ' || surname", f"surname || ' ' || {_I} || ' ' || {_J}", "unlisted || ' ' || first || ' ' || patronymic", f"{_I} || ' ' || {_J} || ' ' || unlisted",
)
MENTION = "CASE layout " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(MENTIONS)) + " END"
WORDS_SQL = "SELECT c_custkey AS doc_id, " + ", ".join(f"{e} AS {n}" for n, e in PARTS.items()) + " FROM customer"


def names_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): one name in each text."""
    words = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("doc_id"), *[F.expr(e).alias(n) for n, e in PARTS.items()])
    return words.select("doc_id", F.expr(f"prefix || {MENTION} || ' (копия).'").alias("text"))


def readings_rows() -> list[tuple[str, str, str, int, str, int]]:
    """(word, role's letter, gender, case's number, nominative, place) of all words of the corpus, as the lexicon reads them."""
    words = dict.fromkeys(m.inflect(w, c, g) for lists in (SURNAMES, GIVEN, PATRONYMICS) for g in GENDERS for w in lists[g] for c in CASES)
    letter = {m.PATRONYMIC: "P", m.NAME: "N", m.SURNAME: "S"}
    return [(w, letter[r.role], r.gender, CASES.index(r.case), r.nominal, i) for w in words for i, r in enumerate(m.readings(w))]
