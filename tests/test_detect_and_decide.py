import pytest
from pyspark.sql import functions as F

from maskfold.functions import scalars as s
from maskfold.operators import decide, detectors, names
from maskfold.operators import morphology as m


def found(spark, text, only):
    df = spark.createDataFrame([(text,)], "text string")
    row = detectors.detect(df, only=only).select("candidates").first()[0]
    return [(c.type, c.value, c.start, c.end, c.confidence) for c in row]


def judged(spark, text, **options):
    df = spark.createDataFrame([(text,)], "text string")
    row = decide.decided(detectors.detect(df), **options).select("decisions").first()[0]
    return [(d.type, d.value, d.decision, round(d.decision_confidence, 2), list(d.reasons)) for d in row]


def test_detectors_on_one_text(spark):
    assert found(spark, "Почта a.b@ex.com, тел. 8 (900) 123-45-67.", ("email", "phone")) == [("EMAIL", "a.b@ex.com", 6, 16, 0.95), ("PHONE", "8 (900) 123-45-67", 23, 40, 0.95)]
    assert found(spark, "серия 4510 № 123456, паспорт 4510 123457", ("passport",)) == [("PASSPORT", "серия 4510 № 123456", 0, 19, 0.97), ("PASSPORT", "4510 123457", 29, 40, 0.7)]
    assert found(spark, "номер 4510 123457", ("passport",)) == []
    assert found(spark, "0000000000 и 0000000001", ("inn",)) == [("INN", "0000000000", 0, 10, 0.9)]
    assert found(spark, "0000 0000 0000 0000 и 0000-0000-0000-0001", ("card",)) == [("CARD_NUMBER", "0000 0000 0000 0000", 0, 19, 0.95)]
    assert found(spark, "родился 31.02.2000, выдан 29.02.2000", ("date",)) == [("BIRTH_DATE", "29.02.2000", 26, 36, 0.85)]
    assert found(spark, "Место рождения: город Москва; гражданство: Россия", ("birth_place", "citizenship")) == [("BIRTH_PLACE", "город Москва", 16, 28, 0.85), ("CITIZENSHIP", "Россия", 43, 49, 0.85)]


def test_offsets_are_code_points(spark):
    assert found(spark, "😀 a@ex.com", ("email",)) == [("EMAIL", "a@ex.com", 2, 10, 0.95)]


def test_long_digit_run_is_fast(spark):
    assert found(spark, "1" * 200_000, ("email", "card", "inn")) == []


def test_null_and_empty_texts_have_no_candidates(spark):
    df = spark.createDataFrame([(None,), ("",)], "text string")
    assert detectors.detect(df).select(F.size("candidates").alias("n")).agg(F.sum("n")).first()[0] == 0


def test_registry_takes_own_detectors(spark):
    registry = detectors.default_registry()
    registry.register("ticket", lambda t: detectors.candidates(detectors.find_spans(t, r"T-\d+"), "TICKET", "ticket", 0.5))
    df = spark.createDataFrame([("T-17",)], "text string")
    assert detectors.detect(df, only=("ticket",), registry=registry).first().candidates[0].type == "TICKET"


def test_names():
    (full,) = names.find_names("Банк направил письмо Иванову Ивану Ивановичу.")
    assert full[1:6] == ("Иванову Ивану Ивановичу", 21, 44, "fio", 0.85)
    assert full[7][1:4] == ("datv", "masc", "Иванов Иван Иванович")
    (short,) = names.find_names("Передать И.И. Иванову")
    assert short[1] == "И.И. Иванову" and short[7][6] == "SURNAME_INITIALS"
    assert names.find_names("Отделение банка находится по адресу Москва, Тверская, 10.") == []
    assert names.find_names("Александр Сергеевич Пушкин")[0][7][5] is True
    assert names.find_names(None) == []


def test_morphology_round_trips():
    for word in ("Иван", "Дмитрий", "Лев", "Пётр", "Павел", "Игорь", "Никита", "Илья"):
        for case in m.CASES:
            assert m.normalize(m.inflect(word, case, m.MASC), m.MASC, m.NAME) == word
    for word in ("Анна", "Мария", "Ольга", "Наталья", "Любовь"):
        for case in m.CASES:
            assert m.normalize(m.inflect(word, case, m.FEMN), m.FEMN, m.NAME) == word
    assert [m.inflect("Иванова", c, m.FEMN) for c in ("gent", "accs")] == ["Ивановой", "Иванову"]
    assert m.inflect("Неизвестно", "gent", m.MASC) == "Неизвестно"


def test_private_and_public_context(spark):
    assert [d[2] for d in judged(spark, "Александр Сергеевич Пушкин написал роман.")] == ["KEEP"]
    assert [d[2:4] for d in judged(spark, "Клиент Александр Сергеевич Пушкин.")] == [("MASK", 0.8)]
    assert judged(spark, "Пришел Иван Иванов.")[0][2:] == ("MASK", 0.55, ["no_context_fail_safe"])
    assert judged(spark, "Пришел Иван Иванов.", emit_uncertain=True)[0][2] == "UNCERTAIN"


def test_pin_needs_a_card(spark):
    card = "Карта 0000000000000000"
    assert [d[2] for d in judged(spark, f"{card}, пин 1234") if d[0] == "PIN"] == ["MASK"]
    assert [d[2] for d in judged(spark, f"{card}\n\nпин 1234") if d[0] == "PIN"] == ["KEEP"]
    assert [d[4][-1] for d in judged(spark, "пин 1234")] == ["relationship_rule_unmet:CARD_NUMBER"]


def test_policy_null_means_all_and_empty_means_none(spark):
    df = spark.createDataFrame([("a@ex.com", None), ("a@ex.com", []), ("a@ex.com", ["PHONE"])], "text string, types array<string>")
    out = decide.decided(detectors.detect(df, only=("email",)), mask_types=F.col("types"))
    assert [r.decisions[0].decision for r in out.collect()] == ["MASK", "KEEP", "KEEP"]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(s.partial_mask(F.lit("PHONE"), F.lit("+7 (900) 123-45-67"))) == "+7 (***) ***-**-**"
    assert get(s.partial_mask(F.lit("FULL_NAME"), F.lit("И.И. Иванову 7"))) == "И. И. *."
    assert get(s.partial_mask(F.lit("INN"), F.lit("1234"))) == "****"
    assert get(s.partial_mask(F.lit("PASSPORT"), F.lit("123"))) == "123"
    assert get(s.fingerprint(F.lit("x"), "k" * 100)) != get(s.fingerprint(F.lit("x")))
    assert [get(s.token_count(F.lit("a" * n))) for n in (0, 1, 9)] == [0, 1, 2]


@pytest.mark.parametrize("text,value,case,nominal", [
    ("Алиса Ивановна пришла", "Алиса Ивановна", "nomn", "Алиса Ивановна"), ("Вчера Сергей Шевчук звонил", "Сергей Шевчук", "nomn", "Сергей Шевчук"),
    ("Передать Марату Ивановичу", "Марату Ивановичу", "datv", "Марат Иванович"), ("Николай Гоголь", "Николай Гоголь", "nomn", "Николай Гоголь"),
    ("Анна Ковальчук", "Анна Ковальчук", "nomn", "Анна Ковальчук"), ("Иванов Петров", "Иванов Петров", "nomn", "Иванов Петров"),
    ("Клиент Иван Петрович", "Иван Петрович", "nomn", "Иван Петрович"),
])
def test_names_beyond_the_lists(text, value, case, nominal):
    from maskfold.operators.names import find_names

    (found,) = find_names(text)
    assert (found[1], found[7][1], found[7][3]) == (value, case, nominal)


def test_cases_of_words():
    from maskfold.operators import morphology as m

    assert m.detect_case("Ивану") == "datv" and m.detect_case("что-то") == "nomn"
    assert m.inflect_full_name("Иванов Иван Петрович", "datv", "masc") == "Иванову Ивану Петровичу"
