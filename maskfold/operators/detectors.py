"""Detectors: text to candidate spans.

A detector is a function from a text column to an array of candidates. All are built of native expressions. Detectors are
kept in a registry in a fixed order, which breaks ties later; own detectors can be registered.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import built, digits, inn_valid, let, luhn_valid, normalize_ru_phone, pinned
from ..functions.spans import apart_from, find_spans, has_any, near, around

META = (
    "struct<normalized:string,gram_case:string,gender:string,nominal_form:string,identity_key:string,known_public_figure:boolean,alias_type:string,"
    "name_parts:array<struct<kind:string,surface:string,offset_start:int,offset_end:int,role:string,normalized:string,letter:string>>>"
)
CANDIDATE = f"struct<type:string,value:string,start:int,end:int,detector:string,confidence:double,det_order:int,meta:{META}>"

_CITY = "[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?"
_TOWN = _CITY + r"(?:\s[А-ЯЁ][а-яё]+)?"
_STREET = r"[А-ЯЁ][а-яёА-ЯЁ\-]+(?:\s[а-яёА-ЯЁ\-]+)?"
# What each type looks like (Java syntax; \d, \s and \w cover all of Unicode).
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "phone_ru": r"(?U)(?<!\d)(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(?!\d)",
    "phone": r"(?U)(?<!\d)\+\d{1,3}(?:[\s\-]?\d{2,4}){2,5}(?!\d)",
    "inn": r"(?U)(?<!\d)(?:\d{10}|\d{12})(?!\d)",
    # a group of 13 digits or more is a number of its own and never joined with its neighbours; shorter groups are
    "card": r"(?U)(?<!\d)(?:\d{13,19}|(?!\d{13})\d(?:\d|[ -](?!\d{13})\d){12,18})(?!\d)",
    "passport_series": r"(?iuU)серия\s*\d{4}\s*(?:№|номер)?\s*\d{6}",
    "passport_sign": r"(?U)(?<!\d)\d{4}\s*№\s*\d{6}(?!\d)",
    "two_two_six": r"(?U)(?<!\d)\d{2}[ ]\d{2}[ ]\d{6}(?!\d)",
    "four_six": r"(?U)(?<!\d)\d{4}[ ]\d{6}(?!\d)",
    "ten": r"(?U)(?<!\d)\d{10}(?!\d)",
    "department": r"(?U)(?<!\d)\d{3}-\d{3}(?!\d)",
    "code": r"(?U)(?<!\d)\d{3,4}(?!\d)",
    "date": r"(?U)(?<!\d)\d{1,2}([./\-])\d{1,2}\1\d{4}(?!\d)",
    "date_iso": r"(?U)(?<!\d)\d{4}-\d{1,2}-\d{1,2}(?!\d)",
    "date_text": r"(?iuU)(?<!\d)\d{1,2}\s+(?:" + "|".join(fv.MONTHS) + r")\s+\d{4}(?!\d)",
    "cardholder": r"(?U)(?iu:держател[а-яё]*)[:\s]+([А-ЯЁ]{2,}(?:\s+[А-ЯЁ]{2,}){1,2})",
    "address_index": rf"(?U)\d{{6}},\s*г\.\s*{_TOWN},\s*ул\.\s*{_STREET},\s*д\.\s*\d+,\s*кв\.\s*\d+",
    "address_words": rf"(?U)г\.\s*{_TOWN},\s*ул\.\s*{_STREET},\s*дом\s*\d+,\s*квартира\s*\d+",
    "address_short": rf"(?U)(?<![,\wА-Яа-я]){_TOWN},\s*{_STREET},\s*\d+-\d+(?!\d)",
    "birth_place": rf"(?U)(?iu:место\s+рождения)[^:;.]*[:\-—]\s*((?:г\.\s*|город\s+)?{_CITY}(?:,\s*Росси[ия][^,.;]*)?)",
    "citizenship": r"(?U)(?iu:гражданств[оа])\s*[:\-—]?\s*([А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+)?)",
    "issuer": rf"(?U)(?:ГУ МВД России|УМВД России|Отделом? МВД России)\s+по\s+г\.\s*{_CITY}",
}


def candidates(spans: Column, kind: str | Callable[[Column], Column], detector: str, confidence: float, normalized: Callable[[Column], Column] | None = None) -> Column:
    """Spans as candidates of a type; where ``kind`` is a function, a span without a type goes."""
    order = fv.DETECTORS.index(detector) if detector in fv.DETECTORS else len(fv.DETECTORS)
    empty = F.lit(None).cast(META)

    def build(s: Column) -> Column:
        meta = empty
        if normalized is not None:
            null = F.lit(None)
            meta = F.struct(normalized(s["value"]), *[null] * 7).cast(META)
        type_ = F.lit(kind) if isinstance(kind, str) else kind(s)
        return F.struct(type_.alias("type"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end"), F.lit(detector).alias("detector"), F.lit(confidence).alias("confidence"), F.lit(order).alias("det_order"), meta.alias("meta")).cast(CANDIDATE)

    out = F.transform(spans, build)
    return out if isinstance(kind, str) else F.filter(out, lambda c: c["type"].isNotNull())


def _none() -> Column:
    return F.array().cast(f"array<{CANDIDATE}>")


def email(text: Column) -> Column:
    return candidates(find_spans(text, PATTERNS["email"], F.contains(text, F.lit("@"))), "EMAIL", "email", 0.95)


def phone(text: Column) -> Column:
    local = find_spans(text, PATTERNS["phone_ru"])
    abroad = find_spans(text, PATTERNS["phone"], F.contains(text, F.lit("+")))
    enough = lambda s: F.length(digits(s["value"])).between(8, 15)
    return let(local, lambda own: F.concat(candidates(own, "PHONE", "phone", 0.95, normalize_ru_phone), candidates(apart_from(F.filter(abroad, enough), own), "PHONE", "phone", 0.75)))


def inn(text: Column) -> Column:
    return candidates(F.filter(find_spans(text, PATTERNS["inn"]), lambda s: inn_valid(s["value"])), "INN", "inn", 0.9)


def card(text: Column) -> Column:
    found = F.filter(find_spans(text, PATTERNS["card"]), lambda s: luhn_valid(s["value"]))
    return candidates(found, "CARD_NUMBER", "card", 0.95, digits)


def _cascade(text: Column, kind: str, detector: str, steps: list[tuple[Column, float]]) -> Column:
    """Candidates of several patterns, where a later match must not overlap what an earlier pattern gave."""


    def with_more(spans: Column, confidence: float) -> Callable[[Column], Column]:
        return lambda got: F.concat(got, candidates(apart_from(spans, got), kind, detector, confidence))

    out = _none()
    for spans, confidence in steps:
        out = let(out, with_more(spans, confidence))
    return out


def passport(text: Column) -> Column:
    close = near(text, fv.PASSPORT_NEAR, 40)
    named = F.contains(F.lower(text), F.lit(fv.PASSPORT_NEAR[0]))
    found = _cascade(text, "PASSPORT", "passport", [
        (find_spans(text, PATTERNS["passport_series"]), 0.97),
        (find_spans(text, PATTERNS["passport_sign"], F.contains(text, F.lit("№"))), 0.95),
        (F.filter(find_spans(text, PATTERNS["two_two_six"], named), close), 0.75),
        (F.filter(find_spans(text, PATTERNS["four_six"], named), close), 0.7),
    ])
    return F.when(text.rlike(r"(?U)\d{6}"), found).otherwise(_none())


def department_code(text: Column) -> Column:
    guard = F.contains(F.lower(text), F.lit(fv.DEPARTMENT_NEAR[0]))
    return candidates(F.filter(find_spans(text, PATTERNS["department"], guard), near(text, fv.DEPARTMENT_NEAR, 40)), "DEPARTMENT_CODE", "department_code", 0.92)


def _code(text: Column, kind: str, detector: str, n: int, words: tuple[str, ...], confidence: float) -> Column:
    fits = lambda s: (F.length(s["value"]) == n) & near(text, words, 25)(s)
    return candidates(F.filter(find_spans(text, PATTERNS["code"], has_any(F.lower(text), words)), fits), kind, detector, confidence)


def cvv(text: Column) -> Column:
    return _code(text, "CVV", "cvv", 3, fv.CVV_NEAR, 0.9)


def pin(text: Column) -> Column:
    return _code(text, "PIN", "pin", 4, fv.PIN_NEAR, 0.85)


def driver_license(text: Column) -> Column:
    close, guard = near(text, fv.LICENSE_NEAR, 40), has_any(F.lower(text), fv.LICENSE_NEAR)
    return _cascade(text, "DRIVER_LICENSE", "driver_license", [(F.filter(find_spans(text, PATTERNS[p], guard), close), c) for p, c in (("two_two_six", 0.8), ("four_six", 0.78), ("ten", 0.72))])


def _real_date(value: Column) -> Column:
    """Whether the day is in the calendar (years 1 to 9999), for each of the three forms."""

    def months(lowered: Column) -> Column:
        month = F.lit(None).cast("int")
        for i, m in enumerate(fv.MONTHS, 1):
            month = F.when(F.contains(lowered, F.lit(m)), i).otherwise(month)
        return month

    def real(x: Column) -> Column:
        # the longest run of digits is the year
        number = lambda i: F.element_at(x["numbers"], i).cast("int")
        year = F.when(x["iso"], number(1)).otherwise(number(-1))
        day = F.when(x["iso"], number(-1)).otherwise(number(1))
        mon = F.coalesce(x["month"], number(2))
        return let(F.struct(year.alias("year"), mon.alias("month"), day.alias("day")), in_calendar)

    def in_calendar(x: Column) -> Column:
        # counted, as a parser throws at each day that there is not
        y, mon = x["year"], x["month"]
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        last = F.when(mon == 2, F.when(leap, 29).otherwise(28)).when(mon.isin(4, 6, 9, 11), 30).otherwise(31)
        return (y > 0) & mon.between(1, 12) & (x["day"] >= 1) & (x["day"] <= last)

    parts = F.struct(let(F.lower(value), months).alias("month"), value.rlike(r"(?U)^\d{4}-").alias("iso"), F.regexp_extract_all(value, F.lit(r"(?U)\d+"), F.lit(0)).alias("numbers"))
    return let(parts, real)


def date(text: Column) -> Column:
    def role(s: Column) -> Column:
        return let(F.lower(around(text, s["start"], s["end"], 30)), lambda local: F.when(has_any(local, fv.BIRTH_NEAR), "BIRTH_DATE").when(has_any(local, fv.ISSUE_NEAR), "PASSPORT_ISSUE_DATE"))

    guard = has_any(F.lower(text), (*fv.BIRTH_NEAR, *fv.ISSUE_NEAR))
    found = F.concat(*[find_spans(text, PATTERNS[p]) for p in ("date", "date_iso", "date_text")])
    return F.when(guard, candidates(F.filter(found, lambda s: _real_date(s["value"])), role, "date", 0.85)).otherwise(_none())


def cardholder(text: Column) -> Column:
    return candidates(find_spans(text, PATTERNS["cardholder"], group=1), "CARDHOLDER", "cardholder", 0.9)


def address(text: Column) -> Column:
    found = _cascade(text, "ADDRESS", "address", [(find_spans(text, PATTERNS[f"address_{p}"]), c) for p, c in (("index", 0.95), ("words", 0.93), ("short", 0.7))])
    return F.when(text.rlike(r"(?U)[А-ЯЁ][^\n]*,[^\n]*\d"), found).otherwise(_none())


def birth_place(text: Column) -> Column:
    return candidates(find_spans(text, PATTERNS["birth_place"], group=1), "BIRTH_PLACE", "birth_place", 0.85)


def citizenship(text: Column) -> Column:
    return candidates(find_spans(text, PATTERNS["citizenship"], group=1), "CITIZENSHIP", "citizenship", 0.85)


def passport_issuer(text: Column) -> Column:
    return candidates(find_spans(text, PATTERNS["issuer"], F.contains(text, F.lit("МВД"))), "PASSPORT_ISSUER", "passport_issuer", 0.9)


def fio(text: Column) -> Column:
    from .name_runs import name_candidates

    return name_candidates(text)


def python_detector(find: Callable[[str], list[tuple[int, int]]], kind: str, name: str, confidence: float = 0.9) -> Callable[[Column], Column]:
    """A detector from a Python function that gives the (start, end) of what it finds in a text, for :meth:`Registry.register`. It runs as an Arrow function; where it fails on a text, that
    text has no candidates of it and the failure is logged, and the other detectors go on."""

    def safe(text: str | None) -> list[tuple[str, int, int]]:
        if text is None:
            return []
        try:
            return [(text[a:b], a, b) for a, b in find(text)]
        except Exception:
            logging.getLogger(__name__).exception("detector %s failed", name)
            return []

    found = F.udf(safe, "array<struct<value:string,start:int,end:int>>", useArrow=True).asNondeterministic()
    return lambda text: candidates(found(text), kind, name, confidence)


class Registry:
    """Detectors by name, in order."""

    def __init__(self, detectors: dict[str, Callable[[Column], Column]]):
        self._all = dict(detectors)

    def register(self, name: str, detector: Callable[[Column], Column]) -> None:
        self._all[name] = detector

    def names(self) -> list[str]:
        return list(self._all)

    def detect_all(self, text: Column, only: tuple[str, ...] | None = None) -> Column:
        return F.concat(*[f(text) for name, f in self._all.items() if only is None or name in only])


STRUCTURED = ("email", "phone", "inn", "card", "passport", "department_code", "cvv", "pin", "driver_license", "date", "cardholder", "address", "birth_place", "citizenship", "passport_issuer")


def default_registry() -> Registry:
    return Registry({name: globals()[name] for name in fv.DETECTORS})


def detect(docs: DataFrame, text: str = "text", only: tuple[str, ...] | None = None, registry: Registry | None = None) -> DataFrame:
    """``docs`` with column ``candidates``: an array in the order of the detectors. A null text has none."""
    own = lambda: (registry or default_registry()).detect_all(F.col(text), only)
    found = own() if registry is not None else built(own, "detect", text, only)
    return docs.withColumn("candidates", pinned(F.coalesce(found, _none())))
