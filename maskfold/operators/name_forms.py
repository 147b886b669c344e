"""The lexicon of name forms as rows, and what a word can be by it, as native expressions.

Listed names stand with all their forms (``forms``). Patronymics and surnames are open: each ending of their paradigms is a row (``endings``)
that leads from an inflected ending to the nominative one. Both come from the paradigms of :mod:`morphology` and are of a fixed size (some 1,000 and 200
rows), so they go into the plan as constants: maps by the first letters of a form, and by the ending. A document stays one row, and no
join, shuffle or Python is needed to look its words up.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fixed_values import CASES
from ..functions.scalars import let
from . import morphology as m

READING = "struct<role:string,gender:string,case:string,nominal:string>"
#: Heads of the open paradigms: role, gender, kind of paradigm, least length of the nominative.
_HEADS = (
    *((m.PATRONYMIC, m.MASC, "patronymic", h, 0) for h in ("ович", "евич", "ьич", "мич", "кич")),
    *((m.PATRONYMIC, m.FEMN, "patronymic", h, 0) for h in ("овна", "евна", "ична")),
    *((m.SURNAME, m.MASC, "possessive_surname", h, 4) for h in ("ов", "ев", "ёв", "ин", "ын")),
    *((m.SURNAME, m.FEMN, "possessive_surname", h, 4) for h in ("ова", "ева", "ёва", "ина", "ына")),
    *((m.SURNAME, m.MASC, "adjective_surname", h, 4) for h in ("ский", "цкий", "ской", "цкой")),
    *((m.SURNAME, m.FEMN, "adjective_surname", h, 4) for h in ("ская", "цкая")),
    *((m.SURNAME, g, "fixed", h, 6) for h in ("енко", "ых", "их") for g in (m.MASC, m.FEMN)),
)


def _order(reading: tuple) -> tuple:
    role, gender, case, nominal = reading
    return (m.PATRONYMIC, m.NAME, m.SURNAME).index(role), CASES.index(case), gender == m.FEMN, nominal


@lru_cache(maxsize=1)
def forms() -> tuple[tuple[str, str, str, str, str], ...]:
    """(form, role, gender, case, nominative) of listed given names and of surnames with a paradigm of their own."""
    out = [(form, m.NAME, *r) for form, found in m._given().items() for r in found]
    for word in m.own_surnames():
        for gender in (m.MASC, m.FEMN):
            if kind := m.surname_kind(word, gender):
                out += [(form, m.SURNAME, gender, case, word) for case, form in zip(CASES, m._decline(word, gender, kind), strict=True)]
    return tuple(dict.fromkeys(out))


@lru_cache(maxsize=1)
def endings() -> tuple[tuple[str, str, str, str, str, int], ...]:
    """(ending, nominative ending, role, gender, case, least length of the nominative)."""
    stem = "Х"
    return tuple((form[1:], head, role, gender, case, least) for role, gender, kind, head, least in _HEADS for case, form in zip(CASES, m._decline(stem + head, gender, kind), strict=True))


def constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def _grouped(rows, key) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(key(r), []).append(r)
    return out


def _listed(word: Column) -> Column:
    table = {k: [{"form": f, "role": r, "gender": g, "case": c, "nominal": n} for f, r, g, c, n in v] for k, v in _grouped(forms(), lambda r: r[0][:2]).items()}
    rows = F.try_element_at(constant(table, "map<string,array<struct<form:string,role:string,gender:string,case:string,nominal:string>>>"), F.substring(word, 1, 2))
    fits = F.filter(rows, lambda x: x["form"] == word)
    return F.coalesce(F.transform(fits, lambda x: F.struct(x["role"], x["gender"], x["case"], x["nominal"])), F.array()).cast(f"array<{READING}>")


def _by_ending(word: Column) -> Column:
    # by the last letter and then by the ending, as a map is searched from its first key on
    entry = "array<struct<head:string,role:string,gender:string,case:string,least:int>>"
    rows = lambda found: [{"head": h, "role": r, "gender": g, "case": c, "least": n} for _, h, r, g, c, n in found]
    table = {letter: {k: rows(v) for k, v in _grouped(found, lambda r: r[0]).items()} for letter, found in _grouped(endings(), lambda r: r[0][-1:]).items()}
    sizes = sorted({len(e[0]) for e in endings()})
    none = F.array().cast(entry)
    refused = F.split(F.lit(",".join(sorted({w.lower() for w in m._NOT_SURNAMES}))), ",")
    own = F.split(F.lit(",".join(m.own_surnames())), ",")

    def found(x: Column) -> Column:
        def of(n: Column) -> Column:
            stem = lambda w: F.substr(w, F.lit(1), F.length(word) - n)
            rows = F.coalesce(F.when(F.length(word) > n, F.try_element_at(x["known"], F.substr(word, F.length(word) - n + 1, n))), none)
            return F.transform(rows, lambda y: F.struct(y["role"].alias("role"), y["gender"].alias("gender"), y["case"].alias("case"), F.concat(stem(word), y["head"]).alias("nominal"), F.concat(stem(x["lowered"]), y["head"]).alias("low"), y["least"].alias("least")))

        surname = lambda y: y["role"] == m.SURNAME
        fits = lambda y: ~F.array_contains(own, y["nominal"]) & (~surname(y) | (F.length(y["nominal"]) >= y["least"]) & ~F.array_contains(refused, y["low"]) & ~F.array_contains(refused, x["lowered"]))
        return F.transform(F.filter(F.flatten(F.transform(F.array(*[F.lit(n) for n in sizes]), of)), fits), lambda y: F.struct(y["role"], y["gender"], y["case"], y["nominal"])).cast(f"array<{READING}>")

    by_letter = F.try_element_at(constant(table, f"map<string,map<string,{entry}>>"), F.substr(word, F.length(word), F.lit(1)))
    return let(F.struct(by_letter.alias("known"), F.lower(word).alias("lowered")), found)


def _index(value: Column, values: tuple[str, ...]) -> Column:
    return F.array_position(F.split(F.lit(",".join(values)), ","), value)


def _plain(word: Column) -> Column:
    roles = (m.PATRONYMIC, m.NAME, m.SURNAME)
    ranked = F.transform(F.concat(_listed(word), _by_ending(word)), lambda r: F.struct(_index(r["role"], roles).alias("a"), _index(r["case"], CASES).alias("b"), (r["gender"] == m.FEMN).alias("c"), r["nominal"].alias("d"), r.alias("r")))
    return F.transform(F.array_sort(F.array_distinct(ranked)), lambda x: x["r"])


def readings(word: Column) -> Column:
    """What a capitalised word can be: an array of readings in order of role (patronymic, given name, surname), case and gender. The parts of a hyphenated
    word are read together, as a surname."""
    parts = F.split(word, "-")
    last = lambda r: F.get(r, F.lit(1))

    def joined(r: Column) -> Column:
        same = lambda x: F.get(F.filter(last(r), lambda y: (y["role"] == m.SURNAME) & (y["gender"] == x["gender"]) & (y["case"] == x["case"])), F.lit(0))["nominal"]
        both = F.transform(F.filter(F.get(r, F.lit(0)), lambda x: x["role"] == m.SURNAME), lambda x: F.struct(x["role"].alias("role"), x["gender"].alias("gender"), x["case"].alias("case"), F.concat(x["nominal"], F.lit("-"), same(x)).alias("nominal")))
        return F.when(F.size(r) == 2, F.filter(both, lambda x: x["nominal"].isNotNull())).otherwise(F.get(r, F.lit(0))).cast(f"array<{READING}>")

    return let(F.transform(parts, _plain), joined)


# --- the other way: a nominative in another case ---

_PARADIGM = "role:string,gender:string,forms:array<string>"


def _paradigms() -> tuple[dict[str, list[dict]], dict[str, list[dict]]]:
    """The six forms of listed nominatives, and the six endings of open paradigms by the nominative's ending."""
    listed = [(n, r, g) for n, r, g in dict.fromkeys((n, r, g) for _, r, g, _, n in forms())]
    by_name = _grouped([(n, r, g, [f for c in CASES for f, fr, fg, fc, fn in forms() if (fr, fg, fc, fn) == (r, g, c, n)][:6]) for n, r, g in listed], lambda x: x[0])
    heads = [(head, role, gender, least, [form[1:] for form in m._decline("Х" + head, gender, kind)]) for role, gender, kind, head, least in _HEADS]
    return (
        {n: [{"role": r, "gender": g, "forms": f} for _, r, g, f in rows] for n, rows in by_name.items()},
        {h: [{"role": r, "gender": g, "least": n, "forms": f} for _, r, g, n, f in rows] for h, rows in _grouped(heads, lambda x: x[0]).items()},
    )


def declined(word: Column, case: Column, gender: Column) -> Column:
    """A nominative name in a case (its number, 0 for the nominative): a listed given name, a patronymic, a surname of the gender. Unknown words stay as they are;
    the parts of a hyphenated word are declined one by one."""
    by_name, by_ending = _paradigms()
    names = constant(by_name, f"map<string,array<struct<{_PARADIGM}>>>")
    ends = constant(by_ending, "map<string,array<struct<role:string,gender:string,least:int,forms:array<string>>>>")
    refused = F.split(F.lit(",".join(sorted({w.lower() for w in m._NOT_SURNAMES}))), ",")
    sizes = sorted({len(h) for h in by_ending})
    none = F.array().cast("array<struct<role:string,gender:string,least:int,forms:array<string>>>")

    def one(w: Column) -> Column:
        def of(n: Column) -> Column:
            rows = F.coalesce(F.when(F.length(w) > n, F.try_element_at(ends, F.substr(w, F.length(w) - n + 1, n))), none)
            return F.transform(rows, lambda x: F.struct(x["role"].alias("role"), x["gender"].alias("gender"), x["least"].alias("least"), F.concat(F.substr(w, F.lit(1), F.length(w) - n), F.get(x["forms"], case)).alias("form")))

        def pick(k: Column) -> Column:
            first = lambda rows, fits: F.get(F.filter(rows, fits), F.lit(0))
            given, fitting = lambda x: x["role"] == m.NAME, lambda x: gender.isNull() | (x["gender"] == gender)
            surname = lambda x: (x["role"] == m.SURNAME) & fitting(x)
            open_ = first(k["open"], lambda x: surname(x) & (F.length(w) >= x["least"]) & ~F.array_contains(refused, F.lower(w)))["form"]
            return F.coalesce(
                F.get(first(k["listed"], lambda x: given(x) & (x["gender"] == gender))["forms"], case), F.get(first(k["listed"], given)["forms"], case), F.get(first(k["listed"], surname)["forms"], case),
                F.when(F.coalesce(F.size(k["listed"]), F.lit(0)) == 0, first(k["open"], lambda x: x["role"] == m.PATRONYMIC)["form"]), F.when(F.coalesce(F.size(k["listed"]), F.lit(0)) == 0, open_), w,
            )

        return let(F.struct(F.coalesce(F.try_element_at(names, w), F.array().cast(f"array<struct<{_PARADIGM}>>")).alias("listed"), F.flatten(F.transform(F.array(*[F.lit(n) for n in sizes]), of)).alias("open")), pick)

    return F.when(case == 0, word).otherwise(F.array_join(F.transform(F.split(word, "-"), one), "-"))
