"""Person names as native expressions: words, what they can be, runs of them, and surnames with initials.

The capitalised words of a text are looked up in the lexicon of forms (:mod:`name_forms`). Their roles are then written down as one short string, two
characters a word: what stands before it (a space if only white space, a bar otherwise) and its role (P patronymic, N given name, S surname, u unknown, a dash for
a word that is no name). Runs of names are matches of a pattern in that string, and words that no list knows get a role from those beside them by patterns as well:

* before a patronymic a given name; after a given name or patronymic a surname, if none stands before;
* before a given name a surname, unless one follows: papers put the surname first;
* beside two initials a surname.

Common words that begin sentences or address people are no such names. Case and gender of a run are those that most of its words allow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fixed_values import CASES, DETECTORS, PUBLIC_SURNAMES
from ..functions.scalars import let
from ..functions.spans import find_spans, no_spans
from . import morphology as m
from . import names as nm
from .name_forms import READING, constant, readings

_LETTERS = {m.PATRONYMIC: "P", m.NAME: "N", m.SURNAME: "S"}
_ROLE = {"P": "patronymic", "N": "first", "S": "surname"}
_PART = "struct<kind:string,surface:string,offset_start:int,offset_end:int,role:string,normalized:string,letter:string>"
_WORD = "struct<value:string,start:int,end:int,initials:string,kind:int,read:array<" + READING + ">>"


def _literals(values) -> Column:
    return F.split(F.lit(",".join(values)), ",")


def _label(word: Column, read: Column) -> Column:
    """The letter of a word's role: patronymic before given name before surname; u where nothing is known and a name is possible."""
    has = lambda role: F.exists(read, lambda r: r["role"] == role)
    out = F.when((F.size(read) == 0) & F.array_contains(_literals(sorted(m.COMMON)), F.lower(word)), "-")
    for role in (m.PATRONYMIC, m.NAME, m.SURNAME):
        out = out.when(has(role), _LETTERS[role])
    return out.otherwise("u")


def labelled(signs: Column) -> Column:
    """Unknown words beside known ones get their role."""
    for pattern, letter in nm.UNKNOWN:
        signs = F.regexp_replace(signs, pattern, letter)
    return F.upper(signs)


def _agreed(words: Column, letters: Column, field: str, values: tuple[str, ...], order: str, otherwise: str) -> Column:
    """The value of a field (gender or case) that the words of a run agree on. The first word, in the order of roles, with a reading decides which values are open; of these the
    one that most words allow, then the first in ``values``."""
    open_of = lambda label: F.get(F.filter(F.zip_with(words, letters, lambda w, x: F.when((x == label) if label else F.lit(True), F.filter(w["read"], lambda r: r["role"] == _role_of(x)))), lambda r: F.coalesce(F.size(r) > 0, F.lit(False))), F.lit(0))
    first = F.coalesce(*[open_of(x) for x in order], *([open_of("")] if field == "gender" else []))
    votes = lambda v: F.size(F.filter(F.zip_with(words, letters, lambda w, x: F.exists(w["read"], lambda r: (r["role"] == _role_of(x)) & (r[field] == v))), lambda y: y))

    def best(found: Column) -> Column:
        there = F.filter(_literals(values), lambda v: F.exists(found, lambda r: r[field] == v))
        ranked = F.transform(there, lambda v: F.struct((-votes(v)).alias("votes"), F.array_position(_literals(values), v).alias("at"), v.alias("value")))
        return F.array_min(ranked)["value"]

    return F.coalesce(let(first, lambda x: F.when(x.isNotNull(), best(x))), F.lit(otherwise))


def _role_of(letter: Column) -> Column:
    return F.when(letter == "P", m.PATRONYMIC).when(letter == "N", m.NAME).otherwise(m.SURNAME)


def _undeclined(word: Column, case: Column, gender: Column) -> Column:
    """The nominative of a given name that no list has, by the endings of its gender."""
    rows = constant([dict(zip(("gender", "case", "ending", "head"), r, strict=True)) for r in nm.UNLISTED], "array<struct<gender:string,case:string,ending:string,head:string>>")
    fits = F.filter(rows, lambda x: (x["gender"] == gender) & (x["case"] == case) & F.endswith(word, x["ending"]) & (F.length(word) - F.length(x["ending"]) + F.length(x["head"]) > 2))
    found = F.get(fits, F.lit(0))
    return F.coalesce(F.concat(F.substr(word, F.lit(1), F.length(word) - F.length(found["ending"])), found["head"]), word)


def _nominal(word: Column, letter: Column, case: Column, gender: Column) -> Column:
    read = word["read"]
    pick = lambda fits: F.get(F.filter(read, fits), F.lit(0))["nominal"]
    known = F.coalesce(pick(lambda r: (r["gender"] == gender) & (r["role"] == _role_of(letter))), pick(lambda r: r["gender"] == gender), pick(lambda r: F.lit(True)))
    unknown = F.when((letter == "N") & (case != "nomn"), _undeclined(word["value"], case, gender)).otherwise(word["value"])
    return F.coalesce(known, unknown)


def _roles(letters: Column) -> Column:
    """Roles of a run by its letters; where one repeats, the usual order."""
    plain = F.transform(letters, lambda x: F.when(x == "P", "patronymic").when(x == "N", "first").otherwise("surname"))
    three = F.when(F.get(letters, F.lit(1)) == "P", _literals(("first", "patronymic", "surname"))).otherwise(_literals(("surname", "first", "patronymic")))
    two = F.when(F.array_join(letters, "") == "PP", _literals(("patronymic", "first"))).otherwise(_literals(("first", "surname")))
    return F.when(F.size(F.array_distinct(letters)) == F.size(letters), plain).when(F.size(letters) == 3, three).otherwise(two)


def _candidate(value: Column, start: Column, end: Column, confidence: Column, case: Column, gender: Column, nominal: Column, alias: Column, parts: Column) -> Column:
    public = F.exists(F.split(nominal, " "), lambda w: F.array_contains(_literals(PUBLIC_SURNAMES), F.lower(w)))
    null = F.lit(None).cast("string")
    meta = F.struct(null.alias("normalized"), case.alias("gram_case"), gender.alias("gender"), nominal.alias("nominal_form"), F.concat(F.lit("person:"), F.lower(nominal)).alias("identity_key"), public.alias("known_public_figure"), alias.alias("alias_type"), parts.alias("name_parts"))
    return F.struct(F.lit("FULL_NAME").alias("type"), value.alias("value"), start.alias("start"), end.alias("end"), F.lit("fio").alias("detector"), confidence.alias("confidence"), F.lit(DETECTORS.index("fio")).alias("det_order"), meta.alias("meta"))


def _part(kind: str, surface: Column, at: Column, role: Column, normalized: Column, letter: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), surface.alias("surface"), at.alias("offset_start"), (at + F.length(surface)).alias("offset_end"), role.alias("role"), normalized.alias("normalized"), letter.alias("letter")).cast(_PART)


def _run(text: Column, words: Column, letters: Column) -> Column:
    """The candidate of a run."""
    start, end = F.get(words, F.lit(0))["start"], F.element_at(words, -1)["end"]

    def of(x: Column) -> Column:
        w, ls = x["words"], x["letters"]

        def told(y: Column) -> Column:
            nominal = F.zip_with(w, ls, lambda a, b: _nominal(a, b, y["case"], y["gender"]))
            return let(F.struct(nominal.alias("nominal"), _roles(ls).alias("roles"), y["case"].alias("case"), y["gender"].alias("gender")), built)

        def built(z: Column) -> Column:
            parts = F.transform(w, lambda a, i: _part("word", a["value"], a["start"] - start, F.get(z["roles"], i), F.lower(F.get(z["nominal"], i)), F.lit(None).cast("string")))
            three = F.size(w) == 3
            alias = F.when(three, "FULL").when(F.array_contains(z["roles"], "patronymic"), "NAME_PATRONYMIC").otherwise("NAME_SURNAME")
            return _candidate(F.substr(text, start + 1, end - start), start, end, F.when(three, 0.85).otherwise(0.75), z["case"], z["gender"], F.array_join(z["nominal"], " "), alias, parts)

        gender = _agreed(w, ls, "gender", (m.MASC, m.FEMN), "PN", m.MASC)
        case = _agreed(w, ls, "case", CASES, "PSN", "nomn")
        return let(F.struct(gender.alias("gender"), case.alias("case")), told)

    return let(F.struct(words.alias("words"), letters.alias("letters")), of)


def _runs(text: Column, words: Column) -> Column:
    """Candidates of all runs of two or three name words."""

    def signs(w: Column, i: Column) -> Column:
        before = F.get(words, i - 1)["end"]
        gap = F.substr(text, before + 1, w["start"] - before)
        return F.concat(F.when((i > 0) & gap.rlike(r"(?U)^\s*$"), F.lit(" ")).otherwise("|"), _label(w["value"], w["read"]))

    def found(s: Column) -> Column:
        def one(span: Column) -> Column:
            first, n = (span["start"] - 1) / 2, (F.length(span["value"]) + 1) / 2
            inner = F.slice(words, first.cast("int") + 1, n.cast("int"))
            return _run(text, inner, F.split(span["value"], " "))

        return F.transform(find_spans(s, nm.RUN), one)

    joined = F.array_join(F.transform(words, signs), "")
    return let(labelled(joined), found)


def _with_initials(word: Column, text: Column) -> Column:
    """The candidate of a surname with initials, before or after it (kind 1 or 2), or null: the word must be a surname by all that is known, or unknown beside two initials."""
    read = word["read"]
    reading = F.get(F.filter(read, lambda r: r["role"] == m.SURNAME), F.lit(0))
    known = (F.size(read) > 0) & F.forall(read, lambda r: r["role"] == m.SURNAME)
    letters = F.regexp_extract_all(word["initials"], F.lit("[А-ЯЁ]"), F.lit(0))
    unknown = (F.size(read) == 0) & (F.size(letters) == 2) & ~F.array_contains(_literals(sorted(m.COMMON)), F.lower(word["value"]))
    nominal = F.when(known, reading["nominal"]).otherwise(word["value"])
    length = F.length(word["value"])
    # offsets within the mention: initials as written, and the word before or after them
    ahead = word["kind"] == 1
    offset = F.when(ahead, F.length(word["initials"])).otherwise(F.lit(0))
    begin = F.when(ahead, word["start"] - offset).otherwise(word["start"])
    shift = F.when(ahead, 0).otherwise(length + 1)
    second = F.length(F.regexp_extract(word["initials"], r"^[А-ЯЁ]\.\s?", 0))
    null = F.lit(None).cast("string")
    marks = F.transform(letters, lambda x, i: _part("initial", F.concat(x, F.lit(".")), (shift + F.when(i == 0, 0).otherwise(second)).cast("int"), F.when(i == 0, "first").otherwise("patronymic"), null, x))
    own = F.array(_part("word", word["value"], offset.cast("int"), F.lit("surname"), F.lower(nominal), null))
    parts = F.when(ahead, F.concat(marks, own)).otherwise(F.concat(own, marks))
    size = F.when(ahead, offset + length).otherwise(length + 1 + F.length(F.rtrim(word["initials"])))
    gender, case = F.when(known, reading["gender"]).otherwise(m.MASC), F.when(known, reading["case"]).otherwise("nomn")
    made = _candidate(F.substr(text, begin + 1, size), begin.cast("int"), (begin + size).cast("int"), F.lit(0.7), case, gender, nominal, F.lit("SURNAME_INITIALS"), parts)
    return F.when(known | unknown, made)


def neighboured(text: Column) -> Column:
    """The capitalised words with nothing but white space before or behind them and another one there. All others can be in no run and give none of their neighbours a role, so that they need not be looked up."""

    def joined(a: Column, b: Column) -> Column:
        return F.coalesce(F.substr(text, a["end"] + 1, b["start"] - a["end"]).rlike(r"(?U)^\s*$"), F.lit(False))

    return let(find_spans(text, nm.NAME_WORD), lambda s: F.filter(s, lambda x, i: joined(F.get(s, i - 1), x) | joined(x, F.get(s, i + 1))))


def name_candidates(text: Column) -> Column:
    """The names of a text, as candidates. No Python runs."""
    from .detectors import CANDIDATE

    def word(s: Column) -> Column:
        kind = s["kind"]
        name = F.when(kind == 1, F.regexp_extract(s["value"], f"{nm.NAME_WORD}$", 0)).when(kind == 2, F.regexp_extract(s["value"], f"^{nm.NAME_WORD}", 0)).otherwise(s["value"])

        def built(n: Column) -> Column:
            before = F.substr(s["value"], F.lit(1), F.length(s["value"]) - F.length(n))
            initials = F.when(kind == 1, before).when(kind == 2, F.substr(s["value"], F.length(n) + 2, F.length(s["value"]))).otherwise("")
            start = F.when(kind == 1, s["start"] + F.length(before)).otherwise(s["start"])
            return F.struct(n.alias("value"), start.cast("int").alias("start"), (start + F.length(n)).cast("int").alias("end"), initials.alias("initials"), kind.alias("kind"), readings(n).alias("read")).cast(_WORD)

        return let(name, built)

    def spans(found: Column, kind: int) -> Column:
        return F.transform(found, lambda s: F.struct(s["value"].alias("value"), s["start"].alias("start"), F.lit(kind).alias("kind")))

    dotted = F.contains(text, F.lit("."))
    short = lambda pattern: F.when(dotted, find_spans(text, pattern)).otherwise(no_spans())
    found = F.transform(F.concat(spans(neighboured(text), 0), spans(short(nm.INITIALS_BEFORE), 1), spans(short(nm.INITIALS_AFTER), 2)), word)

    def all_of(words: Column) -> Column:
        runs = let(F.filter(words, lambda w: w["kind"] == 0), lambda w: _runs(text, w))
        short = F.filter(F.transform(F.filter(words, lambda w: w["kind"] > 0), lambda w: _with_initials(w, text)), lambda c: c.isNotNull())
        return F.concat(runs.cast(f"array<{CANDIDATE}>"), short.cast(f"array<{CANDIDATE}>"))

    none = F.array().cast(f"array<{CANDIDATE}>")
    return F.when(text.rlike(nm.POSSIBLE), F.coalesce(let(found, all_of), none)).otherwise(none)
