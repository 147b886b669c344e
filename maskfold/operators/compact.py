"""The compact profile: the same types by plainer rules. No confidences: of overlapping candidates the first and longest stays, and contexts
decide without scores. Radii count bytes of UTF-8, so that they reach half as far in Cyrillic text; matches are fenced by their neighbours.

Types: taxpayer numbers and codes by keywords nearby, dates without a calendar, longer lists for addresses, issuers and citizenships.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import built, inn_valid, let, luhn_valid, mask_alnum, mask_digits, mask_name, pinned
from ..functions.spans import find_spans, has_any
from .decide import hits, sentence_bounds

_NAME_WORD = "[А-ЯЁ][а-яё]+"
_TOWN = "[А-ЯЁ][а-яё]+(?:-[А-ЯЁа-яё][а-яё]+)?"
# What each type looks like, and the keywords that must be near, with their radius in bytes.
PATTERNS = {
    "inn": r"\d{12}|\d{10}",
    "card": r"\d(?:[ \-]?\d){12,18}",
    "code": r"\d{3,4}",
    "date": r"\d{1,2}[./\-]\d{1,2}[./\-]\d{4}",
    "date_iso": r"\d{4}-\d{1,2}-\d{1,2}",
    "date_text": r"(?i)\d{1,2}\s+(?:" + "|".join(fv.MONTHS) + r")\s+\d{4}(?:\s+года)?",
    "address_index": rf"\d{{6}},?\s*(?:г\.|город)\s*{_TOWN},?\s*(?:ул\.|улица|пр-т|проспект|пер\.|переулок)\s*[А-ЯЁ][а-яё\-]+(?:\s[А-ЯЁа-яё\-]+)?,?\s*(?:д\.|дом)\s*\d+[а-яА-Я]?(?:,?\s*(?:кв\.|квартира|корп\.|корпус|стр\.)\s*\d+)*",
    "address_words": rf"(?:г\.|город)\s*{_TOWN},?\s*(?:ул\.|улица|пр-т|проспект)\s*[А-ЯЁ][а-яё\-]+(?:\s[А-ЯЁа-яё\-]+)?,?\s*(?:д\.|дом)\s*\d+[а-яА-Я]?(?:,?\s*(?:кв\.|квартира)\s*\d+)?",
    "address_compact": rf"{_TOWN},\s*{_TOWN}(?:\s[а-яё]+)?,\s*\d+(?:-\d+)?",
    "issuer": r"(?:ГУ\s+МВД|УМВД|ОУФМС|УФМС|Отделом?\s+(?:УФМС|МВД|ОВД))\s+[Рр]оссии\s+по\s+[^,;\n]+",
    "cardholder": r"[A-Z]{2,20}\s[A-Z]{2,20}(?:\s[A-Z]{2,20})?|[А-ЯЁ]{2,20}\s[А-ЯЁ]{2,20}(?:\s[А-ЯЁ]{2,20})?",
}
NEAR = {
    "INN": (60, ("инн", "налогоплательщик")), "CVV": (40, ("cvv", "cvc", "cvv2")), "PIN": (40, ("пин", "pin")), "BIRTH_DATE": (90, ("рожден", "родил", "дата рождения", "д.р.")),
    "PASSPORT_ISSUE_DATE": (90, ("выдан", "дата выдачи")), "ADDRESS": (60, ("адрес",)), "CITIZENSHIP": (60, ("гражданств",)), "CARDHOLDER": (80, ("карт", "держатель", "card")),
}
CITIZENSHIPS = (
    "Российская Федерация", "Россия", "Беларусь", "Казахстан", "Армения", "Кыргызстан", "Узбекистан", "Таджикистан", "Азербайджан", "Молдова", "Туркменистан", "Грузия", "РФ",
)
PERSONAL_ADDRESS = (
    "проживает", "проживал", "проживала", "зарегистрирован", "зарегистрирована", "адрес клиента", "адрес проживания", "адрес регистрации", "домашний адрес",
    "место жительства", "прописан", "прописана", "должник", "ответчик",
)
ORGANIZATION_ADDRESS = (*fv.ORGANIZATION_ADDRESS, "пункт выдачи")
PIN_EXTENT = 300
SPAN = "struct<type:string,value:string,start:int,end:int>"


def near_bytes(text: Column, s: Column, kind: str, raw: Column | None = None) -> Column:
    """Whether a keyword of the type stands within its radius of a span, in bytes and in any case. ``raw``: the bytes of the lower-case text, where they are known."""
    radius, words = NEAR[kind]
    raw = F.encode(F.lower(text), "utf-8") if raw is None else raw
    start, end = F.octet_length(F.substr(text, F.lit(1), s["start"])), F.octet_length(F.substr(text, F.lit(1), s["end"]))

    def any_of(window: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(window, F.encode(F.lit(w), "utf-8"))
        return out

    window = lambda b: F.substr(raw, b["low"] + 1, b["high"] - b["low"])
    bounds = F.struct(F.greatest(start - radius, F.lit(0)).alias("low"), (end + radius).alias("high"))
    return let(let(bounds, window), any_of)


def has_keyword(lowered: Column, *kinds: str) -> Column:
    """Whether a lower-case text has a keyword of one of the types at all: without one, none is near any span and no pattern need be searched."""
    return has_any(lowered, tuple(dict.fromkeys(w for kind in kinds for w in NEAR[kind][1])))


def fenced(text: Column, s: Column) -> Column:
    """No digit touches the span."""
    digit = lambda at: F.substr(text, at, F.lit(1)).rlike("^[0-9]$")
    return ~((s["start"] > 0) & digit(s["start"])) & ~digit(s["end"] + 1)


def _typed(spans: Column, kind: Column | str | object, keep=None) -> Column:
    of = kind if callable(kind) and not isinstance(kind, Column) else (lambda s: F.lit(kind))
    chosen = spans if keep is None else F.filter(spans, keep)
    out = F.transform(chosen, lambda s: F.struct(of(s).alias("type"), s["value"].alias("value"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    return F.filter(out, lambda s: s["type"].isNotNull()).cast(f"array<{SPAN}>")


# The profile's own name words. Given names in the nominative, forms that no ending leads back, endings of patronymics and surnames, and words that are no names.
GIVEN = {
    "masc": "иван александр дмитрий алексей сергей михаил николай андрей павел максим антон юрий петр пётр лев роман виктор олег игорь владимир евгений илья егор тимур марат матвей глеб марк степан никита артем артём денис кирилл богдан руслан родион демид ярослав вячеслав станислав григорий".split(),
    "femn": "анна мария елена ольга наталья екатерина ирина алина дарья светлана татьяна юлия полина виктория ксения вера алиса инна ева лада жанна надежда любовь галина валентина маргарита".split(),
}
OBLIQUE = "павла павлу павлом павле льва льву львом льве петра петру петром петре пётра марка марку марком".split()
PATRONYMIC_ENDS = "овичу евичу овичем евичем овиче евиче ович евич ичем ичу иче овича евича ьича ича ыча ьичем ьичу ьиче ьич ич ыч овне евне овною евною овной евной овну евну овна евна ичной ичны ична ичне ичну овны евны".split()
SURNAME_ENDS = (
    "овым евым иным ыным овой евой иной ыной скому цкому ского цкого ским цким ском цком ову еву ину ыну ова ева ина ына ове еве ине ыне ской цкой ская цкая скую цкую ов ев ин ын ский цкий ко ук юк енко ой ая ую ого ому ым".split()
)
GIVEN_ENDS = "ой ем ём ом ей ии ию ья ье ью ы у ю а я е и".split()
NOMINAL_ENDS = "ого ому ой ем ём ом ей ую ая ым ье ья ью ы у ю е и а я".split()
TAILS = ("", "а", "я", "й", "ий", "ь")
STEM_ENDS = "ов ев ин ын вич вн".split()
ADJECTIVE_STEMS = "ст цк ск".split()
NO_NAMES = "клиент банк заявитель договор паспорт россия москва отдел улица город".split()
#: Runs of two or three name words with a given name or patronymic among them, as signs: a space or a bar before each word, and its letter.
NAME_RUN = "(?:[NP] [NPS](?: [NPS])?|S [NP](?: [NPS])?|S S [NP])"
GAP_BYTES = 3


def _ends(word: Column, ends: list[str]) -> Column:
    """Whether a word has one of the endings and two letters at least before it."""
    return word.rlike(rf"(?s)..(?:{'|'.join(ends)})\z")


def names_of_word(word: Column) -> Column:
    """struct(letter, gender, nominal) of a lower-case word: N, P, S for a given name, patronymic or surname by list and endings, else null; and the form that its mentions share.
    The word is mentioned many times: it should be a column, or what a lambda is given."""
    given = {w: g for g, words in GIVEN.items() for w in words} | {w: "masc" for w in OBLIQUE}
    # sets, as a map is searched from its first key on
    known = lambda w: F.when(w.isin(*[x for x, g in given.items() if g == "masc"]), "masc").when(w.isin(*[x for x, g in given.items() if g == "femn"]), "femn")
    tails = F.split(F.lit("|".join(TAILS)), r"\|")

    def bases(ends: list[str], least: int) -> Column:
        fits = F.filter(F.split(F.lit(",".join(ends)), ","), lambda e: F.endswith(word, e) & (F.length(word) > F.length(e) + least))
        return F.transform(fits, lambda e: F.substr(word, F.lit(1), F.length(word) - F.length(e)))

    listed = lambda base: F.filter(F.transform(tails, lambda t: F.concat(base, t)), lambda w: known(w).isNotNull())

    def nominal_of(base: Column) -> Column:
        stem = lambda ends: base.rlike(rf"(?:{'|'.join(ends)})\z")
        own = _ends(base, SURNAME_ENDS) | _ends(base, PATRONYMIC_ENDS) | stem(STEM_ENDS)
        return F.coalesce(F.get(listed(base), F.lit(0)), F.when(own, base), F.when(stem(ADJECTIVE_STEMS), F.concat(base, F.lit("ой"))))

    first = lambda words: F.get(F.filter(words, lambda w: w.isNotNull()), F.lit(0))
    ending = lambda ends: F.get(F.filter(F.split(F.lit(",".join(ends)), ","), lambda e: F.endswith(word, e) & (F.length(word) > F.length(e) + 1)), F.lit(0))

    def told(own: Column) -> Column:
        inflected = F.get(F.flatten(F.transform(bases(GIVEN_ENDS, 1), listed)), F.lit(0))
        nominal = F.when(own.isNotNull(), word).otherwise(F.coalesce(first(F.transform(bases(NOMINAL_ENDS, 1), nominal_of)), word))
        kind = lambda gender: F.when(gender.isNotNull(), "N").when(_ends(word, PATRONYMIC_ENDS), "P").when(_ends(word, SURNAME_ENDS), "S")

        def sexed(x: Column) -> Column:
            woman, last = ending(PATRONYMIC_ENDS).rlike("вн|чн"), ending(SURNAME_ENDS)
            sex = F.when(x["letter"] == "N", x["gender"]).when(x["letter"] == "P", F.when(woman, "femn").otherwise("masc")).when(x["letter"] == "S", F.when(last.rlike("а$|ая$"), F.lit(None)).otherwise("masc"))
            return F.struct(x["letter"].alias("letter"), sex.alias("gender"), nominal.alias("nominal"))

        return let(let(F.coalesce(own, known(inflected)), lambda gender: F.struct(gender.alias("gender"), kind(gender).alias("letter"))), sexed)

    return let(known(word), told)


def names(text: Column) -> Column:
    """Runs of name words no more than ``GAP_BYTES`` bytes of white space apart, and surnames with initials, as struct(type, value, start, end, identity_key, gender)."""
    kind = "array<struct<type:string,value:string,start:int,end:int,identity_key:string,gender:string>>"

    def word(s: Column) -> Column:
        named = lambda w, r: F.struct(s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end"), F.when(~w.isin(*NO_NAMES), r["letter"]).alias("letter"), r["gender"].alias("gender"), r["nominal"].alias("nominal"))
        return let(F.lower(s["value"]), lambda w: let(names_of_word(w), lambda r: named(w, r)))

    told = F.transform(find_spans(text, f"{_NAME_WORD}(?:-{_NAME_WORD})?"), word)

    def runs(w: Column) -> Column:
        def sign(x: Column, i: Column) -> Column:
            before = F.get(w, i - 1)["end"]
            gap = F.substr(text, before + 1, x["start"] - before)
            near = (i > 0) & gap.rlike(r"(?U)^\s*$") & (F.octet_length(gap) <= GAP_BYTES)
            return F.concat(F.when(near, F.lit(" ")).otherwise("|"), F.coalesce(x["letter"], F.lit("-")))

        def one(span: Column) -> Column:
            inner = F.slice(w, ((span["start"] - 1) / 2).cast("int") + 1, ((F.length(span["value"]) + 1) / 2).cast("int"))

            def built(p: Column) -> Column:
                start, end = F.get(p, F.lit(0))["start"], F.element_at(p, -1)["end"]
                gender = F.get(F.filter(F.transform(p, lambda x: x["gender"]), lambda g: g.isNotNull()), F.lit(0))
                value = F.substr(text, start + 1, end - start)
                # words that stand together without white space are one word to the key
                words = F.transform(F.filter(F.split(value, r"(?U)\s+"), lambda x: x != ""), lambda x: let(F.lower(x), names_of_word)["nominal"])
                return F.struct(F.lit("FULL_NAME"), value, start, end, F.concat(F.lit("person:"), F.array_join(words, " ")), gender)

            return let(inner, built)

        return F.transform(find_spans(F.array_join(F.transform(w, sign), ""), NAME_RUN), one)

    def short(pattern: str) -> Column:
        def one(s: Column) -> Column:
            value = F.regexp_replace(s["value"], " +$", "")
            longest = F.element_at(F.filter(F.split(value, r"(?U)\s+"), lambda x: F.length(x) > 2), -1)

            def of(word: Column) -> Column:
                surname = F.coalesce(_ends(word, SURNAME_ENDS), F.lit(False))
                return F.when(surname, F.struct(F.lit("FULL_NAME"), value, s["start"], (s["start"] + F.length(value)).cast("int"), F.concat(F.lit("person:"), names_of_word(word)["nominal"]), F.lit(None).cast("string")).cast(kind[6:-1]))

            return let(F.lower(longest), of)

        some = lambda s: F.size(F.filter(F.split(s["value"], r"(?U)\s+"), lambda x: F.length(x) > 2)) > 0
        return F.filter(F.transform(F.filter(find_spans(text, pattern), some), one), lambda c: c.isNotNull())

    initials = r"(?:[А-ЯЁ]\.\s?)"
    return F.coalesce(F.concat(let(told, runs).cast(kind), short(rf"{initials}{{1,2}}{_NAME_WORD}").cast(kind), short(rf"{_NAME_WORD}\s{initials}{{2}}").cast(kind)), F.array().cast(kind))


def _candidates(t: Column, only: tuple[str, ...] | None) -> Column:
    """All candidates of the types in ``only`` (all if there is none), in the order of the patterns."""
    none = F.array().cast(f"array<{SPAN}>")
    spans = lambda k, guard=None: find_spans(t, PATTERNS[k], guard)
    issuers = has_any(t, ("МВД", "УФМС", "ОВД"))

    def of(x: Column) -> Column:
        lowered, raw = x["lowered"], x["raw"]
        near = lambda s, kind: near_bytes(t, s, kind, raw)
        code = lambda s: F.when(near(s, "CVV"), "CVV").when((F.length(s["value"]) == 4) & near(s, "PIN"), "PIN")
        date = lambda s: F.when(near(s, "BIRTH_DATE"), "BIRTH_DATE").when(near(s, "PASSPORT_ISSUE_DATE"), "PASSPORT_ISSUE_DATE")
        ok = lambda s: fenced(t, s)
        trim = lambda s: let(F.regexp_replace(s["value"], r"[ \t.]+$", ""), lambda v: F.struct(v.alias("value"), s["start"].alias("start"), (s["start"] + F.length(v)).alias("end")))
        dated = has_keyword(lowered, "BIRTH_DATE", "PASSPORT_ISSUE_DATE")
        made: list[tuple[tuple[str, ...], Callable[[], Column]]] = [
            (("INN",), lambda: _typed(spans("inn", has_keyword(lowered, "INN")), "INN", lambda s: fenced(t, s) & inn_valid(s["value"]) & near(s, "INN"))),
            (("CARD_NUMBER",), lambda: _typed(spans("card"), "CARD_NUMBER", lambda s: fenced(t, s) & luhn_valid(s["value"]))),
            (("CVV", "PIN"), lambda: _typed(spans("code", has_keyword(lowered, "CVV", "PIN")), code, ok)),
            *[(("BIRTH_DATE", "PASSPORT_ISSUE_DATE"), lambda k=k: _typed(spans(k, dated), date, ok)) for k in ("date", "date_iso", "date_text")],
            *[(("ADDRESS",), lambda k=k: _typed(spans(k), "ADDRESS")) for k in ("address_index", "address_words")],
            (("ADDRESS",), lambda: _typed(spans("address_compact", has_keyword(lowered, "ADDRESS")), "ADDRESS", lambda s: near(s, "ADDRESS"))),
            (("CITIZENSHIP",), lambda: F.when(has_keyword(lowered, "CITIZENSHIP"), F.concat(*[_typed(find_spans(t, c, F.contains(t, F.lit(c))), "CITIZENSHIP", lambda s: near(s, "CITIZENSHIP")) for c in CITIZENSHIPS])).otherwise(none)),
            (("PASSPORT_ISSUER",), lambda: _typed(F.transform(spans("issuer", issuers), trim), "PASSPORT_ISSUER")),
            (("CARDHOLDER",), lambda: _typed(spans("cardholder", has_keyword(lowered, "CARDHOLDER")), "CARDHOLDER", lambda s: near(s, "CARDHOLDER"))),
        ]
        return F.concat(*[make() for kinds, make in made if only is None or set(only) & set(kinds)])

    found = let(let(F.lower(t), lambda low: F.struct(low.alias("lowered"), F.encode(low, "utf-8").alias("raw"))), of)
    return found if only is None else F.filter(found, lambda c: c["type"].isin(*only))


def detect(docs: DataFrame, text: str = "text", only: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with candidates and spans: the chosen candidates, in order of start. ``only``: the types that are wanted; the patterns of others are not searched, and only those
    wanted compete for places."""
    found = built(lambda: _candidates(F.col(text), only), "compact", text, only)
    return docs.withColumn("candidates", pinned(F.coalesce(found, F.array().cast(f"array<{SPAN}>")))).withColumn("spans", pinned(first_and_longest(F.col("candidates"))))


def first_and_longest(candidates: Column) -> Column:
    """Of overlapping candidates the one that starts first, and of those that start together the longest."""
    ordered = F.array_sort(candidates, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise((b["end"] - b["start"]) - (a["end"] - a["start"])))
    empty = F.struct(F.lit(-1).alias("last"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        stays = c["start"] >= acc["last"]
        return F.struct(F.when(stays, c["end"]).otherwise(acc["last"]).alias("last"), F.when(stays, F.array_append(acc["out"], c)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ordered, empty, step, lambda acc: acc["out"])


def decide(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with spans to ``docs`` with decisions (span, decision, reason). Addresses are judged by their sentence, PINs by a card
    that is so near that both lie within ``PIN_EXTENT`` bytes of one paragraph."""
    t, spans = F.col(text), F.col("spans")

    def linked(d: Column, o: Column) -> Column:
        low, high = F.least(d["start"], o["start"]), F.when(d["start"] < o["start"], o["end"]).otherwise(d["end"])
        between = F.substr(t, low + 1, high - low)
        return (o["type"] == "CARD_NUMBER") & (F.octet_length(between) <= PIN_EXTENT) & ~F.contains(between, F.lit("\n\n"))

    def one(d: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
        after = F.coalesce(F.get(spans, i + 1)["start"], F.length(t))

        def judged(b: Column) -> Column:
            low, high = F.greatest(b["low"], before), F.least(b["high"], after)
            w = F.lower(F.substr(t, low + 1, high - low))
            return F.when(F.size(hits(w, PERSONAL_ADDRESS, "p")) > 0, "personal_address").when(F.size(hits(w, ORGANIZATION_ADDRESS, "o")) > 0, "organizational_address").otherwise("no_context_fail_safe")

        address = let(sentence_bounds(t, d["start"], d["end"]), judged)
        reason = F.when(d["type"] == "ADDRESS", address).when((d["type"] == "PIN") & ~F.exists(spans, lambda o: linked(d, o)), "relationship_rule_unmet:CARD_NUMBER").otherwise("personal_by_construction")
        return let(reason, lambda r: F.struct(d["type"].alias("type"), d["value"].alias("value"), d["start"].alias("start"), d["end"].alias("end"), F.when(r.isin("organizational_address", "relationship_rule_unmet:CARD_NUMBER"), "KEEP").otherwise("MASK").alias("decision"), r.alias("reason")))

    return docs.withColumn("decisions", pinned(F.transform(spans, one)))


def partial_mask(kind: Column, value: Column) -> Column:
    """As in the full profile, but cards too are masked wholly where no digit is to spare."""
    return (
        F.when(kind == "CARDHOLDER", mask_name(value))
        .when(kind == "CARD_NUMBER", mask_digits(value, 4, 4, True))
        .when(kind == "INN", mask_digits(value, 2, 2, True))
        .otherwise(mask_alnum(value))
    )
