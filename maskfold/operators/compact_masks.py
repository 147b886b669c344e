"""The compact profile's masks, surrogates and restoring.

Surrogates come from the same hash streams as those of the full profile, by plainer shapes: short pools, one form of date, no look at the text; a value is only new among those of its
type. Names are not declined: a mention that is not in the nominative gets its token. Restoring replaces token after token, then surrogate after surrogate, each in the text
that the one before has left, so that what was put in can be replaced again; surrogates count as whole words only. A replay of a request answers with its own
result whatever another one has saved, and there are no consumers' policies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import entity_seed, let, mask_alnum, mask_digits, mask_name, pinned
from . import morphology as m
from .compact import names_of_word
from .entities import firsts, numbered
from .mask import splice
from .synthesis import ATTEMPTS, NAMES, _n_digits, _numbers, _pool, _text, _weighted, draws

MAPPING = "struct<entity_id:string,type:string,original:string,token:string,synthetic:string,partial:string,gender:string>"
# The pools.
FIRST = {m.MASC: fv.MALE_FIRST[:10], m.FEMN: fv.FEMALE_FIRST[:10]}
LAST = fv.MALE_LAST[:10]
PATRONYMIC = {m.MASC: fv.MALE_PATRONYMIC, m.FEMN: fv.FEMALE_PATRONYMIC}
COUNTRIES = ("Россия", "Беларусь", "Казахстан", "Армения", "Узбекистан", "Грузия")
#: Draws of a number that must not stay as it is.
AGAIN = 4


def partial_mask(kind: Column, value: Column) -> Column:
    """As in the full profile, but numbers are masked wholly where no digit is to spare, of phones all but the first digit."""
    return (
        F.when(kind.isin(*NAMES), mask_name(value))
        .when(kind == "PHONE", mask_digits(value, 1, 0, False))
        .when(kind == "CARD_NUMBER", mask_digits(value, 4, 4, True))
        .when(kind.isin("PASSPORT", "DRIVER_LICENSE", "INN"), mask_digits(value, 2, 2, True))
        .otherwise(mask_alnum(value))
    )


def moduli(kind: Column, value: Column, keep: Column) -> Column:
    words = F.size(F.filter(F.split(value, r"(?U)\s+"), lambda w: w != ""))
    return (
        F.when(kind.isin(*NAMES), F.array_repeat(F.lit(10), F.least(F.greatest(words, F.lit(1)), F.lit(3))))
        .when(kind == "EMAIL", _numbers(100_000))
        .when(kind == "INN", F.array_repeat(F.lit(10), F.when(_n_digits(value) == 12, 12).otherwise(10)))
        .when(kind == "CARD_NUMBER", F.array_repeat(F.lit(10), 14))
        .when(kind.isin("BIRTH_DATE", "PASSPORT_ISSUE_DATE"), _numbers(28, 12, 55))
        .when(kind == "DEPARTMENT_CODE", _numbers(1000, 1000))
        .when(kind == "CITIZENSHIP", _numbers(len(COUNTRIES)))
        .when(kind.isin("PASSPORT_ISSUER", "BIRTH_PLACE"), _numbers(len(fv.CITIES)))
        .when(kind == "ADDRESS", _numbers(599_999, len(fv.CITIES), len(fv.STREETS), 250, 500))
        .otherwise(F.array_repeat(F.lit(10), F.greatest(_n_digits(value) - keep, F.lit(0))))
    )


def _value(kind: Column, value: Column, gender: Column, xs: Column, keep: Column) -> Column:
    x = lambda i: F.get(xs, F.lit(i))
    of = lambda pool, i: F.get(_pool(pool), x(i))
    padded = lambda n, w: F.lpad(n.cast("string"), w, "0")
    woman = F.coalesce(gender == m.FEMN, F.lit(False))
    last = F.concat(of(LAST, 0), F.when(woman, "а").otherwise(""))
    first = F.when(woman, of(FIRST[m.FEMN], 1)).otherwise(of(FIRST[m.MASC], 1))
    patronymic = F.when(woman, of(PATRONYMIC[m.FEMN], 2)).otherwise(of(PATRONYMIC[m.MASC], 2))
    name = F.when(F.size(xs) >= 3, F.concat_ws(" ", last, first, patronymic)).when(F.size(xs) == 2, F.concat_ws(" ", first, last)).otherwise(last)
    ten = F.concat(_text(F.slice(xs, 1, 9)), _weighted(xs, fv.INN_10).cast("string"))
    eleven = F.array_append(F.slice(xs, 1, 10), _weighted(xs, fv.INN_11))
    twelve = let(eleven, lambda e: F.concat(_text(e), _weighted(e, fv.INN_12).cast("string")))
    doubled = F.transform(F.concat(_numbers(4), xs), lambda d, i: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    card = F.concat(F.lit("4"), _text(xs), F.pmod(-F.aggregate(doubled, F.lit(0), lambda s, y: s + y), F.lit(10)).cast("string"))
    city = lambda i: of(fv.CITIES, i)
    address = F.concat(padded(x(0) + 100_000, 6), F.lit(", г. "), city(1), F.lit(", ул. "), of(fv.STREETS, 2), F.lit(", д. "), (x(3) + 1).cast("string"), F.lit(", кв. "), (x(4) + 1).cast("string"))

    def redrawn() -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

        def step(acc: Column, c: Column) -> Column:
            digit, k = c.rlike("[0-9]"), acc["n"] - keep
            return F.struct((acc["n"] + digit.cast("int")).alias("n"), F.concat(acc["out"], F.when(digit & (k >= 0), F.get(xs, k).cast("string")).otherwise(c)).alias("out"))

        return F.aggregate(F.split(value, ""), start, step, lambda acc: acc["out"])

    return (
        F.when(kind.isin(*NAMES), name)
        .when(kind == "EMAIL", F.concat(F.lit("user"), padded(x(0), 5), F.lit("@example.com")))
        .when(kind == "INN", F.when(F.size(xs) == 12, twelve).otherwise(ten))
        .when(kind == "CARD_NUMBER", card)
        .when(kind.isin("BIRTH_DATE", "PASSPORT_ISSUE_DATE"), F.concat_ws(".", padded(x(0) + 1, 2), padded(x(1) + 1, 2), (x(2) + 1950).cast("string")))
        .when(kind == "DEPARTMENT_CODE", F.concat_ws("-", padded(x(0), 3), padded(x(1), 3)))
        .when(kind == "CITIZENSHIP", of(COUNTRIES, 0))
        .when(kind == "PASSPORT_ISSUER", F.concat(F.lit("ГУ МВД России по г. "), city(0)))
        .when(kind == "BIRTH_PLACE", F.concat(F.lit("г. "), city(0)))
        .when(kind == "ADDRESS", address)
        .otherwise(redrawn())
    )


def surrogate(kind: Column, value: Column, gender: Column, seed: Column) -> Column:
    """A value from the stream of ``seed``. A number whose digits come out unchanged is drawn again, then with all its digits."""
    number = kind.isin("PHONE", "PASSPORT", "DRIVER_LICENSE", "CVV", "PIN")
    start = F.struct(F.lit(0).alias("counter"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("done"))

    def step(acc: Column, k: Column) -> Column:
        keep = F.when((kind == "PHONE") & (k == 1), 1).otherwise(0)

        def tried(d: Column) -> Column:
            return let(_value(kind, value, gender, d["xs"], keep), lambda v: F.struct(d["counter"].alias("counter"), v.alias("value"), (~number | (v != value)).alias("done")))

        return F.when(acc["done"], acc).otherwise(let(draws(seed, moduli(kind, value, keep), acc["counter"]), tried))

    return F.aggregate(F.sequence(F.lit(1), F.lit(AGAIN)), start, step, lambda acc: acc["value"])


def _entities(decisions: Column) -> Column:
    """The masked decisions with key and entity_id: numbered by first appearance within the prefix of their type."""
    own = lambda d: F.concat(d["type"], F.lit(":"), F.lower(F.trim(d["value"])))
    keyed = F.transform(F.filter(decisions, lambda d: d["decision"] == "MASK"), lambda d: F.struct(d["start"], d["end"], d["type"], d["value"], F.coalesce(d["identity_key"], own(d)).alias("key"), d["gender"]))

    return let(keyed, numbered)


def _mappings(entities: Column, session: Column) -> Column:
    """One mapping for each entity, in order of appearance, with a surrogate that is new among those of its type, if ``ATTEMPTS`` seeds give one."""
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(f"array<{MAPPING}>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        seed = F.pmod(entity_seed(session, e["key"]), F.lit(str(1 << 63)).cast("decimal(20,0)"))
        begin = F.struct(F.lit(None).cast("string").alias("value"), F.lit(False).alias("free"))

        def attempt(a: Column, i: Column) -> Column:
            drawn = surrogate(e["type"], e["value"], e["gender"], (seed + i).cast("string"))
            return F.when(a["free"], a).otherwise(let(drawn, lambda v: F.struct(v.alias("value"), (~F.array_contains(acc["used"], F.concat_ws(":", e["type"], v)) & (v != e["value"])).alias("free"))))

        chosen = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), begin, attempt, lambda a: a["value"])

        def put(v: Column) -> Column:
            row = F.struct(e["entity_id"].alias("entity_id"), e["type"].alias("type"), e["value"].alias("original"), F.concat(F.lit("<"), e["entity_id"], F.lit(">")).alias("token"), v.alias("synthetic"), partial_mask(e["type"], e["value"]).alias("partial"), e["gender"].alias("gender"))
            return F.struct(F.array_append(acc["used"], F.concat_ws(":", e["type"], v)).alias("used"), F.array_append(acc["out"], row.cast(MAPPING)).alias("out"))

        return let(chosen, put)

    return F.aggregate(firsts(entities), start, step, lambda acc: acc["out"])


def nominative(value: Column) -> Column:
    """Whether no word of a name is declined, as far as its endings tell."""
    words = F.transform(F.filter(F.split(value, r"(?U)\s+"), lambda w: w != ""), lambda w: F.lower(F.regexp_replace(w, r"\.+$", "")))
    return F.forall(words, lambda w: (F.length(w) <= 2) | (names_of_word(w)["nominal"] == w))


def masked(docs: DataFrame, mode: str = "partial", text: str = "text", session: str = "doc_id") -> DataFrame:
    """``docs`` with decisions to ``docs`` with masked_text, occurrences and mappings; ``session`` names the column that seeds surrogates."""
    t = F.col(text)
    has = docs.schema["decisions"].dataType.elementType.names
    missing = [F.lit(None).cast("string").alias(c) for c in ("identity_key", "gender") if c not in has]
    decisions = F.transform("decisions", lambda d: F.struct(*[d[c].alias(c) for c in has], *missing))
    out = docs.withColumn("_entities", pinned(_entities(decisions)))
    out = out.withColumn("mappings", pinned(_mappings(F.col("_entities"), F.col(session).cast("string"))))
    mapping = lambda e: F.get(F.filter(F.col("mappings"), lambda x: x["entity_id"] == e["entity_id"]), F.lit(0))
    token = lambda e: F.concat(F.lit("<"), e["entity_id"], F.lit(">"))
    new = {
        "partial": lambda e: partial_mask(e["type"], e["value"]),
        "token": token,
        "synthetic": lambda e: F.when(~e["type"].isin(*NAMES) | nominative(e["value"]), mapping(e)["synthetic"]).otherwise(token(e)),
    }[mode]
    spans = F.transform("_entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), new(e).alias("replacement"), e["entity_id"].alias("entity_id")))
    out = out.withColumn("_done", pinned(splice(t, spans)))
    return out.select(*docs.columns, F.lit(mode).alias("mode"), F.col("_done.text").alias("masked_text"), F.col("_done.occurrences").alias("occurrences"), "mappings")


def restored(text: Column, mode: str, mappings: Column) -> Column:
    """Any text with tokens and, of surrogates, whole words replaced, one mapping after the other."""
    if mode == "partial":
        return text
    tokens = F.aggregate(mappings, text, lambda t, x: F.replace(t, x["token"], x["original"]))
    if mode == "token":
        return tokens
    inside = r"[A-Za-z0-9_]|[^\x00-\x7F]"
    # what a replacement says is taken as it is
    said = lambda x: F.regexp_replace(x["original"], r"([\\$])", r"\\$1")
    pattern = lambda x: F.concat(F.lit(rf"(?<!{inside})\Q"), x["synthetic"], F.lit(rf"\E(?!{inside})"))
    return F.aggregate(mappings, tokens, lambda t, x: F.when(x["synthetic"] == "", t).otherwise(F.regexp_replace(t, pattern(x), said(x))))
