"""Scalar functions as Column expressions: checksums, fingerprints, partial masks, seeds."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import INN_10, INN_11, INN_12, TOKEN_PREFIXES


_BUILT: dict[tuple, Column] = {}


def built(make: Callable[[], Column], *key) -> Column:
    """``make()``, once for a key in each JVM. An expression over columns of fixed names is the same in every plan, and those of this library have thousands of operators: to put one
    together takes seconds, each operator some calls to the JVM."""
    key = (id(SparkContext._gateway), *key)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, as lambdas would compute what they mention at every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pinned(value: Column) -> Column:
    """The value in a projection of its own. Else the optimizer moves it into the expressions that use it, where a lambda
    computes it again at every element, and a Python function with it among its arguments may not be taken out of the plan."""
    return F.when(F.spark_partition_id() >= 0, value)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def luhn_valid(value: Column) -> Column:
    d = digits(value)
    return (F.length(d) > 0) & F.call_function("luhn_check", d)


def _check_digit(d: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        total = total + F.substring(d, i, 1).cast("int") * w
    return (total % 11 % 10).cast("string")


def inn_valid(value: Column) -> Column:
    """Whether the digits are a taxpayer number of 10 or 12 digits with right check digits."""
    d = digits(value)
    ten = _check_digit(d, INN_10) == F.substring(d, 10, 1)
    twelve = (_check_digit(d, INN_11) == F.substring(d, 11, 1)) & (_check_digit(d, INN_12) == F.substring(d, 12, 1))
    return F.when(F.length(d) == 10, ten).when(F.length(d) == 12, twelve).otherwise(F.lit(False))


def fingerprint(text: Column, secret: str | None = None) -> Column:
    """HMAC-SHA-256 with a secret, else SHA-256, in lowercase hex."""
    if not secret:
        return F.sha2(text, 256)
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in key).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)


def token_count(text: Column) -> Column:
    """A quarter of the characters, 1 at least, 0 for an empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.floor(F.length(text) / 4), F.lit(1))).cast("int")


def normalize_ru_phone(value: Column) -> Column:
    d = digits(value)
    d = F.when((F.length(d) == 11) & F.startswith(d, F.lit("8")), F.concat(F.lit("7"), F.substring(d, 2, 10))).otherwise(d)
    return F.when(d == "", value).otherwise(F.concat(F.lit("+"), d))


def mask_alnum(value: Column) -> Column:
    return F.regexp_replace(value, r"[\p{L}\p{N}]", "*")


def mask_name(value: Column) -> Column:
    """The first letter of each word, in upper case, with a full stop; ``*.`` for a word without letters."""
    words = F.filter(F.split(F.trim(value), r"(?U)\s+"), lambda w: w != "")
    letter = lambda w: F.upper(F.regexp_extract(w, r"\p{L}", 0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.when(letter(w) == "", "*").otherwise(letter(w)), F.lit("."))), " ")


def mask_digits(value: Column, first: int, last: int, short_too: bool) -> Column:
    """All digits become ``*`` but the first and last ones. ``short_too``: a value with no digit to spare is masked wholly."""
    n = F.length(digits(value))
    head = F.regexp_extract(value, rf"^(?:\D*\d){{{first}}}", 0)
    tail = F.regexp_extract(value, rf"(?:\d\D*){{{last}}}$", 0) if last else F.lit("")
    middle = F.substr(value, F.length(head) + 1, F.length(value) - F.length(head) - F.length(tail))
    masked = F.concat(head, F.regexp_replace(middle, r"\d", "*"), tail)
    return F.when(n > first + last, masked).otherwise(F.regexp_replace(value, r"\d", "*") if short_too else value)


def partial_mask(kind: Column, value: Column) -> Column:
    return (
        F.when(kind.isin("FULL_NAME", "CARDHOLDER"), mask_name(value))
        .when(kind == "PHONE", mask_digits(value, 1, 0, False))
        .when(kind == "PASSPORT", mask_digits(value, 2, 2, False))
        .when(kind == "CARD_NUMBER", mask_digits(value, 4, 4, False))
        .when(kind.isin("DRIVER_LICENSE", "INN"), mask_digits(value, 2, 2, True))
        .otherwise(mask_alnum(value))
    )


def token_prefix(kind: Column) -> Column:
    out = kind
    for name, prefix in TOKEN_PREFIXES.items():
        out = F.when(kind == name, prefix).otherwise(out)
    return out


def entity_seed(session: Column, key: Column) -> Column:
    """The first eight bytes of the hash of session and key, as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat(session, F.lit(":"), key), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def draw(seed: Column, counter: int, n: int) -> Column:
    """One draw below n of the keyed stream (the rare rejected draw gives null)."""
    value = F.conv(F.substring(F.sha2(F.concat(seed.cast("string"), F.lit(f":{counter}")), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    limit = (1 << 64) // n * n
    return F.when(value < F.lit(str(limit)).cast("decimal(20,0)"), F.pmod(value, F.lit(n)).cast("int"))
