"""Spans of pattern matches as arrays, without leaving the JVM.

``split`` and ``regexp_extract_all`` cut a text at the same places, so running lengths of both give the
offsets of all matches (0-based code points, half open). A cheap guard keeps texts without a match from being cut.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let

SPAN = "array<struct<value:string,start:int,end:int>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def find_spans(text: Column, pattern: str | Column, guard: Column | None = None, group: int = 0) -> Column:
    """The matches of a Java pattern, a constant or a column. ``group``: the span is that group, which must end where the match ends."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    inner = [F.regexp_extract_all(text, p, F.lit(group)).alias("inner")] if group else []
    both = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("found"), F.split(text, p, -1).alias("rest"), *inner)

    def walk(x: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

        def step(acc: Column, i: Column) -> Column:
            value = F.get(x["found"], i)
            inner = F.get(x["inner"], i) if group else value
            end = acc["at"] + F.length(F.get(x["rest"], i)) + F.length(value)
            span = F.struct(inner.alias("value"), (end - F.length(inner)).alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

        return F.when(F.size(x["found"]) == 0, no_spans()).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(x["found"]) - 1), first, step, lambda acc: acc["out"]))

    return F.when(F.regexp_like(text, p) if guard is None else guard, let(both, walk)).otherwise(no_spans())


def around(text: Column, start: Column, end: Column, radius: int) -> Column:
    """The text from ``radius`` before start to ``radius`` after end."""
    low = F.greatest(start - radius, F.lit(0))
    return F.substr(text, low + 1, end + radius - low)


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text, computed once, has one of the words."""

    def any_of(t: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(t, F.lit(w))
        return out

    return let(text, any_of)


def near(text: Column, words: tuple[str, ...], radius: int):
    """A predicate on spans: one of the words stands within the radius, in any case."""
    return lambda s: has_any(F.lower(around(text, s["start"], s["end"], radius)), words)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def apart_from(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return let(others, lambda o: F.filter(spans, lambda x: ~F.exists(o, lambda y: overlaps(x, y))))
