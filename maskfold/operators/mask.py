"""Replacing what was decided, and putting it back from the record.

All of it is native but for the resolution of persons, one Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import built, partial_mask, pinned
from . import entities as en
from .synthesis import synthesized

OCCURRENCE = "struct<entity_id:string,original_start:int,original_end:int,masked_start:int,masked_end:int,original:string,masked:string>"
MODES = ("partial", "token", "synthetic")
#: What stands for an occurrence (a struct with type, value and entity_id) in the modes that need nothing else.
STRATEGIES: dict[str, Callable[[Column], Column]] = {
    "partial": lambda e: partial_mask(e["type"], e["value"]),
    "token": lambda e: F.concat(F.lit("<"), e["entity_id"], F.lit(">")),
}


def register_strategy(mode: str, replacement: Callable[[Column], Column]) -> None:
    """Makes an own mode known to :func:`masked`. Its texts are restored exactly from their occurrences, as with every mode."""
    if mode in MODES:
        raise ValueError(f"{mode} is built in")
    STRATEGIES[mode] = replacement


def splice(text: Column, spans: Column) -> Column:
    """struct(text, occurrences): disjoint spans (start, end, replacement, entity_id) in order put into the text."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("shift"), F.array().cast("array<string>").alias("pieces"), F.array().cast(f"array<{OCCURRENCE}>").alias("occurrences"))

    def step(acc: Column, s: Column) -> Column:
        new, shift = s["replacement"], acc["shift"]
        done = F.struct(
            s["entity_id"].alias("entity_id"), s["start"].alias("original_start"), s["end"].alias("original_end"), (s["start"] + shift).alias("masked_start"), (s["start"] + shift + F.length(new)).alias("masked_end"),
            F.substr(text, s["start"] + 1, s["end"] - s["start"]).alias("original"), new.alias("masked"),
        )
        pieces = F.concat(acc["pieces"], F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), new))
        return F.struct(s["end"].alias("at"), (shift + F.length(new) - (s["end"] - s["start"])).alias("shift"), pieces.alias("pieces"), F.array_append(acc["occurrences"], done.cast(OCCURRENCE)).alias("occurrences"))

    def finish(acc: Column) -> Column:
        rest = F.substr(text, acc["at"] + 1, F.length(text) - acc["at"])
        return F.struct(F.concat(F.array_join(acc["pieces"], ""), rest).alias("text"), acc["occurrences"].alias("occurrences"))

    unchanged = F.struct(text.alias("text"), F.array().cast(f"array<{OCCURRENCE}>").alias("occurrences"))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(unchanged)


def put_back(text: Column, occurrences: Column, masked: bool) -> Column:
    """The original text from the masked one and its record (``masked``), or the masked one from the original again."""
    a, b, new = ("masked_start", "masked_end", "original") if masked else ("original_start", "original_end", "masked")
    spans = F.transform(F.array_sort(occurrences, lambda x, y: x[a] - y[a]), lambda o: F.struct(o[a].alias("start"), o[b].alias("end"), o[new].alias("replacement"), o["entity_id"].alias("entity_id")))
    return splice(text, spans)["text"]


def masked(docs: DataFrame, mode: str = "partial", text: str = "text", session: str | None = None, names: bool = True) -> DataFrame:
    """``docs`` with decisions to ``docs`` with masked_text, occurrences, mappings, n_detected and n_masked.

    ``session`` names the column that seeds surrogates (the document's own key). ``names`` may be off where the name
    detector was not run; no Python is started then, except for surrogates.
    """
    if mode not in MODES and mode not in STRATEGIES:
        raise ValueError(f"mode must be one of {sorted({*MODES, *STRATEGIES})}")
    t = F.col(text)
    pin = pinned
    before = docs.columns
    persons = en.people(F.col("decisions")) if names else en.no_people()
    out = docs.withColumn("_people", persons).withColumn("_entities", built(lambda: pin(en.entity_ids(F.col("decisions"), F.col("_people"))), "entities"))
    made = lambda: F.when(F.col("_entities").isNull(), F.array().cast(f"array<{en.MAPPING}>")).otherwise(en.mappings(F.col("_entities"), F.col("_people")))
    out = out.withColumn("mappings", built(lambda: pin(made()), "mappings"))
    if mode == "synthetic":
        if session is None:
            raise ValueError("surrogates need a session column")
        out = out.withColumn("_session", pin(F.col(session).cast("string")))
        surrogates = lambda: pin(synthesized(t, F.col("_session"), F.col("_entities"), F.col("mappings"), F.col("_people")))
        out = out.withColumn("_made", built(surrogates, "surrogates", text)).withColumn("mappings", F.col("_made.mappings"))
        new = lambda e, i: F.get(F.col("_made.new"), i)
    else:
        new = lambda e, i: STRATEGIES[mode](e)
    spans = lambda: F.transform("_entities", lambda e, i: F.struct(e["start"].alias("start"), e["end"].alias("end"), new(e, i).alias("replacement"), e["entity_id"].alias("entity_id")))
    done = out.withColumn("_done", built(lambda: pin(splice(t, spans())), "splice", text, mode, STRATEGIES.get(mode)))
    counts = F.size(F.filter("decisions", lambda d: d["decision"] == "MASK"))
    return done.select(
        *[c for c in before if c not in ("masked_text", "occurrences", "mappings", "mode", "n_detected", "n_masked")], F.lit(mode).alias("mode"), F.col("_done.text").alias("masked_text"),
        F.col("_done.occurrences").alias("occurrences"), "mappings", F.size("decisions").alias("n_detected"), counts.alias("n_masked"),
    )
