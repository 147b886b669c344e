"""From candidates to decisions: overlaps, context, relations between types, and consumers' policies.

A document stays one row all the way, with arrays; nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import built, let, pinned
from ..functions.spans import overlaps
from .detectors import CANDIDATE

DECISION = CANDIDATE[:-1] + ",decision:string,decision_confidence:double,reasons:array<string>>"
RADIUS = 220


def resolve_overlaps(candidates: Column) -> Column:
    """Greedy choice by confidence, then length, then start, then detector; a candidate that overlaps a chosen one
    goes. The chosen ones are returned by start. (Whether one is chosen depends on chosen ones only, so no single window function does it.)"""
    keyed = F.transform(candidates, lambda c: F.struct((-c["confidence"]).alias("a"), (c["start"] - c["end"]).alias("b"), c["start"].alias("s"), c["det_order"].alias("o"), c.alias("c")))
    ordered = F.transform(F.array_sort(keyed, _by_rank), lambda k: k["c"])
    empty = F.array().cast(f"array<{CANDIDATE}>")
    chosen = F.aggregate(ordered, empty, lambda acc, c: F.when(F.exists(acc, lambda o: overlaps(o, c)), acc).otherwise(F.array_append(acc, c)))
    return F.when(F.size(candidates) == 0, empty).otherwise(F.array_sort(chosen, lambda a, b: a["start"] - b["start"]))


def _by_rank(x: Column, y: Column) -> Column:
    out = F.lit(0)
    for f in ("o", "s", "b", "a"):
        out = F.when(x[f] < y[f], -1).when(x[f] > y[f], 1).otherwise(out)
    return out


def sentence_bounds(text: Column, start: Column, end: Column, radius: int = RADIUS) -> Column:
    """struct(low, high): the sentence around a span, no further than ``radius`` from it."""
    low = F.greatest(start - radius, F.lit(0))
    before = F.substr(text, low + 1, start - low)
    after = F.substr(text, end + 1, F.lit(radius))
    tail = F.regexp_extract(before, r"[^.!?\n]*$", 0)
    head = F.regexp_extract(after, r"^[^.!?\n]*[.!?\n]?", 0)
    return F.struct((start - F.length(tail)).alias("low"), (end + F.length(head)).alias("high"))


def keyword_hit(window: Column, word: str) -> Column:
    """Whether a word of the (lower-case) window begins with the keyword and has at most two characters more."""
    return window.rlike(rf"(?U)(?<![\p{{Alnum}}_-])\Q{word}\E[\p{{Alnum}}_-]{{0,2}}(?![\p{{Alnum}}_-])")


def hits(window: Column, words: Sequence[str], prefix: str) -> Column:
    """Reasons ``prefix:word`` for the keywords that hit, in order. One pattern rules most windows out at once."""
    any_of = "|".join(rf"\Q{w}\E" for w in words)
    found = F.filter(F.array(*[F.when(keyword_hit(window, w), F.lit(f"{prefix}:{w}")) for w in words]), lambda x: x.isNotNull())
    return F.when(window.rlike(any_of), found).otherwise(F.array().cast("array<string>"))


def _decision(c: Column, decision: Column, confidence: Column, reasons: Column) -> Column:
    fields = [c[f].alias(f) for f in ("type", "value", "start", "end", "detector", "confidence", "det_order", "meta")]
    return F.struct(*fields, decision.alias("decision"), confidence.cast("double").alias("decision_confidence"), reasons.alias("reasons")).cast(DECISION)


def _scored(score: Column, most: float) -> Column:
    return F.least(F.lit(0.6) + F.lit(0.1) * score, F.lit(most))


def _name(c: Column, window: Column, uncertain: bool) -> Column:
    groups = F.struct(*[hits(window, w, p).alias(p) for w, p in ((fv.ROLES, "role"), (fv.ACTIONS, "action"), (fv.BANK_CONCEPTS, "bank_concept"), (fv.STRONG_PII, "strong_pii"), (fv.PUBLIC_MARKERS, "public_marker"))])

    def judge(g: Column) -> Column:
        known = F.coalesce(c["meta"]["known_public_figure"], F.lit(False))
        private = F.size(g["role"]) * 2 + F.size(g["action"]) * 2 + F.size(g["bank_concept"]) + F.size(g["strong_pii"]) * 3
        public = F.size(g["public_marker"]) * 2 + F.when(known, 2).otherwise(0)
        reasons = F.concat(g["role"], g["action"], g["bank_concept"], g["strong_pii"], g["public_marker"], F.when(known, F.array(F.lit("known_public_figure"))).otherwise(F.array().cast("array<string>")))
        none = _decision(c, F.lit("UNCERTAIN" if uncertain else "MASK"), F.lit(0.5 if uncertain else 0.55), F.array(F.lit("no_context_uncertain" if uncertain else "no_context_fail_safe")))
        return F.when(private > 0, _decision(c, F.lit("MASK"), _scored(private, 0.99), reasons)).when(public > 0, _decision(c, F.lit("KEEP"), _scored(public, 0.95), reasons)).otherwise(none)

    return let(groups, judge)


def _address(c: Column, window: Column, uncertain: bool) -> Column:
    organization = F.concat(hits(window, fv.ORGANIZATION_ADDRESS, "organizational"), hits(F.lower(c["value"]), fv.ORGANIZATION_ADDRESS, "organizational"))
    groups = F.struct(hits(window, fv.PERSONAL_ADDRESS, "personal").alias("personal"), organization.alias("organization"))

    def judge(g: Column) -> Column:
        none = _decision(c, F.lit("UNCERTAIN" if uncertain else "MASK"), F.lit(0.5 if uncertain else 0.55), F.array(F.lit("no_context_uncertain" if uncertain else "no_context_fail_safe")))
        personal, organizational = F.size(g["personal"]), F.size(g["organization"])
        return F.when(personal > 0, _decision(c, F.lit("MASK"), _scored(personal, 0.97), g["personal"])).when(organizational > 0, _decision(c, F.lit("KEEP"), _scored(organizational, 0.95), g["organization"])).otherwise(none)

    return let(groups, judge)


def decide(text: Column, chosen: Column, radius: int = RADIUS, emit_uncertain: bool = False) -> Column:
    """Decisions for disjoint candidates in order of start: names and addresses by their context, which never reaches
    into the neighbouring candidates; all else is personal by construction."""

    def one(c: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(chosen, i - 1)["end"]).otherwise(0)
        after = F.coalesce(F.get(chosen, i + 1)["start"], F.length(text))

        def within(b: Column) -> Column:
            low, high = F.greatest(b["low"], before), F.least(b["high"], after)
            return F.lower(F.substr(text, low + 1, high - low))

        judged = let(let(sentence_bounds(text, c["start"], c["end"], radius), within), lambda w: F.when(c["type"] == "FULL_NAME", _name(c, w, emit_uncertain)).otherwise(_address(c, w, emit_uncertain)))
        plain = _decision(c, F.lit("MASK"), c["confidence"], F.array(F.lit("personal_by_construction")))
        return F.when(c["type"].isin("FULL_NAME", "ADDRESS"), judged).otherwise(plain)

    return F.transform(chosen, one)


#: type, the type it needs nearby, and how near.
RELATIONS = (("PIN", "CARD_NUMBER", 300),)


def _with(d: Column, decision: str, confidence: Column, reason: Column) -> Column:
    return _decision(d, F.lit(decision), confidence, F.array_append(d["reasons"], reason))


def apply_relations(text: Column, decisions: Column, relations: tuple[tuple[str, str, int], ...] = RELATIONS) -> Column:
    """A type that only means something beside another one is kept where that one is missing: not within so many
    characters, or beyond an empty line. Any candidate of the other type counts, kept or masked."""
    out = decisions
    for kind, other, most in relations:

        def near(d: Column, o: Column, other=other, most=most) -> Column:
            low, high = F.least(d["end"], o["end"]), F.greatest(d["start"], o["start"])
            between = F.when(low < high, F.substr(text, low + 1, high - low)).otherwise("")
            gap = F.greatest(d["start"] - o["end"], o["start"] - d["end"], F.lit(0))
            return (o["type"] == other) & (o["start"] != d["start"]) & (gap <= most) & ~F.contains(between, F.lit("\n\n"))

        def checked(d: Column, kind=kind, other=other, near=near) -> Column:
            unmet = (d["type"] == kind) & (d["decision"] == "MASK") & ~F.exists(decisions, lambda o: near(d, o))
            return F.when(unmet, _with(d, "KEEP", F.lit(0.6), F.lit(f"relationship_rule_unmet:{other}"))).otherwise(d)

        current = out
        out = F.transform(current, _unary(checked))
    return out


def _unary(f):
    return lambda d: f(d)


def apply_policy(decisions: Column, mask_types: Column) -> Column:
    """Types that the consumer does not list are kept; a null list means all types, an empty one none."""
    excluded = lambda d: (d["decision"] == "MASK") & mask_types.isNotNull() & ~F.array_contains(mask_types, d["type"])
    return F.transform(decisions, lambda d: F.when(excluded(d), _with(d, "KEEP", d["decision_confidence"], F.lit("consumer_policy_excludes_type"))).otherwise(d))


def decided(docs: DataFrame, text: str = "text", mask_types: Column | None = None, radius: int = RADIUS, emit_uncertain: bool = False, relations: tuple[tuple[str, str, int], ...] = RELATIONS) -> DataFrame:
    """``docs`` with candidates, from :func:`detect`, to ``docs`` with decisions."""
    t = F.col(text)
    out = docs.withColumn("candidates", built(lambda: pinned(resolve_overlaps(F.col("candidates"))), "overlaps"))
    out = out.withColumn("decisions", built(lambda: pinned(decide(t, F.col("candidates"), radius, emit_uncertain)), "decide", text, radius, emit_uncertain))
    out = out.withColumn("decisions", built(lambda: pinned(apply_relations(t, F.col("decisions"), relations)), "relations", text, relations))
    return out.withColumn("decisions", pinned(apply_policy(F.col("decisions"), mask_types))) if mask_types is not None else out
