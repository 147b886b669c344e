"""Whole pipelines: analyze, inspect, and process in batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import fingerprint, token_count
from ..operators.decide import decided
from ..operators.demask import restored
from ..operators.detectors import detect
from ..operators.mask import MODES, masked, put_back
from ..sources.shared import written
from ..sources.tables import with_policy
from ..sources.vault import answer, insert_if_absent, live, mark_demasked, records
from .admission import MAX_PAYLOAD


#: What inspecting a text adds to it.
ANALYSIS = ("candidates", "decisions", "masked_text", "mappings", "occurrences", "n_detected", "n_masked", "demasked", "round_trip_ok")


def analyze(docs: DataFrame, text: str = "text", only: tuple[str, ...] | None = None, mask_types: Column | None = None) -> DataFrame:
    """``docs`` with candidates (disjoint) and decisions."""
    return decided(detect(docs, text, only), text, mask_types)


def inspect(docs: DataFrame, mode: str = "partial", text: str = "text", mask_types: Column | None = None) -> DataFrame:
    """One wide row a document: decisions, masked text, mappings, the text restored, and whether that is the
    original (null for partial masks, which cannot be undone from content). Surrogates are seeded by the text's hash."""
    out = analyze(docs, text, mask_types=mask_types).withColumn("_seed", F.sha2(text, 256))
    out = masked(out, mode, text, session="_seed").drop("_seed")
    out = out.withColumn("demasked", restored(F.col("masked_text"), F.lit(mode), F.col("mappings")))
    return out.withColumn("round_trip_ok", F.when(F.lit(mode) != "partial", F.col("demasked").eqNullSafe(F.col(text))))


def inspect_requests(requests: DataFrame, dimension: DataFrame, text: str = "text") -> DataFrame:
    """:func:`inspect` for requests that name their own ``mode`` (null: partial) and ``consumer_id`` (null: the default one), whose types alone are masked.

    ``status`` and ``error`` follow: a mode that is none (422) and an unknown consumer (404) come back without an analysis, all its columns null; a disabled one is still explained.
    """
    mode = F.coalesce("mode", F.lit("partial"))
    known = with_policy(requests, dimension)
    error = F.when(~mode.isin(*MODES), "invalid_mode").when(F.col("error_category") == "not_found", "unknown_consumer")
    judged = known.withColumn("mode", mode).withColumn("error", error).withColumn("status", F.when(error == "invalid_mode", 422).when(error == "unknown_consumer", 404).otherwise(200))
    told = [*requests.columns] + ([] if "mode" in requests.columns else ["mode"]) + ["status", "error"]
    out = []
    for kind in MODES:
        # the mode of a request is told by its own column, the analysis has that of the loop
        mine = judged.where(F.col("error").isNull() & (F.col("mode") == kind))
        out.append(inspect(mine, kind, text, mask_types=F.col("mask_types")).select(*told, *ANALYSIS))
    refused = judged.where(F.col("error").isNotNull())
    empty = [F.lit(None).cast(out[0].schema[c].dataType).alias(c) for c in ANALYSIS]
    return reduce(DataFrame.unionByName, [*out, refused.select(*told, *empty)])


def first_requests(requests: DataFrame, mode: str, now: Column, demask: Column | None = None, secret: str | None = None, only: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, new records) for requests (payload_id, payload) that have no record: surrogates are seeded by the payload_id."""
    names = only is None or "fio" in only
    out = masked(analyze(requests, "payload", only), mode, "payload", session="payload_id", names=names)
    answers = out.select(*requests.columns, F.lit("mask").alias("direction"), F.col("masked_text").alias("result"), "n_detected", "n_masked", token_count(F.col("payload")).alias("tokens"))
    return answers, records(out, "payload", now, demask, secret)


def process(requests: DataFrame, vault: DataFrame, mode: str, now: Column, secret: str | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """Answers to requests (payload_id, payload, allow_demask) from a vault's live records. Requests are first told
    apart by fingerprints; only those without a record run the detectors, only reworded texts are searched."""
    told = answer(requests, live(vault, now), secret)
    keep = ["payload_id", "payload", "direction", "result"]
    known = told.where("way in ('retry_mask', 'echo', 'demask_exact')").select(keep)
    reworded = told.where("way = 'demask_content'").withColumn("result", restored(F.col("payload"), F.col("mode"), F.col("mappings"))).select(keep)
    new, _ = first_requests(told.where("way = 'mask'").select("payload_id", "payload"), mode, now, secret=secret, only=only)
    return known.unionByName(reworded).unionByName(new.select(keep))


def process_batch(
    requests: DataFrame, vault: DataFrame, dimension: DataFrame, now: Column, secret: str | None = None, only: tuple[str, ...] | None = None, modes: tuple[str, ...] = MODES, max_payload: int = MAX_PAYLOAD
) -> tuple[DataFrame, DataFrame]:
    """(answers, vault afterwards) for a batch of requests (payload_id, payload, seq, consumer_id).

    A request without payload_id or payload is rejected (422), one beyond the size limit too (413), as is one of an unknown or disabled
    consumer (403). Of several first texts of one key the first in ``seq`` makes the record: the same text gets the same answer, another one a
    conflict (409), as nobody has seen the masked text yet. Restored records go over to the grace state. ``modes`` are those that the
    consumers' policies have; the fewer, the smaller the plan. First texts are masked once, into a table of the shared folder from which both answers and records come.
    """
    mode = F.col("masking_mode")
    policy = with_policy(requests, dimension)
    status = (
        F.when(F.coalesce(F.length("payload_id"), F.lit(0)) == 0, 422)
        .when(F.col("payload").isNull(), 422)
        .when(F.length("payload") > max_payload, status_of_error(F.lit("too_large")))
        .otherwise(status_of_error(F.col("error_category")))
    )
    judged = policy.withColumn("status", status)
    held = live(vault, now)
    told = answer(judged.where("status = 200").withColumn("allow_demask", F.col("demask")).drop("demask").withColumnRenamed("masking_mode", "asked_mode"), held, secret)
    fresh = told.where("way = 'mask'")
    turn = Window.partitionBy("payload_id").orderBy("seq")
    print_ = fingerprint(F.col("payload"), secret)
    ranked = fresh.withColumn("_print", print_).withColumn("_first", F.first("_print").over(turn)).withColumn("_n", F.row_number().over(turn))
    made = []
    for kind in modes:
        winners = ranked.where((F.col("_n") == 1) & (F.coalesce("asked_mode", F.lit("partial")) == kind)).select("payload_id", "payload", "mask_types", "allow_demask")
        names = only is None or "fio" in only
        out = masked(analyze(winners, "payload", only, mask_types=F.col("mask_types")), kind, "payload", session="payload_id", names=names)
        both = records(out.withColumn("_masked", F.col("masked_text")), "payload", now, F.col("allow_demask"), secret, also=("_masked",))
        made.append(both)
    masks = written(reduce(DataFrame.unionByName, made), "masked")
    first, new = masks.select("payload_id", "_masked"), masks.drop("_masked")
    firsts = ranked.join(first, "payload_id").withColumn("status", F.when(F.col("_print") == F.col("_first"), 200).otherwise(status_of_error(F.lit("conflict"))))
    fields = ["payload_id", "seq", "direction", "status", "result"]
    answers = firsts.withColumn("result", F.when(F.col("status") == 200, F.col("_masked"))).select(fields)
    known = told.where("way in ('retry_mask', 'echo', 'demask_exact')").withColumn("status", F.lit(200)).select(fields)
    reworded = told.where("way = 'demask_content'").withColumn("result", restored(F.col("payload"), F.col("mode"), F.col("mappings"))).withColumn("status", F.lit(200)).select(fields)
    null = F.lit(None).cast("string")
    refused = judged.where("status <> 200").select("payload_id", "seq", null.alias("direction"), "status", null.alias("result"))
    opened = told.where("way in ('demask_exact', 'demask_content')").select("payload_id")
    after = insert_if_absent(mark_demasked(held, opened, now), new, now)
    return answers.unionByName(known).unionByName(reworded).unionByName(refused), after


#: What a text shows that was masked before: a token, or stars in a row.
TRACES = r"<[A-Z_]+_\d+>|\*\*"


def without_vault(requests: DataFrame, secret: str | None = None) -> DataFrame:
    """Answers (status, result) where no record can be read: only texts that need none are echoed. One that may
    be a masked text, or that holds personal data, fails closed with 503."""
    found = masked(analyze(requests, "payload"), "partial", "payload")
    safe = (F.size("mappings") == 0) & ~F.col("payload").rlike(TRACES)
    return found.select(*requests.columns, F.when(safe, 200).otherwise(503).alias("status"), F.when(safe, F.col("payload")).alias("result"))


# HTTP status of each kind of error.
STATUS = {"not_found": 403, "disabled": 403, "conflict": 409, "unavailable": 503, "too_large": 413, "overloaded": 429}


def status_of_error(category: Column) -> Column:
    """200 without an error, 500 for one that is not listed. Error texts are never part of an answer."""
    out = F.when(category.isNull(), 200)
    for name, status in STATUS.items():
        out = out.when(category == name, status)
    return out.otherwise(500)


def exact_round_trip(done: DataFrame, text: str = "text") -> DataFrame:
    """``done``, from masked(), with ``restored_exactly``."""
    return done.withColumn("restored_exactly", put_back(F.col("masked_text"), F.col("occurrences"), True).eqNullSafe(F.col(text)))
