"""The record that makes masking reversible, as a table keyed by payload_id. It never holds a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import fingerprint
from ..operators.mask import OCCURRENCE, put_back
from ..operators.entities import MAPPING

VERSION = 2
ACTIVE, GRACE = "ACTIVE", "DEMASKED_GRACE"
TTL_SECONDS, GRACE_SECONDS = 600, 60
RECORD = (
    "version int, state string, mode string, original_fingerprint string, transformed_fingerprint string, no_pii boolean, demask_enabled boolean,"
    f" mappings array<{MAPPING}>, occurrences array<{OCCURRENCE}>, created_at timestamp, demasked_at timestamp, expires_at timestamp"
)


def records(masked: DataFrame, text: str, now: Column, demask: Column | None = None, secret: str | None = None, ttl: int = TTL_SECONDS, also: tuple[str, ...] = ()) -> DataFrame:
    """payload_id and record columns for masked documents that have a payload_id; and columns ``also`` of theirs."""
    return masked.select(
        "payload_id", F.lit(VERSION).alias("version"), F.lit(ACTIVE).alias("state"), "mode", fingerprint(F.col(text), secret).alias("original_fingerprint"),
        fingerprint(F.col("masked_text"), secret).alias("transformed_fingerprint"), (F.size("mappings") == 0).alias("no_pii"), (F.lit(True) if demask is None else demask).alias("demask_enabled"),
        "mappings", "occurrences", now.alias("created_at"), F.lit(None).cast("timestamp").alias("demasked_at"), (now + F.make_dt_interval(secs=F.lit(ttl))).alias("expires_at"), *also,
    )


def live(vault: DataFrame, now: Column) -> DataFrame:
    """Records that have not expired; those that expire at this moment have."""
    return vault.where(F.col("expires_at") > now)


def insert_if_absent(vault: DataFrame, new: DataFrame, now: Column, order: str = "created_at") -> DataFrame:
    """The vault with the records of keys that no live record has; of new records with one key the earliest wins, expired ones are replaced."""
    held = live(vault, now)
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy("payload_id").orderBy(order, "original_fingerprint"))).where("_n = 1").drop("_n")
    return held.unionByName(first.join(held.select("payload_id"), "payload_id", "left_anti"))


def mark_demasked(vault: DataFrame, payload_ids: DataFrame, now: Column, grace: int = GRACE_SECONDS) -> DataFrame:
    """Records of these keys go over to the grace state once; further retries do not prolong it."""
    hit = vault.join(payload_ids.select("payload_id").distinct().withColumn("_hit", F.lit(True)), "payload_id", "left")
    turn = F.col("_hit").isNotNull() & (F.col("state") == ACTIVE)
    return hit.withColumn("expires_at", F.when(turn, now + F.make_dt_interval(secs=F.lit(grace))).otherwise(F.col("expires_at"))).withColumn("demasked_at", F.when(turn, now).otherwise(F.col("demasked_at"))).withColumn("state", F.when(turn, GRACE).otherwise(F.col("state"))).drop("_hit")


def answer(requests: DataFrame, vault: DataFrame, secret: str | None = None) -> DataFrame:
    """``requests`` (payload_id, payload, allow_demask) with ``direction`` and, where the record alone gives it, ``result``.

    No record: mask. The original again: the same masked text. Demasking off: the text as it is. The masked text: the
    original by its spans. Anything else: content demask, whose result needs the mappings (``mode``, ``mappings`` come along).
    """
    r = vault.select("payload_id", "original_fingerprint", "transformed_fingerprint", "demask_enabled", "mode", "mappings", "occurrences")
    j = requests.join(r, "payload_id", "left").withColumn("_fp", fingerprint(F.col("payload"), secret))
    way = (
        F.when(F.col("original_fingerprint").isNull(), "mask")
        .when(F.col("_fp") == F.col("original_fingerprint"), "retry_mask")
        .when(~F.col("demask_enabled") | ~F.col("allow_demask"), "echo")
        .when(F.col("_fp") == F.col("transformed_fingerprint"), "demask_exact")
        .otherwise("demask_content")
    )
    j = j.withColumn("way", way)
    result = (
        F.when(F.col("way") == "retry_mask", put_back(F.col("payload"), F.col("occurrences"), False))
        .when(F.col("way") == "echo", F.col("payload"))
        .when(F.col("way") == "demask_exact", put_back(F.col("payload"), F.col("occurrences"), True))
    )
    direction = F.when(F.col("way").isin("mask", "retry_mask"), F.col("way")).otherwise("demask")
    return j.select(*requests.columns, "way", direction.alias("direction"), result.alias("result"), "mode", "mappings")
