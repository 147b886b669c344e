"""Records as JSON, for stores that hold one text a key: with the version of their fields, and read by an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vault import RECORD, VERSION

def encoded(vault: DataFrame) -> DataFrame:
    """(payload_id, body): each record as one JSON text, nulls left out."""
    fields = [c for c in vault.columns if c != "payload_id"]
    return vault.select("payload_id", F.to_json(F.struct(*fields)).alias("body"))


def decoded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) from (payload_id, body). A record without a version is of the first one, which knew no switch for restoring: it may be restored. Texts that are no
    record and records of a later version come back as rejects (payload_id, body, error), and no later reader takes them for something else."""
    read = rows.withColumn("_r", F.from_json("body", RECORD))
    version = F.coalesce(F.col("_r.version"), F.lit(1))
    error = F.when(F.col("_r").isNull() | F.col("_r.original_fingerprint").isNull(), "not_a_record").when(version > VERSION, "unsupported_version")
    judged = read.withColumn("_error", error)
    good = judged.where(F.col("_error").isNull()).select("payload_id", "_r.*")
    good = good.withColumn("version", F.lit(VERSION)).withColumn("demask_enabled", F.coalesce("demask_enabled", F.lit(True)))
    return good, judged.where(F.col("_error").isNotNull()).select("payload_id", "body", F.col("_error").alias("error"))
