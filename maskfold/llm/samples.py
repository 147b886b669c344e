"""Labelled rows for the classifiers: which rows may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; rows without an id are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled(labels: DataFrame, label: str, rows: int, folds: int, fold: int, balanced: bool = False) -> DataFrame:
    """At most ``rows`` rows (doc_id, y) outside the held-out fold, those whose ids have the smallest hashes.

    An id with several labels gets the one that most of them say, 1 in a tie; null ids and labels are not used.
    ``balanced`` takes half of the rows from each label, as far as there are so many.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    if not balanced:
        return known.orderBy(*order).limit(rows)
    return known.where("y = 1").orderBy(*order).limit(rows // 2).unionByName(known.where("y = 0").orderBy(*order).limit(rows // 2))


def texts_of(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, y) of the sampled ids, one row each: of several texts with one id the last in order. ``sample`` is from
    :func:`labelled`, so its size is bounded and it is broadcast."""
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.max("text").alias("text"))
