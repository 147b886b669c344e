"""A corpus pipeline: quality rules, near duplicates, repeated passages, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as
Parquet to the shared folder and read back. All stages but the last keep the columns of documents.
No SQL can express the whole (components and repeated byte strings), so the tests hold it against
brute force instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskfold.llm import decontaminate, mixing, near_dedup, quality_rules, substring_dedup
from maskfold.llm.common import remove, saved, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.keep(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes and more that occur elsewhere are cut out."""
    return substring_dedup.removed(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is taken up to its target: the documents with a part in the mix, with size, source_size,
    target, epochs and taken (words, repeats counted; the one document that a budget cuts gives its first words)."""
    return mixing.mixed(docs).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("mixing", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"pipeline-{name}")
            remove(spark, before)  # the stage's input, if it was a table of ours
    return docs
