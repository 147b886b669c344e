"""Mixing sources to target weights by exponential keys.

Every document gets the key -ln(u) / w of weighted sampling without replacement: u in (0, 1] is a hash
of its id and text, w its quality weight. A source's target is filled by complete epochs of the source first; the
fraction that remains goes to the smallest keys, by a running sum of sizes up to the token budget.

The running sum is made in two steps so that no source is sorted in one task: sizes are summed by source
and by bucket of the key, running sums over the buckets find the one that the budget cuts, and only
that bucket is sorted. The document that the budget cuts gives just the words that are missing.

Only DataFrame functions are used. Defined results: a null text has no words and none are taken; very long texts count
whole; a null source is a source of its own, the last; repeated rows have one key and go in an order that rows alike
cannot tell (as do equal keys, by doc_id and size); an empty table gives an empty result; other columns are carried under numbers of our
own, so no name clashes, and one that has the name of a result is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import boxed, lookup, saved, table, unboxed

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
#: Rows that a bucket of keys has on average, so that a task can sort the one that a budget cuts; and buckets at least.
BUCKET_ROWS, LEAST_BUCKETS = 10_000, 4096
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def quality_weight(text: Column) -> Column:
    """From 1/4 to 1: the share of characters that are none of ``#*$%&|<>``, squared twice."""
    length = F.length(text)
    fine = F.length(F.regexp_replace(text, "[#*$%&|<>]+", "")) / F.greatest(length, F.lit(1))
    return F.coalesce(F.lit(0.25) + F.lit(0.75) * (fine * fine * fine * fine), F.lit(0.25))


def uniform(doc_id: Column, text: Column) -> Column:
    """In (0, 1]: 52 bits of a hash of id and text."""
    digest = F.md5(F.concat_ws(":", doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 1) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size and target for a table of one row a source (source, source_size).

    Targets are min(most * size, level * weight) with the level at which they sum up to the share: it is the
    level that holds once the sources with the least room for their weight are full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("weight", F.element_at(kinds, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("room", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("room", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(percent) / F.lit(100.0))
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", (F.col("budget") - F.col("full")) / F.col("left"))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("room"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("room") <= F.col("level")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, weight: Column | None = None, carry_text: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target, epochs and taken.

    ``weight`` is a positive column of ``docs``, the document's quality weight. Columns of the results' names are replaced.
    """
    added = ("size", "source_size", "target", "epochs", "taken")
    weight = quality_weight(F.col("text")) if weight is None else weight
    rows = boxed(docs, "doc_id", "source", extra=(weight.alias("weight"),))
    key = -F.ln(uniform(F.col("doc_id"), F.col("text"))) / F.col("weight")
    sized = rows.withColumn("size", n_words(F.col("text"))).withColumn("key", key).drop("weight")
    sized = saved(sized if carry_text else sized.drop("text"), "sized")
    buckets = max(LEAST_BUCKETS, sized.count() // BUCKET_ROWS)
    sized = sized.withColumn("bucket", F.floor(F.col("key") / (F.col("key") + 1) * buckets).cast("int"))
    cells = saved(sized.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "cells")
    plan = targets(cells.groupBy("source").agg(F.sum("n").alias("source_size")))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
    plan = saved(plan.withColumn("budget", F.round("target").cast("bigint") - F.col("epochs") * F.col("source_size")), "plan")
    # the bucket of each source that its budget cuts
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    run = cells.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    cuts = lookup(run, plan.select("source", "budget"), ["source"]).where("before < budget and before + n >= budget")
    cuts = cuts.groupBy("source").agg(F.min("bucket").alias("cut"), F.min_by("before", "bucket").alias("cut_before"))
    placed = lookup(sized, saved(lookup(plan, saved(cuts, "cuts"), ["source"]), "plan"), ["source"])
    apart = placed.where("not (bucket <=> cut)").withColumn("extra", F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("cut_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    edge = placed.where("bucket <=> cut").withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - so_far)))
    both = apart.unionByName(edge).withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))
    return unboxed(both, docs, *added, without=added if carry_text else (*added, "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs, carry_text=False).select("doc_id", "size", "source_size", "target", "taken")


_KINDS = "[" + ", ".join(map(str, WEIGHTS)) + "]"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, text IS NULL AS missing FROM documents),
h AS (SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  (('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, md5(t))), 1, 13))::BIGINT + 1) / {float(1 << 52)!r}::DOUBLE AS u,
  CASE WHEN missing THEN 0.0::DOUBLE ELSE length(regexp_replace(t, '[#*$%&|<>]+', '', 'g'))::DOUBLE / greatest(length(t), 1) END AS f FROM d),
k AS (SELECT *, -ln(u) / (0.25::DOUBLE + 0.75::DOUBLE * (f * f * f * f)) AS key FROM h),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, {_KINDS}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT]::BIGINT AS weight, {MAX_EPOCHS} * source_size AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / weight AS room, sum(source_size) OVER ()::DOUBLE * {SHARE_PERCENT} / 100 AS budget, sum(weight) OVER () AS all_weights FROM w),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER o, 0)::DOUBLE) / (all_weights - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM r WINDOW o AS (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, max(CASE WHEN level <= room THEN level END) OVER () AS lv FROM l),
p AS (SELECT source, source_size, CASE WHEN lv IS NULL OR room <= lv THEN cap::DOUBLE ELSE lv * weight END AS target FROM m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM p),
b AS (SELECT *, round(target)::BIGINT - epochs * source_size AS budget FROM e),
c AS (SELECT k.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM k)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken
FROM c JOIN b ON b.source IS NOT DISTINCT FROM c.source
"""
