"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, in lower case (A-Z). Documents arrive in batches. A batch
becomes a run: its keys' hashes (128 bits) with the number of its documents that have them. Before that it is
merge-anti-joined with the settled run, the hashes that already occur in enough documents, so that a frequent line is counted no further. Runs
of a level stand in one bucketed table, sorted by hash in each bucket; once there are ``FANOUT`` of them they are compacted into one
run of the next level, and hashes that reach the threshold move to the settled run. The batch alone is shuffled (sums by hash); merges, compactions and
anti-joins meet the runs bucket by bucket, without a shuffle of them.

When all batches are in, the levels are compacted to the end, and documents lose the lines with settled keys. Places of such lines are
found by a join with the settled hashes, which are broadcast up to ``BROADCAST_ROWS`` rows and salted beyond; only the places are grouped by
document, not the lines, and a document's lines are cut out of its text by their places.

Only DataFrame functions are used. Defined results: a null or empty text has one empty line, which has no key and stays; a key counts once a document, however
often it occurs there; each row is a document, so that repeated rows count each; a document may lose all its lines and keep an empty text; very long texts are
read whole; an empty table gives an empty result. Other columns are carried under numbers of our own, so no name clashes, and one that has the name of a
result is replaced by it.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, boxed, saved, shared_dir, table, unboxed

THRESHOLD = 10
#: Runs of a level that are compacted into one of the next.
FANOUT = 4
#: Batches that the files of a table are dealt to.
BATCHES = 8
#: Parts that the lines of one key are dealt to where settled keys are too many to broadcast.
SALTS = 32
SPACE = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


class LineRuns:
    """Levelled sorted runs of line hashes in the shared folder. Batches are added one after another; a key is settled once ``threshold`` documents have it."""

    def __init__(self, spark: SparkSession, threshold: int = THRESHOLD, fanout: int = FANOUT):
        self.spark, self.threshold, self.fanout = spark, threshold, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.levels = f"line_runs_{uuid.uuid4().hex}", []  # runs at each level

    def _table(self, what: str) -> str:
        return f"{self.name}_{what}"

    def _append(self, rows: DataFrame, what: str) -> None:
        where = f"{shared_dir(self.spark)}/{self._table(what)}"
        rows.write.format("parquet").option("compression", "zstd").option("path", where).bucketBy(self.buckets, "h").sortBy("h").mode("append").saveAsTable(self._table(what))

    def _has(self, what: str) -> bool:
        return self.spark.catalog.tableExists(self._table(what))

    def _drop(self, what: str) -> None:
        if self._has(what):
            self.spark.sql(f"DROP TABLE {self._table(what)}")
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self.spark)}/{self._table(what)}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """One batch of documents: a run of the hashes that are not settled yet."""
        keys = F.array_distinct(F.transform(lines(F.col(text)), line_key))
        run = docs.select(F.explode(keys).alias("key")).where("key <> ''").select(_hash(F.col("key")).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
        if self._has("settled"):
            run = run.join(self.spark.table(self._table("settled")), "h", "left_anti")
        self._put(run, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append(0)
        self._append(run, f"level{level}")
        self.levels[level] += 1
        if self.levels[level] >= self.fanout:
            self._compact(level)

    def _merged(self, level: int) -> DataFrame:
        return self.spark.table(self._table(f"level{level}")).groupBy("h").agg(F.sum("n").alias("n"))

    def _compact(self, level: int) -> None:
        """All runs of a level become one of the next; hashes in enough documents become settled."""
        merged = self._merged(level)
        self._append(merged.where(F.col("n") >= self.threshold).select("h"), "settled")
        self._put(merged.where(F.col("n") < self.threshold), level + 1)
        self._drop(f"level{level}")
        self.levels[level] = 0

    def settled(self) -> DataFrame:
        """The hashes (h) of all keys in enough documents of all batches so far, as a table of their own; the runs of the levels go up to the last level
        and stay there, so that more batches may follow."""
        for level in range(len(self.levels) - 1):
            if self.levels[level]:
                self._compact(level)
        found = []
        if self._has("settled"):
            found.append(self.spark.table(self._table("settled")))
        if self.levels and self.levels[-1]:
            found.append(self._merged(len(self.levels) - 1).where(F.col("n") >= self.threshold).select("h"))
        if not found:
            return self.spark.createDataFrame([], "h binary")
        return saved((found[0].unionByName(found[1]) if len(found) > 1 else found[0]).distinct(), "settled-lines")

    def close(self) -> None:
        """Removes all runs."""
        for what in ("settled", *(f"level{k}" for k in range(len(self.levels)))):
            self._drop(what)


def without_lines(docs: DataFrame, settled: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the lines whose keys are settled; n_lines (before dropping) and n_dropped follow. The text of a null is empty."""
    added = ("n_lines", "n_dropped")
    rows = boxed(docs, text=text).withColumnRenamed(text, "_text")
    rows = rows.withColumn("_k", F.struct(F.xxhash64("row", "_text").alias("a"), F.xxhash64(F.lit("row"), "row", "_text").alias("b")))
    keys = F.transform(lines(F.col("_text")), line_key)
    places = rows.select("_k", F.posexplode(keys).alias("_at", "_key")).where("_key <> ''").select("_k", "_at", _hash(F.col("_key")).alias("h"))
    if settled.count() <= BROADCAST_ROWS:
        hits = places.join(F.broadcast(settled), "h")
    else:
        salted = settled.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = places.withColumn("_salt", F.pmod(F.col("_k.a"), F.lit(SALTS)).cast("int")).join(salted, ["h", "_salt"])
    # a set, as rows alike have one key; in order
    hits = hits.groupBy("_k").agg(F.sort_array(F.collect_set("_at")).alias("_gone"))
    both = rows.withColumn("_lines", lines(F.col("_text"))).join(hits, "_k", "left")

    def kept(x: Column) -> Column:
        """The lines between those that go."""
        begin = F.concat(F.array(F.lit(0)), F.transform(x["gone"], lambda p: p + 1))
        end = F.concat(x["gone"], F.array(F.size(x["lines"])))
        return F.array_join(F.flatten(F.zip_with(begin, end, lambda b, e: F.slice(x["lines"], b + 1, e - b))), "\n")

    cut = F.element_at(F.transform(F.array(F.struct(F.col("_lines").alias("lines"), F.col("_gone").alias("gone"))), kept), 1)
    done = both.select("row", F.coalesce(F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(cut), F.lit("")).alias(text), F.size("_lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_dropped"))
    return unboxed(done, docs, *added, without=added, text=text)


def _batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The files of ``documents``, in their order, as batches."""
    docs = table(spark, sf_dir, "documents")
    files = sorted(unquote(f) for f in docs.inputFiles())
    size = -(-len(files) // BATCHES)
    return [spark.read.schema(docs.schema).parquet(*files[i : i + size]) for i in range(0, len(files), max(size, 1))]


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = LineRuns(spark)
    for batch in _batches(spark, sf_dir):
        runs.add(batch)
    settled = runs.settled()
    runs.close()
    done = without_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), settled)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_SPACE_SQL = "||".join(f"chr({ord(c)})" for c in SPACE)
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_SPACE_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= {THRESHOLD}),
m AS (SELECT k.*, often.key IS NOT NULL AS gone FROM k LEFT JOIN often ON k.key = often.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY r
"""
