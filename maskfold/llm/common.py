"""Shared folder, tables, scans and row keys used by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most that an Arrow batch between Spark and Python may hold. Texts vary from a word to a book, so that a
#: count of rows alone bounds nothing.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(df: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes. The session's own limits stay where they are lower."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = conf.get(key).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(key, str(most))
    return df.mapInArrow(function, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver see.

    It is the cluster's ``spark.checkpoint.dir``. Only in local mode, where one machine
    runs everything, is a folder of our own used if that setting is missing.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/maskfold"


def write(df: DataFrame, what: str) -> str:
    """Write ``df`` to the shared folder and return the path: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    schema, spark = df.schema, df.sparkSession
    path = write(df, what)
    out = spark.read.schema(schema).parquet(path)
    out._saved_at = path
    return out


def remove(spark: SparkSession, *frames: DataFrame | None) -> None:
    """Delete tables made by :func:`saved` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name in {getattr(df, "_saved_at", None) for df in frames} - {None}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done. It does so only once its driver has collected
    the garbage, which a short job may never do by itself while the files of each phase add up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def boxed(docs: DataFrame, *need: str, text: str = "text", extra: tuple[Column, ...] = ()) -> DataFrame:
    """The caller's rows as ``row`` (a struct of all columns but the text, by number), ``text``, the columns
    ``need`` and the expressions ``extra``. What an operator adds can then clash with no column of the caller's, and the text is carried once."""
    others = [c for c in docs.columns if c != text]
    row = F.struct(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(others)], F.lit(True).alias("is"))
    return docs.select(row.alias("row"), *[F.col(quoted(c)) for c in dict.fromkeys((text, *need))], *extra)


def unboxed(df: DataFrame, like: DataFrame, *more: Column | str, without: tuple[str, ...] = (), text: str = "text", **instead: Column) -> DataFrame:
    """The caller's columns, in the order of ``like``, from rows of :func:`boxed`, and then ``more``. Columns of ``like`` in
    ``without`` are left out; those named in ``instead`` are computed."""
    others = [c for c in like.columns if c != text]
    value = {c: F.col(f"row.c{k}") for k, c in enumerate(others)} | {text: F.col(text)} | instead
    return df.select(*[value[c].alias(c) for c in like.columns if c not in without], *more)


def with_lengths(df: DataFrame, like: DataFrame) -> DataFrame:
    """:func:`unboxed` for rows whose text is ``new`` or not: n_chars, where there is such a number, is that of a new text."""
    length = {f.name: f.dataType for f in like.schema.fields}.get("n_chars")
    if not isinstance(length, T.NumericType):
        return unboxed(df, like)
    old = F.col(f"row.c{[c for c in like.columns if c != 'text'].index('n_chars')}")
    return unboxed(df, like, n_chars=F.when(F.col("new") & old.isNotNull(), F.char_length("text").cast(length)).otherwise(old))


def row_key(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_th``, a hash of the text. (doc_id, _th) names a row by its content, so that it
    is the same after a task is run again; rows with both equal get equal results."""
    return df.withColumn("_th", F.xxhash64(F.col(text)))


#: Rows that a broadcast side may have; each is a few short columns, so some tens of MB at most.
BROADCAST_ROWS = 200_000


def lookup(big: DataFrame, small: DataFrame, keys: list[str], rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join on keys where null equals null. ``small`` has a row for each key and must be cheap to
    count: it is broadcast up to ``rows`` rows, and beyond that joined by a shuffle."""
    renamed = small.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    if small.count() <= rows:
        renamed = F.broadcast(renamed)
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return big.join(renamed, on, "left").drop(*[f"_k_{k}" for k in keys])
