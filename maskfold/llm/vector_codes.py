"""Vector codes: a product quantiser of integer codebooks, with nearest entries found by VA-file filtering.

Components become integers, vectors are cut into ``PARTS`` equal parts, and each part position has a codebook of at most
``ENTRIES`` entries. Codebooks start as the parts of the rows with the smallest ids. Each of ``ROUNDS`` rounds assigns
every part to its nearest entry and moves each entry to the floor of its parts' mean; then all parts are assigned once more.

Nearest entries are found as in a VA-file. The coordinates of the entries are quantised to ``BITS`` bits a dimension: cells of
equally many entries, each from its least to its largest coordinate. For a part, a table by dimension and cell holds
the least and the largest squared distance of its coordinate to that cell; summed over the dimensions
they bound its distance to every entry from below and from above. Entries whose lower bound is over the smallest upper bound cannot be
nearest; only the rest are refined, by integer distances. The nearest is exact, and ties go to the lower index.

A round is one scan of the vectors. Each task sums what it has assigned, so that a task sends at most ``PARTS * ENTRIES`` rows
(part, entry, count, sums) to be added up; the codebooks, of a size that the parameters and the number of dimensions bound,
are all that reaches the driver and the executors. No vector is shuffled.

Defined results: rows whose vector is null or holds a null or a component that is no finite number are dropped. The length of vectors is that of the
row with the smallest id; rows of another length cannot be cut alike and are dropped as well, and a length that is no multiple of ``PARTS`` is filled
with zeros at the end. Integers stay within ``LARGEST``, so that sums of squares fit into 64 bits: larger components count as that. Null ids come last.
Of repeated ids, the lexically smaller vector comes first; repeated rows count as often as they occur, and get one code. With fewer than
``ENTRIES`` rows the codebooks have as many entries; an empty table gives an empty result. Null labels are one label. Other columns of the
table are not read, so no name clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, saved, scan, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BITS = 4
LARGEST = 1 << 28
#: Parts that are held against a codebook at once: two tables of so many by ``ENTRIES`` numbers.
AT_ONCE = 1 << 10
#: Parts that a label's rows are dealt to where labels are too many to broadcast.
SALTS = 32


def finite(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of each component, with zeros up to a multiple of PARTS: an array (rows, PARTS, length of a part)."""
    scaled = np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)
    scaled = np.pad(scaled, ((0, 0), (0, -scaled.shape[1] % PARTS)))
    return scaled.reshape(len(scaled), PARTS, -1)


class Cells:
    """A codebook (entries, dimensions) with the cells of its coordinates."""

    def __init__(self, book: np.ndarray, bits: int = BITS):
        self.book, (n, dims) = book, book.shape
        self.cells = min(n, 1 << bits)
        order = np.argsort(book, axis=0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
        self.cell = rank * self.cells // n  # (entries, dimensions)
        ranked = np.take_along_axis(book, order, axis=0)
        first = -(-np.arange(self.cells) * n // self.cells)
        last = np.append(first[1:], n) - 1
        self.low, self.high = ranked[first], ranked[last]  # (cells, dimensions)
        assert dims == self.low.shape[1]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of each row of x to each entry, as (entries, rows): a cell's line of a table is taken whole for each entry in it."""
        widest = max(int(np.abs(self.high - x.min(axis=0)).max()), int(np.abs(x.max(axis=0) - self.low).max())) if x.size else 0
        # 32 bits where the sums fit into them
        kind = np.int32 if widest * widest * max(1, x.shape[1]) < 1 << 31 else np.int64
        low, high, x = self.low.astype(kind), self.high.astype(kind), np.ascontiguousarray(x.T.astype(kind))
        under = np.zeros((len(self.book), x.shape[1]), kind)
        over = np.zeros_like(under)
        for j in range(len(x)):
            below, above = low[:, j, None] - x[j], x[j] - high[:, j, None]
            least = np.maximum(np.maximum(below, above), 0)
            most = np.maximum(np.abs(below), np.abs(above))
            under += (least * least)[self.cell[:, j]]
            over += (most * most)[self.cell[:, j]]
        return under, over

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of x, of equally near ones the first, and its squared distance."""
        index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for i in range(0, len(x), AT_ONCE):
            part = x[i : i + AT_ONCE]
            under, over = self.bounds(part)
            near = np.ascontiguousarray((under <= over.min(axis=0)).T)
            row, entry = np.nonzero(near)  # in order of rows, then entries; at least one each
            exact = ((part[row] - self.book[entry]) ** 2).sum(axis=1)
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            best = np.minimum.reduceat(exact, begin)
            first = np.minimum.reduceat(np.where(exact == best[row], entry, len(self.book)), begin)
            index[i : i + len(part)], distance[i : i + len(part)] = first, best
        return index, distance


def _vectors(batch: pa.RecordBatch, length: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("vector"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), length)


def _kept(rows: DataFrame, length: int) -> DataFrame:
    return rows.where(finite(F.col("vector")) & (F.size("vector") == length))


def initial(rows: DataFrame, entries: int = ENTRIES) -> tuple[np.ndarray, int]:
    """The first codebooks (PARTS, entries, length of a part), from the rows (vec_id, vector) with the smallest ids, and the vectors' length."""
    order = (F.col("vec_id").asc_nulls_last(), F.col("vector"))
    good = rows.where(finite(F.col("vector"))).select("vec_id", "vector")
    first = good.orderBy(*order).limit(1).collect()
    if not first:
        return np.zeros((PARTS, 0, 0), np.int64), 0
    length = len(first[0].vector)
    seeds = [r.vector for r in _kept(good, length).orderBy(*order).limit(entries).collect()]
    return np.ascontiguousarray(integers(np.array(seeds, np.float64).reshape(len(seeds), length)).transpose(1, 0, 2)), length


def moved(rows: DataFrame, books: np.ndarray, length: int) -> np.ndarray:
    """The codebooks after one round: each entry becomes the floor of the mean of the parts that are nearest to it; unused entries stay."""
    n, dims = books.shape[1:]
    names = [f"s{j}" for j in range(dims)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        count, total = np.zeros((PARTS, n), np.int64), np.zeros((PARTS, n, dims), np.int64)
        for batch in batches:
            x = integers(_vectors(batch, length))
            for p in range(PARTS):
                index, _ = cells[p].nearest(x[:, p])
                count[p] += np.bincount(index, minlength=n)
                order = np.argsort(index, kind="stable")
                if len(order):
                    begin = np.flatnonzero(np.append(True, np.diff(index[order]) != 0))
                    total[p, index[order][begin]] += np.add.reduceat(x[order, p], begin, axis=0)
        part, entry = np.nonzero(count)
        columns = [part, entry, count[part, entry], *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], ["part", "entry", "n", *names])

    schema = ", ".join(f"{c} long" for c in ("part", "entry", "n", *names))
    found = scan(_kept(rows, length).select("vector"), sums, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    out = books.copy()
    for r in found.collect():  # at most PARTS * ENTRIES rows
        out[r.part, r.entry] = [r[c] // r.n for c in names]
    return out


def codebooks(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[np.ndarray, int]:
    """The codebooks after all rounds, and the vectors' length, for rows (vec_id, vector)."""
    books, length = initial(rows, entries)
    for _ in range(rounds if books.size else 0):
        books = moved(rows, books, length)
    return books, length


def codebooks_hash(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(rows: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """(vec_id, label, code, error) for rows (vec_id, vector, label)."""
    kinds = dict(rows.dtypes)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in batches:
            x = integers(_vectors(batch, length))
            found = [cells[p].nearest(x[:, p]) for p in range(PARTS)] if books.shape[1] else []
            index = np.stack([i for i, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            error = sum(d for _, d in found)
            texts = [index[2 * PARTS * i : 2 * PARTS * (i + 1)] for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return scan(_kept(rows, length).select("vec_id", "label", "vector"), codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compressed(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) for rows (vec_id, vector, label)."""
    rows = rows.select("vec_id", "vector", "label")
    books, length = codebooks(rows, rounds)
    out = saved(coded(rows, books, length), "codes")
    labels = saved(out.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    if labels.count() <= BROADCAST_ROWS:
        out = out.join(F.broadcast(labels), F.col("label").eqNullSafe(F.col("_label")))
    else:
        labels = labels.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.join(labels, F.col("label").eqNullSafe(F.col("_label")) & (F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)) == F.col("_salt")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(codebooks_hash(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return compressed(rows).drop("label")


def _rounds_sql() -> str:
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
d{k} AS (SELECT r, p, e, sum((x - y) * (x - y))::BIGINT AS d FROM parts JOIN b{k} USING (p, j) GROUP BY r, p, e),
n{k} AS (SELECT r, p, min(d) AS d, arg_min(e, d * {ENTRIES} + e) AS e FROM d{k} GROUP BY r, p)""")
        if k < ROUNDS:
            steps.append(f"""
m{k} AS (SELECT p, e, j, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM parts JOIN n{k} USING (r, p) GROUP BY p, e, j),
b{k + 1} AS (SELECT p, e, j, coalesce((s - ((s % n) + n) % n) // n, y)::BIGINT AS y FROM b{k} LEFT JOIN m{k} USING (p, e, j))""")
    return ",".join(steps)


ORACLE_SQL = f"""
WITH good AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, j // (size // {PARTS}) AS p, j % (size // {PARTS}) AS j, floor({SCALE} * x::DOUBLE)::BIGINT AS x
  FROM (SELECT r, len(embedding) AS size, unnest(embedding) AS x, unnest(range(len(embedding))) AS j FROM good)),
b0 AS (SELECT p, r AS e, j, x AS y FROM parts WHERE r < {ENTRIES}),{_rounds_sql()},
codes AS (SELECT r, string_agg(substr('0123456789abcdef', (e // 16 + 1)::INT, 1) || substr('0123456789abcdef', (e % 16 + 1)::INT, 1), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM n{ROUNDS} GROUP BY r),
books AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM good JOIN codes USING (r), books
"""
