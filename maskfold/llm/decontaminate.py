"""Benchmark decontamination by n-grams of words.

The benchmark's windows of ten normalised words are hashed on the executors, one entry for each distinct window with the
list of its items, and broadcast as sorted arrays; a scan of the documents rolls a hash over the same windows, looks it
up and compares the words of each hit. Nothing of the documents is shuffled. The broadcast has a checked size: windows are dealt
into blocks of at most ``BLOCK_BYTES`` and every block is scanned against all documents.

Defined results: a null text or item has no words and no windows; an item of one to nine words is
one window; an item without an id still marks words but is not listed; items with equal ids count
once; very long texts are scanned whole; windows that overlap or tie all count; repeated documents get equal results; empty tables give no hits
or no rows; other columns are carried under numbers of our own, so no name clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import boxed, saved, scan, table, unboxed, with_lengths

WINDOW = 10
#: Bytes of one broadcast: words, items and 40 more for each window.
BLOCK_BYTES = 64 << 20

_HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_from", T.ArrayType(T.IntegerType())),  # words, [from, to)
    T.StructField("hit_to", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.LongType())),
])


class Windows:
    """A block of benchmark windows: for each length in words the sorted hashes, and for each place in that order
    the window's words and items, both as slices of flat arrays."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("size", "ascending"), ("hash", "ascending")])
        flat = lambda name: rows.column(name).combine_chunks()
        self.hash = flat("hash").to_numpy().view(np.uint64)
        self.words = flat("words").cast(pa.large_binary())
        self.items = flat("items").cast(pa.large_list(pa.int64()))
        size = flat("size").to_numpy()
        # signed order of hashes, as rows were sorted, is not that of unsigned ones
        self.by = {}
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            order = np.argsort(self.hash[at], kind="stable")
            self.by[int(n)] = (self.hash[at][order], at[order])

    def of(self, size: int, first: int, words: bytes) -> int | None:
        """The window with these words, looked for from place ``first`` of its hash on."""
        known, at = self.by[size]
        for k in range(first, len(known)):
            if known[k] != known[first]:
                return None
            if self.words[int(at[k])].as_py() == words:
                return int(at[k])
        return None


def _hashes(data: np.ndarray, at: np.ndarray) -> tuple[tuple, np.ndarray]:
    spans = tk.word_spans(data, at, tk.ALNUM_LOWER)
    return spans, tk.span_hash(data, *spans[:2])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """words (lower case, joined by one space), size, hash and items of each distinct window."""
    schema = "item_id bigint, words binary, size int, hash bigint"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = tk.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
                (start, end, _), h = _hashes(data, np.array([0, len(data)]))
                size = min(window, len(h))
                hashes = tk.window_hash(h, size) if size else ()
                for i, x in enumerate(hashes):
                    rows.append((item, b" ".join(data[s:e].tobytes() for s, e in zip(start[i : i + size], end[i : i + size], strict=True)), size, int(np.int64(x))))
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["item_id", "words", "size", "hash"])

    found = scan(benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text"), cut, schema)
    return found.groupBy("words", "size", "hash").agg(F.collect_set("item_id").alias("items"))


def _blocks(benchmark: DataFrame, window: int, limit: int) -> Iterator[Broadcast]:
    """Broadcasts of some ``limit`` bytes each, gathered block by block."""
    spark = benchmark.sparkSession
    windows = saved(benchmark_windows(benchmark, window), "windows")
    bytes_of = F.octet_length("words") + 8 * F.size("items") + 40
    total = windows.agg(F.coalesce(F.sum(bytes_of), F.lit(0)).alias("n")).first().n
    n = -(-max(1, total) // max(1, limit // 2))
    for k in range(n):
        part = windows.where(F.pmod(F.xxhash64("words"), F.lit(n)) == k) if n > 1 else windows
        yield spark.sparkContext.broadcast(Windows(part.toArrow()))


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    change = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def find_hits(text: pa.Array, windows: Windows) -> dict[str, list]:
    """For each text: words, ranges of words inside benchmark windows, and the ids of their items."""
    data, at = tk.utf8(text)
    out: dict[str, list] = {f.name: [] for f in _HITS}
    for i, j in tk.slices(at):
        piece, ends = tk.LOWER[data[at[i] : at[j]]], at[i : j + 1] - at[i]
        (start, end, doc), h = _hashes(piece, ends)
        n = np.bincount(doc, minlength=j - i)
        hit = np.zeros(len(doc), bool)
        seen: dict[int, set] = {}
        for size, (known, _) in windows.by.items():
            rolled = tk.window_hash(h, size)
            place = np.minimum(np.searchsorted(known, rolled), len(known) - 1)
            starts = np.flatnonzero((known[place] == rolled) & tk.windows_inside(doc, size))
            sure = []
            for k in starts:
                words = b" ".join(piece[start[x] : end[x]].tobytes() for x in range(k, k + size))
                if (w := windows.of(size, int(place[k]), words)) is not None:
                    sure.append(k)
                    seen.setdefault(int(doc[k]), set()).add(w)
            if sure:
                hit |= tk.covered(np.array(sure), size, len(doc))
        items = {d: {x for w in ws for x in windows.items[w].as_py()} for d, ws in seen.items()}
        first = np.concatenate([[0], np.cumsum(n)])
        for k in range(j - i):
            a, b = _ranges(hit[first[k] : first[k + 1]]) if k in items or hit[first[k] : first[k + 1]].any() else ((), ())
            out["n_words"].append(int(n[k]))
            out["hit_from"].append(list(map(int, a)))
            out["hit_to"].append(list(map(int, b)))
            out["items"].append(sorted(items.get(k, ())))
    return out


def _hit(docs: DataFrame, benchmark: DataFrame, window: int, block: int) -> DataFrame:
    """row, text and hits (n_words, hit_from and hit_to in words, items)."""
    rows = boxed(docs)
    schema = T.StructType([*rows.schema.fields, T.StructField("hits", _HITS)])
    for k, windows in enumerate(_blocks(benchmark, window, block)):

        def look(batches: Iterator[pa.RecordBatch], windows=windows, again=k > 0) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = find_hits(b.column("text"), windows.value)
                if again:
                    old = b.column("hits").to_pylist()
                    merged = [_merged(o, {c: v[i] for c, v in found.items()}) for i, o in enumerate(old)]
                    found = {c: [m[c] for m in merged] for c in found}
                kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
                hits = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(found.values(), kinds, strict=True)], names=list(found))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), hits], names=schema.names)

        rows = scan(rows, look, schema)
    return rows


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with column ``_hits``: n_words, hit_from, hit_to (ranges of words) and items; a column of that name is replaced."""
    return unboxed(_hit(docs, benchmark, window, block), docs, F.col("hits").alias("_hits"), without=("_hits",))


def _merged(a: dict, b: dict) -> dict:
    flags = np.zeros(a["n_words"], bool)
    for x in (a, b):
        for s, e in zip(x["hit_from"], x["hit_to"], strict=True):
            flags[s:e] = True
    s, e = _ranges(flags)
    return {"n_words": a["n_words"], "hit_from": list(map(int, s)), "hit_to": list(map(int, e)), "items": sorted({*a["items"], *b["items"]})}


def decontaminate(docs: DataFrame, benchmark: DataFrame, drop_share: float = 0.5, window: int = WINDOW, block: int = BLOCK_BYTES) -> DataFrame:
    """Cuts the words inside benchmark windows out of the texts; a document of which more than
    ``drop_share`` of the words were hit goes as a whole. Columns stay as they are, but n_chars follows a text that is cut."""
    hit = _hit(docs, benchmark, window, block)
    n_hit = F.aggregate(F.zip_with("hits.hit_from", "hits.hit_to", lambda a, b: b - a), F.lit(0), lambda s, x: s + x)
    kept = hit.where(n_hit <= F.lit(drop_share) * F.greatest(F.col("hits.n_words"), F.lit(1)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, hits = b.column("text").to_pylist(), b.column("hits").to_pylist()
            texts = [cut_words(t, h["hit_from"], h["hit_to"]) if h["hit_from"] else t for t, h in zip(texts, hits, strict=True)]
            new = pa.array([bool(h["hit_from"]) for h in hits], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), new], names=["row", "text", "new"])

    schema = T.StructType([*hit.schema.fields[:2], T.StructField("new", T.BooleanType())])
    return with_lengths(scan(kept, cut, schema), docs)


def cut_words(text: str, hit_from: list[int], hit_to: list[int]) -> str:
    """Text without the words of the ranges and what lies between the words of one range."""
    raw = text.encode()
    start, end, _ = tk.word_spans(tk.LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), tk.ALNUM_LOWER)
    parts, at = [], 0
    for a, b in zip(hit_from, hit_to, strict=True):
        parts.append(raw[at : start[a]])
        at = end[b - 1]
    return b"".join([*parts, raw[at:]]).decode()


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = with_hits(docs, table(spark, sf_dir, "benchmark")).drop("text")
    n_hit = F.aggregate(F.zip_with("_hits.hit_from", "_hits.hit_to", lambda a, b: (b - a).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    items = F.array_join(F.array_sort(F.transform("_hits.items", lambda x: x.cast("string"))), ",")
    return hit.select("doc_id", "_hits.n_words", n_hit.alias("n_hit"), F.size("_hits.items").cast("bigint").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def items_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _FOLD.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(ws[i : i + least(len(ws), {WINDOW}) - 1], ' ') AS words
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), {WINDOW}) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(ws[i : i + n - 1], ' ') AS words
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT r, dw.n, i, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.words = dw.words),
cov AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(n)) AS k FROM hits) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN it USING (r)
"""
