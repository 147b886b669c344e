"""Exact removal of long repeated substrings, after a depth-limited radix sort of suffixes.

Only suffixes that agree in their first ``LENGTH`` bytes matter, so they are sorted no deeper, and only
by equality of digits: each pass splits the groups of the pass before by the next digit and drops
groups of one. What is left after the last pass are exactly the repeated windows.

* First digit: the anchor, the leftmost least of the hashes of the ``ANCHOR``-byte strings in the window.
  It depends on the window's bytes alone, so equal windows have equal anchors, and neighbouring
  windows share one: a run of windows goes as one row, about one for 85 bytes of text. This pass only drops groups of one: nothing is taken for
  equal because of it.
* Second digit: the bytes of the whole run, as 128 bits of their SHA-256. Runs equal in it are repeated as they stand.
* Third digit, for one run of each kind whose anchor also occurs in other runs (the borders of repeated
  passages): runs are cut into segments of ``SEGMENT`` windows at fixed distances from the anchor; the
  digit is the bytes that all windows of a segment share, again by SHA-256.
* Last digit: the few bytes to the left and right of those that each window has for itself, as they are. They travel with
  the segment, so the texts need not be read again.

A group's size is found by a count that starts in each task, so a passage of a third of all
documents is no hot key. Texts are joined by their rows, never by what they share. Very long texts are gone through in pieces
that overlap by a window; a run that a piece cuts is settled by its segments.

Defined results: null is an empty text; a text shorter than ``LENGTH`` loses nothing; matches never
cross rows; repeated rows (even with equal ids) repeat each other and lose all windows; of equal hashes the leftmost is the anchor; an empty table gives
an empty result; other columns are carried under numbers of our own, so no name clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import boxed, release, remove, row_key, saved, scan, table, unboxed, with_lengths

LENGTH = 200
ANCHOR = 32
SEGMENT = 16
#: Bytes of a text that are gone through at once; positions in such a piece have fewer bits than this.
PIECE = 1 << 20
_POSITION_BITS = np.uint64(24)
_GRAM = 8

#: place: start of the first window * 2**32 + (windows - 1) * 2**16 + distance from that start to the anchor.
_RUN = [T.StructField(n, T.LongType()) for n in ("place", "anchor", "run", "run2")]
_SEGMENT = [
    T.StructField("start", T.LongType()),  # of the segment, whether or not the run has that window
    T.StructField("low", T.IntegerType()),  # first and last window that the run has, from there
    T.StructField("high", T.IntegerType()),
    T.StructField("single", T.BooleanType()),
    T.StructField("block", T.IntegerType()),  # which segment it is, counted from the anchor
    T.StructField("core", T.LongType()),
    T.StructField("core2", T.LongType()),
    T.StructField("left", T.BinaryType()),
    T.StructField("right", T.BinaryType()),
]


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of the SHA-256 of each string, as two numbers."""
    view = memoryview(np.ascontiguousarray(data))
    found = b"".join([hashlib.sha256(view[a:b]).digest()[:16] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def _anchor_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position: the sum of the hashes of the short strings in them. It only picks anchors."""
    gram = min(_GRAM, size)
    n = len(data) - gram + 1
    value = np.zeros(n, np.uint64)
    for k in range(gram):
        value = value << np.uint64(8) | data[k : k + n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tk.mix(value + np.uint64(1)), out=sums[1:])
    width = size - gram + 1
    return tk.mix(sums[width:] - sums[:-width])


def runs_of(data: np.ndarray, at: np.ndarray, length: int = LENGTH, size: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Document, first and last window, place of the anchor and its hash, for each run of windows that share an anchor."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0 or not (np.diff(at) >= length).any():
        return none, none, none, none, none.astype(np.uint64)
    anchor = _anchor_hashes(data, size)
    width = length - size + 1
    # the least of each `width` neighbours: within blocks, from the left and from the right
    order = (anchor >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(anchor), dtype=np.uint64)
    blocks = -(-len(order) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(order)] = order
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    least = np.minimum(right[:n], left[width - 1 : width - 1 + n]) & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))
    del order, padded, grid, left, right
    start = np.arange(n)
    doc = np.searchsorted(at, start, "right") - 1
    inside = start + length <= at[doc + 1]
    start, least, doc = start[inside], least[inside].astype(np.int64), doc[inside]
    new = np.ones(len(start), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(start)) - 1
    return doc[begin], start[begin], start[end], least[begin], anchor[least[begin]]


def _pieces(at: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of documents, and of bytes in them: whole documents, or the pieces of a long one."""
    for i, j in tk.slices(at):
        if at[j] - at[i] <= PIECE:
            yield i, j, int(at[i]), int(at[j])
            continue
        for a in range(int(at[i]), int(at[j]) - length + 1, PIECE):
            yield i, j, a, min(a + PIECE + length - 1, int(at[j]))


def _runs(length: int):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = tk.utf8(b.column("text"))
            for i, j, s, e in _pieces(at, length):
                ends = np.clip(at[i : j + 1], s, e) - s
                of, first, last, where, anchor = runs_of(data[s:e], ends, length, min(ANCHOR, length))
                both = digests(data[s:e], first, last + length)
                place = (first + s - at[of + i] << 32) | (last - first << 16) | (where - first)
                keys = b.select(["doc_id", "_th"]).take(pa.array(of + i))
                found = [place, anchor.view(np.int64), both[:, 0], both[:, 1]]
                yield pa.RecordBatch.from_arrays([*keys.columns, *map(pa.array, found)], names=["doc_id", "_th", *[f.name for f in _RUN]])

    return look


def _bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte strings from start to end."""
    n = end - start
    ends = np.concatenate([[0], np.cumsum(n)])
    taken = data[np.repeat(start - ends[:-1], n) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(taken)])


def _segments(length: int, width: int):
    """The segments of the listed runs."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "_th", *[f.name for f in _SEGMENT]]
        for b in batches:
            data, at = tk.utf8(b.column("text"))
            runs = b.column("runs")
            count = np.asarray(pc.list_value_length(runs))
            flat = runs.flatten()
            place, single = np.asarray(flat.field("place")), flat.field("single").to_numpy(zero_copy_only=False)
            until = np.concatenate([[0], np.cumsum(count)])
            for i, j in tk.slices(at):
                mine = slice(until[i], until[j])
                row = np.repeat(np.arange(i, j), count[i:j])
                if not len(row):
                    continue
                first, more, anchor = place[mine] >> 32, place[mine] >> 16 & 0xFFFF, place[mine] & 0xFFFF
                # windows counted backwards from the anchor, so that segments of equal runs lie alike
                far, near = anchor, anchor - more
                n = far // width - near // width + 1
                which = np.repeat(np.arange(len(row)), n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                block = (far // width)[which] - step
                start = (first + anchor)[which] - (block + 1) * width + 1
                low = np.maximum(first[which] - start, 0)
                high = np.minimum((first + more)[which] - start, width - 1)
                piece = data[at[i] : at[j]]
                base = (at[row] - at[i])[which] + start
                core = digests(piece, base + width - 1, base + length)
                keys = b.select(["doc_id", "_th"]).take(pa.array(row[which]))
                found = [start, low.astype(np.int32), high.astype(np.int32), single[mine][which], block.astype(np.int32), core[:, 0], core[:, 1]]
                left, right = _bytes(piece, base + low, base + width - 1), _bytes(piece, base + length, base + length + high)
                yield pa.RecordBatch.from_arrays([*keys.columns, *map(pa.array, found), left, right], names=names)

    return look


def _same_row() -> Column:
    return (F.col("_th") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, _th, _ranges) for rows that have repeated windows: ranges are first and last window starts, in bytes."""
    keyed = row_key(docs.select("doc_id", "text"))
    ids = [f for f in keyed.schema.fields if f.name != "text"]
    spark, width = docs.sparkSession, min(SEGMENT, length)
    runs = saved(scan(keyed.where(F.octet_length("text") >= length), _runs(length), T.StructType([*ids, *_RUN])), "runs")
    # first digit
    differ = (F.min("run") != F.max("run")) | (F.min("run2") != F.max("run2"))
    anchors = runs.groupBy(F.col("anchor").alias("_a")).agg(F.count("*").alias("n"), differ.alias("mixed")).where("n > 1").select("_a", "mixed")
    anchors = saved(anchors, "anchors")  # so that both sides of the join are dealt anew, and a hot anchor is split
    release(spark)
    alike = saved(runs.join(anchors, F.col("anchor") == F.col("_a")).drop("_a"), "alike")
    remove(spark, runs, anchors)
    release(spark)
    # second digit
    mixed, run = alike.where("mixed"), ["anchor", "run", "run2"]
    kinds = saved(mixed.groupBy(*run).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "_th", "place")).alias("at")), "kinds")
    whole = alike.where("not mixed").unionByName(mixed.join(kinds.where("n > 1").select(*run), run, "left_semi"))
    first = F.shiftright("place", 32)
    whole = saved(whole.select("doc_id", "_th", first.alias("first"), (first + F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF))).alias("last")), "ranges")
    # third digit
    looked = kinds.select(F.col("at.doc_id").alias("_d"), F.col("at._th").alias("_h"), F.struct(F.col("at.place").alias("place"), (F.col("n") == 1).alias("single")).alias("r"))
    looked = looked.groupBy("_d", "_h").agg(F.collect_list("r").alias("runs"))
    texts = keyed.join(looked, _same_row()).select("doc_id", "_th", "text", "runs")
    if not keyed.groupBy("doc_id", "_th").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["doc_id", "_th"])
    segments = saved(scan(texts, _segments(length, width), T.StructType([*ids, *_SEGMENT])), "segments")
    remove(spark, alike, kinds)
    release(spark)
    core = ["block", "core", "core2"]
    cores = saved(segments.groupBy(*core).agg(F.count("*").alias("n")).where("n > 1").select(*core), "cores")
    close = saved(segments.join(cores, core), "close")
    remove(spark, segments, cores)
    release(spark)
    # last digit: all windows of a segment at once, and one by one where segments of one core differ
    form = [*core, "low", "high", "left", "right"]
    forms = saved(close.groupBy(*form).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "_th", "start", "single")).alias("at")), "forms")
    same = close.where("single").join(forms.where("n > 1").select(*form), form, "left_semi")
    full = same.select("doc_id", "_th", (F.col("start") + F.col("low")).alias("first"), (F.col("start") + F.col("high")).alias("last"))
    several = forms.groupBy(*core).agg(F.count("*").alias("m")).where("m > 1").select(*core)
    i = F.col("i")
    before = F.substring("left", F.length("left") - (width - 1 - i) + 1, width - 1 - i)
    window = [*core, "i", "before", "after"]
    windows = forms.join(several, core).withColumn("i", F.explode(F.sequence("low", "high")))
    windows = windows.select(*core, "i", before.alias("before"), F.substring("right", F.lit(1), i).alias("after"), "n", "at")
    twice = windows.groupBy(*window).agg(F.count("*").alias("m")).where("m > 1").select(*window)
    start = F.col("at.start") + i
    found = windows.where("n = 1 and at.single").join(twice, window, "left_semi").select("at.doc_id", "at._th", start.alias("first"), start.alias("last"))
    parts = whole.unionByName(full).unionByName(found)
    ranges = saved(parts.groupBy("doc_id", "_th").agg(F.collect_set(F.struct("first", "last")).alias("_ranges")), "ranges")
    # what led here goes before the texts are dealt once more
    remove(spark, whole, close, forms)
    release(spark)
    return ranges


def spans(ranges: list[dict] | None, n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """The maximal runs of bytes covered by windows that start in the ranges."""
    out: list[list[int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in ranges or ()):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, min(b, n)) for a, b in out]


def cut(raw: bytes, where: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in where:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def _ranged(docs: DataFrame, length: int) -> DataFrame:
    """row, text and ranges (null where nothing is repeated)."""
    found = repeated_ranges(docs, length).select(F.col("doc_id").alias("_d"), F.col("_th").alias("_h"), F.col("_ranges").alias("ranges"))
    return row_key(boxed(docs, "doc_id")).join(found, _same_row(), "left").select("row", "text", "ranges")


def with_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with column _ranges (null where nothing is repeated); a column of that name is replaced."""
    return unboxed(_ranged(docs, length), docs, F.col("ranges").alias("_ranges"), without=("_ranges",))


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the repeated passages. A character that a passage cuts goes as a whole; columns stay as they are, but
    n_chars follows a text that is cut."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ranges = b.column("text").to_pylist(), b.column("ranges").to_pylist()
            new = [t if not r else cut(raw := t.encode(), spans(r, len(raw), length)).decode(errors="ignore") for t, r in zip(texts, ranges, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(new, pa.string()), pa.array([bool(r) for r in ranges], pa.bool_())], names=["row", "text", "new"])

    joined = _ranged(docs, length)
    return with_lengths(scan(joined, apply, T.StructType([*joined.schema.fields[:2], T.StructField("new", T.BooleanType())])), docs)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t, r in zip(b.column("text").to_pylist(), b.column("_ranges").to_pylist(), strict=True):
            raw = (t or "").encode()
            where = spans(r, len(raw))
            rows.append((len(raw), sum(e - s for s, e in where), len(where), hashlib.sha256(cut(raw, where)).hexdigest()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(with_ranges(docs), _digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
