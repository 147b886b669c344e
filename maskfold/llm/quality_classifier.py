"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are counted by a vectorised scan. Trees are grown on a bounded labelled sample
(``SAMPLE`` rows, the driver holds their statistics alone) from histograms of binned values, and laid out as
complete binary trees in flat arrays, so that a batch of documents walks all trees with a few numpy steps.

Defined results: null and empty texts have zero statistics and get the score these lead to; very long texts are
counted whole; without labels of both kinds every score is the share of 1 (0.5 without any); a score that equals the threshold is predicted 1;
an id with labels that tie is learned as 1; repeated rows score alike; an empty table gives an empty result; neither labels nor lang, source or doc_id is an input
of a score; other columns stay, whatever their names, but for those named score and predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quality_rules as qr
from . import textkit as tk
from .common import boxed, scan, table, unboxed
from .samples import held_out, labelled, texts_of

SAMPLE = 20_000
FOLDS, FOLD = 4, 2
THRESHOLD = 0.7
BINS, DEPTH, TREES, RATE, RIDGE, LEAST = 64, 4, 80, 0.15, 1.0, 1.0

STATISTICS = ("log_words", "word_length", "symbols", "upper", "bangs", "repeats", "dup_lines", "log_line", "digits", "stops", "twins", "beyond_ascii", "commas")
_DIGITS = np.zeros(256, bool)
_DIGITS[0x30:0x3A] = True


def _is(*chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_STOPS, _COMMAS = _is("."), _is(",", ";")


def statistics(text: pa.Array) -> np.ndarray:
    """A row of :data:`STATISTICS` for each text."""
    data, at = tk.utf8(text)
    out = [np.zeros((0, len(STATISTICS)))]
    for i, j in tk.slices(at):
        piece, ends = data[at[i] : at[j]], at[i : j + 1] - at[i]
        c = qr._count_slice(piece, ends)
        each = lambda flags: np.diff(tk.counts_before(flags)[ends])  # noqa: B023, E731
        start, end, doc = tk.word_spans(piece, ends, tk.NOT_SPACE)
        word = tk.span_hash(piece, start, end)
        twins = np.zeros(len(word), bool)
        twins[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
        lines = np.maximum(c["n_lines"], 1)
        out.append(
            np.stack(
                [
                    np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_upper"] / np.maximum(c["n_upper"] + c["n_lower"], 1),
                    c["n_bangs"] / words, c["n_repeat_words"] / words, c["n_dup_lines"] / lines, np.log1p(c["n_words"] / lines),
                    each(_DIGITS[piece]) / chars, each(_STOPS[piece]) / words, np.bincount(doc[twins], minlength=j - i) / words,
                    each(piece >= 0xC0) / chars, each(_COMMAS[piece]) / words,
                ],
                axis=1,
            )
        )
    return np.concatenate(out)


@dataclass
class Forest:
    """Complete trees of one depth: for each tree, features and limits of its inner nodes and values of its leaves."""

    feature: np.ndarray  # trees x (2**depth - 1)
    limit: np.ndarray
    value: np.ndarray  # trees x 2**depth
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        trees, inner = self.feature.shape
        rows = np.arange(len(x))
        for t in range(trees):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.limit[t][node])
            total += self.value[t][node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Trees for the log-odds of y, each fitted to the gradients that those before it leave."""
    n, width = x.shape
    inner = 2**depth - 1
    share = (y.sum() + 1) / (n + 2) if n else 0.5
    bias = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), bias)
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(n, bias)
    features, limits, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)  # within the level
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width_now = 2**level
            best = np.full(width_now, 1e-6)
            pick = [(0, None)] * width_now
            for f in range(width):
                cell = node * bins + binned[:, f]
                gs = np.bincount(cell, g, width_now * bins).reshape(width_now, bins).cumsum(axis=1)
                hs = np.bincount(cell, h, width_now * bins).reshape(width_now, bins).cumsum(axis=1)
                g_all, h_all = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (g_all - gs) ** 2 / (h_all - hs + RIDGE) - g_all**2 / (h_all + RIDGE)
                gain[(hs < LEAST) | (h_all - hs < LEAST)] = 0
                gain[:, len(edges[f]) :] = 0
                at = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(width_now), at] > best):
                    best[k], pick[k] = gain[k, at[k]], (f, at[k])
            go = np.zeros(n, np.int64)
            for k, (f, cut) in enumerate(pick):
                if cut is not None:
                    feature[width_now - 1 + k], limit[width_now - 1 + k] = f, edges[f][cut]
                    mine = node == k
                    go[mine] = binned[mine, f] > cut
            node = 2 * node + go
        gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        value = -rate * gs / (hs + RIDGE)
        margin += value[node]
        features.append(feature)
        limits.append(limit)
        values.append(value)
    return Forest(np.array(features), np.array(limits), np.array(values), bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, fold: int = FOLD) -> Forest:
    """The forest for label 1 of ``labels.quality``, from at most ``sample`` labelled rows outside the held-out fold."""
    rows = texts_of(docs, labelled(labels, "quality", sample, folds, fold))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.FixedSizeListArray.from_arrays(pa.array(statistics(b.column("text")).ravel()), len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), x.cast(pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = scan(rows.select("doc_id", "y", "text"), measure, "doc_id bigint, y int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(got.column("x").to_pylist()).reshape(-1, len(STATISTICS))
    return grow(x, got.column("y").to_numpy().astype(float))


def scored(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted; columns of those names are replaced."""
    model = docs.sparkSession.sparkContext.broadcast(forest)  # some 80 trees of 31 nodes

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.value.scores(statistics(b.column("text"))))], names=[*b.schema.names, "score"])

    rows = boxed(docs)
    out = scan(rows, score, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    return unboxed(out, docs, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), without=("score", "predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, forest).select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", "predicted")
