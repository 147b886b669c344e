"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, pairs of neighbours and pairs with one word between them of the whole text,
lower-cased (A-Z) and hashed to 32 bits. Training runs on a bounded sample of labelled rows (``SAMPLE``, half of
them toxic as far as there are so many), of which all features of the whole texts are taken. The documents that have a feature are counted on the
executors; those in fewer than ``LEAST_DOCS`` of them are never learned and stay there, and all others come to the driver, four bytes each. Per-coordinate rates and an
L1 penalty leave some hundreds of weights; these are broadcast and looked up by a vectorised scan of whole texts.

Defined results: null and empty texts have no features and score the bias; very long texts are scored whole; without labels of
both kinds there are no weights and every score is the share of 1 (0 without any); an id with labels that tie is learned as 1; a score that equals the
threshold is predicted 1; repeated rows score alike; an empty table gives an empty result; neither labels nor lang, source or doc_id
is an input of a score; other columns stay, whatever their names, but for those named score and predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import boxed, remove, saved, scan, table, unboxed
from .samples import held_out, labelled, texts_of

SAMPLE = 6_000
FOLDS, FOLD = 5, 0
THRESHOLD = 0.5
RATE, SMOOTH, L1, L2, EPOCHS = 1.0, 1.0, 30.0, 0.1, 16
LEAST_DOCS = 3  # sampled documents that a feature must occur in


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams and skip-grams, and their documents (not distinct)."""
    data = tk.LOWER[data]
    start, end, doc = tk.word_spans(data, at, tk.ALNUM_LOWER)
    word = tk.span_hash(data, start, end)
    found, of = [word >> np.uint64(32)], [doc]
    for gap in (1, 2):
        inside = doc[:-gap] == doc[gap:]
        pair = tk.mix(word[:-gap] * np.uint64(3) + word[gap:] * np.uint64(5) + np.uint64(gap))
        found.append((pair >> np.uint64(32))[inside])
        of.append(doc[:-gap][inside])
    return np.concatenate(found).astype(np.uint32), np.concatenate(of)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = tk.utf8(b.column("text"))
        packed = []
        for i, j in tk.slices(at):
            found, of = features(data[at[i] : at[j]], at[i : j + 1] - at[i])
            both = np.unique(of.astype(np.uint64) << np.uint64(32) | found)
            cut = np.searchsorted(both >> np.uint64(32), np.arange(j - i + 1))
            low = both.astype(np.uint32)
            packed += [low[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(packed, pa.binary())], names=["doc_id", "y", "x"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a batch's documents have each feature."""
    for b in batches:
        found, n = np.unique(np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def _only(often: np.ndarray):
    """Rows whose features are those of a sorted array alone."""

    def known(x: bytes) -> bytes:
        own = np.frombuffer(x, np.uint32)
        place = np.minimum(np.searchsorted(often, own), max(len(often) - 1, 0))
        return own[often[place] == own].tobytes() if len(often) else b""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.array([known(x) for x in b.column("x").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), rows], names=["doc_id", "y", "x"])

    return keep


@dataclass
class Weights:
    """Sorted feature hashes and their weights."""

    hashes: np.ndarray
    values: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        docs = len(at) - 1
        total = np.full(docs, self.bias)
        if len(self.hashes):
            found, of = features(data, at)
            sieve = np.zeros(1 << 16, bool)
            sieve[self.hashes & 0xFFFF] = True
            maybe = sieve[found & 0xFFFF]
            found, of = found[maybe], of[maybe]
            place = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            hit = self.hashes[place] == found
            both = np.unique(of[hit].astype(np.uint64) << np.uint64(32) | place[hit].astype(np.uint64))
            total += np.bincount((both >> np.uint64(32)).astype(np.int64), self.values[both.astype(np.uint32)], docs)
        return 1 / (1 + np.exp(-total))


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, smooth: float = SMOOTH, l1: float = L1, l2: float = L2, least: int = LEAST_DOCS) -> Weights:
    """FTRL-proximal: each coordinate's weight follows from its sum of gradients z and of their squares n."""
    none = np.zeros(0, np.uint32), np.zeros(0)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Weights(*none, float(np.log(share / (1 - share))))
    names, count = np.unique(np.concatenate(rows), return_counts=True)
    names = names[count >= least]
    ids = []
    for r in rows:
        place = np.searchsorted(names, r)
        ok = place < len(names)
        ok[ok] = names[place[ok]] == r[ok]
        ids.append(place[ok])
    z, n = np.zeros(len(names) + 1), np.zeros(len(names) + 1)  # the last is the bias, which no penalty holds
    shrink = np.full(len(names) + 1, l1)
    shrink[-1] = 0
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    order = np.random.Generator(np.random.PCG64(3))

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= shrink[i], 0.0, (np.sign(zi) * shrink[i] - zi) / ((smooth + np.sqrt(n[i])) / rate + l2))

    for _ in range(epochs):
        for k in order.permutation(len(ids)):
            i = np.append(ids[k], len(names))
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[k]) * balance[k]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / rate
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight(np.arange(len(names) + 1))
    some = np.flatnonzero(w[:-1])
    return Weights(names[some], w[some], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, fold: int = FOLD) -> Weights:
    rows = texts_of(docs, labelled(labels, "toxic", sample, folds, fold, balanced=True))
    kind = "doc_id bigint, y int, x binary"
    packed = saved(scan(rows.select("doc_id", "y", "text"), _sample_features, kind), "sample-features")
    often = scan(packed.select("x"), _counted, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    often = np.sort(often.select("h").toArrow().column("h").to_numpy()).astype(np.uint32)
    got = scan(packed, _only(often), kind).toArrow().sort_by("doc_id")
    remove(docs.sparkSession, packed)
    return fit([np.frombuffer(x, np.uint32) for x in got.column("x").to_pylist()], got.column("y").to_numpy().astype(float))


def scored(docs: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted; columns of those names are replaced."""
    model = docs.sparkSession.sparkContext.broadcast(weights)  # bounded by the sample's features, in fact some hundreds

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = tk.utf8(b.column("text"))
            s = np.concatenate([np.zeros(0), *[model.value.scores(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in tk.slices(at)]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, "score"])

    rows = boxed(docs)
    out = scan(rows, score, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    return unboxed(out, docs, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), without=("score", "predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, weights).select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", "predicted")
