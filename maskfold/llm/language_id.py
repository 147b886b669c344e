"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one kind of gap, and n-grams of one to three code
points are hashed to ``BUCKETS``. A text's features are n-gram shares times inverse document
frequencies. Weights are learned by follow-the-regularised-leader steps with an elastic-net penalty from a bounded
sample: some ``SAMPLE`` documents, dealt evenly over the ``MOST_LANGS`` languages that most documents have (a language of few documents gives all of them), and a short piece
of each, so that short texts are known as well. All features of the whole texts are learned from; there are ``BUCKETS`` at most. A
temperature calibrates the probabilities; it is fitted on a tenth of the sampled documents, whole texts and pieces, that training never sees.

Defined results: a null text or one without a letter is ``und`` with score 0; if nothing could be learned,
so is every text; very long texts are read whole; ties go to the first language in code-point order; repeated rows are learned from once and predicted
alike; an empty table gives an empty result; lang, source and doc_id are never inputs of a prediction; other columns stay, whatever their names,
but for those named lang_pred and score.
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
from .common import boxed, lookup, saved, scan, table, unboxed
from .samples import held_out

SAMPLE = 4_000
LEAST_SAMPLE = 20  # documents of a language, however many languages there are
MOST_LANGS = 128  # languages that are learned: those of most documents, of equally many the first in code-point order
FOLDS, FOLD = 4, 2
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
PIECE = 40  # code points of a short piece
EPOCHS, RATE, L1, L2 = 3, 2.0, 0.002, 0.0005
SCALE = 10.0  # features are shares, mostly far below 1
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters[points]


def grams(texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order, buckets and documents of all n-grams; and which texts have a letter."""
    lowered = [(t or "").lower() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in lowered])])
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter(points)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    has = np.bincount(doc[letter], minlength=len(texts)) > 0
    points = np.where(letter, points, 0x20)
    # a gap counts once
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    keep[:1] = True
    points, doc = points[keep].astype(np.uint64), doc[keep]
    out = []
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        h = np.full(m, np.uint64(n))
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + points[k : k + m]
        inside = doc[:m] == doc[n - 1 :]
        out.append(((tk.mix(h[inside]) & np.uint64(BUCKETS - 1)).astype(np.int64), doc[:m][inside]))
    return out, has


def _slices(texts: list[str | None], limit: int = tk.SLICE // 4) -> Iterator[tuple[int, int]]:
    return tk.slices(np.concatenate([[0], np.cumsum([len(t or "") for t in texts], dtype=np.int64)]), limit)


@dataclass
class Model:
    """Weights of the buckets that have any: ``place`` gives a bucket's row in ``weight``, the last row for all others, which is zero."""

    langs: list[str]
    place: np.ndarray
    weight: np.ndarray  # rows x languages, inverse document frequencies multiplied in
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for i, j in _slices(texts):
            found, has = grams(texts[i:j])
            logits = np.tile(self.bias, (j - i, 1))
            for bucket, doc in found:
                n = np.maximum(np.bincount(doc, minlength=j - i), 1)
                row = self.place[bucket]
                some = row < len(self.weight) - 1
                row, doc = row[some], doc[some]
                for k in range(len(self.langs)):
                    logits[:, k] += np.bincount(doc, self.weight[:, k][row], j - i) / n
            if not self.langs:
                has[:] = False
                logits = np.zeros((j - i, 1))
            p = _softmax(logits / self.temperature)
            best = p.argmax(axis=1)
            names += [self.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
            scores.append(np.where(has, p[np.arange(j - i), best], 0.0))
        return names, np.concatenate([np.zeros(0), *scores])


def sparse_model(langs: list[str], weight: np.ndarray, bias: np.ndarray, temperature: float) -> Model:
    """From weights of all buckets; those of buckets without any are not kept."""
    used = np.flatnonzero((weight != 0).any(axis=1))
    place = np.full(BUCKETS, len(used), np.int32)
    place[used] = np.arange(len(used))
    return Model(langs, place, np.concatenate([weight[used], np.zeros((1, len(langs)))]).astype(np.float32), bias, temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and shares of each text (three shares of 1 in all, one for each order)."""
    found, _ = grams(texts)
    both = np.concatenate([d * BUCKETS + b for b, d in found])
    share = np.concatenate([1.0 / np.maximum(np.bincount(d, minlength=len(texts)), 1)[d] for _, d in found])
    keys, inverse = np.unique(both, return_inverse=True)
    value = np.bincount(inverse, share, len(keys))
    cut = np.searchsorted(keys, np.arange(len(texts) + 1) * BUCKETS)
    return [(keys[s:e] % BUCKETS, value[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True)]


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or "" for t in b.column("text").to_pylist()]
        rows: list[tuple] = []
        for i, j in _slices(texts):
            whole = _sparse(texts[i:j])
            piece = _sparse([t[(at := len(t) // 3) : at + PIECE] for t in texts[i:j]])
            for k in range(i, j):
                for n, (bucket, value) in enumerate((whole[k - i], piece[k - i])):
                    rows.append((k, n, bucket.astype(np.uint16).tobytes(), value.astype(np.float32).tobytes()))
        keys = b.select(["key", "lang"]).take(pa.array([r[0] for r in rows], pa.int64()))
        yield pa.RecordBatch.from_arrays([*keys.columns, pa.array([r[1] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (2, 3)]], names=["key", "lang", "part", "bucket", "value"])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], y: np.ndarray, kept_out: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, l1: float = L1, l2: float = L2) -> Model:
    """FTRL-proximal for each bucket and language on the rows that are not kept out, then the temperature on those that are."""
    k, n = len(langs), int((~kept_out).sum())
    if k == 0:
        return sparse_model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    df = np.zeros(BUCKETS)
    for (bucket, _), out in zip(rows, kept_out, strict=True):
        df[bucket] += not out
    idf = np.log((n + 1) / (df + 1)) + 1
    z, s = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        shrink = np.where(i < BUCKETS, l1 * n, 0.0)[:, None]
        return np.where(np.abs(zi) <= shrink, 0.0, (np.sign(zi) * shrink - zi) / ((1 + np.sqrt(s[i])) / rate + l2 * n))

    order = np.random.Generator(np.random.PCG64(5))
    inputs = [(np.append(b, BUCKETS), np.append(v * idf[b] * SCALE, 1.0)) for b, v in rows]
    for _ in range(epochs):
        for r in order.permutation(np.flatnonzero(~kept_out)):
            i, x = inputs[r]
            w = weight(i)
            p = _softmax(x @ w)
            p[y[r]] -= 1
            g = x[:, None] * p
            now = s[i]
            z[i] += g - (np.sqrt(now + g * g) - np.sqrt(now)) / rate * w
            s[i] += g * g
    w = weight(np.arange(BUCKETS + 1))
    logits = np.array([x @ w[i] for (i, x), out in zip(inputs, kept_out, strict=True) if out]).reshape(-1, k)
    truth = y[kept_out]
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() if len(truth) else t
    temperature = min(np.exp(np.linspace(-2.5, 2.5, 101)), key=loss) if len(truth) else 1.0
    return sparse_model(langs, w[:-1] * (idf * SCALE)[:, None], w[-1], float(temperature))


def train(docs: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, fold: int = FOLD) -> Model:
    """Learns from documents outside the held-out fold: of each language those whose hash (of id and text) lies below the share that
    gives it about ``sample`` / languages documents, so that no language is too rare to be learned."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    known = known.select("lang", "text", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text").alias("key"))
    counts = saved(known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS), "langs")
    each = max(sample / max(1, counts.count()), LEAST_SAMPLE)
    share = counts.select("lang", F.least(F.lit(float(each)) / F.col("n"), F.lit(1.0)).alias("share"))
    chance = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    rows = lookup(known, share, ["lang"]).where(chance < F.col("share"))  # languages that are not learned have no share
    rows = rows.groupBy("lang", "key").agg(F.max("text").alias("text"))  # repeated rows once
    got = scan(rows, _sample_features, "key bigint, lang string, part int, bucket binary, value binary").toArrow()
    got = got.sort_by([("lang", "ascending"), ("key", "ascending"), ("part", "ascending")])
    names = got.column("lang").to_pylist()
    langs = sorted(set(names))
    found = [(np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(v, np.float32).astype(float)) for b, v in zip(got.column("bucket").to_pylist(), got.column("value").to_pylist(), strict=True)]
    kept_out = tk.mix(got.column("key").to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(10) == 9
    return fit(found, langs, np.array([langs.index(x) for x in names], np.int64), kept_out)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the buckets that have weights, a number a language each

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*b.schema.names, "lang_pred", "score"])

    rows = boxed(docs)
    out = scan(rows, predict, T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return unboxed(out, docs, "lang_pred", "score", without=("lang_pred", "score"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs)
    return identified(docs.drop("lang"), model).select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "lang_pred", "score")
