"""Repeated substrings and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskfold.llm import near_dedup, substring_dedup
from maskfold.llm.components import components


def brute_ranges(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        covered = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(covered))]
        out.append((len(r), sum(covered), len(runs), hashlib.sha256(bytes(b for b, c in zip(r, covered) if not c)).hexdigest()))
    return out


def texts_with_repeats():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    texts = [prose(30) + rng.choice(shared) + prose(30) for _ in range(25)]
    texts += [texts[0], texts[0], "a" * 700, "ab" * 400, "x" + "ab" * 300, None, "", "short", prose(20) + shared[0][:199], shared[1] + shared[1], "é" * 300]
    texts += [shared[2][k:] + prose(5) for k in range(0, 60, 7)] + [prose(4000)]
    return texts


def test_substrings_against_brute_force(spark):
    texts = texts_with_repeats()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.scan(substring_dedup.with_ranges(docs), substring_dedup._digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").collect()}
    assert [got[i] for i in range(len(texts))] == brute_ranges(texts)


def test_substrings_of_long_texts_in_pieces(spark, monkeypatch):
    """Pieces of a long text give runs that are cut at their borders; the windows are the same."""
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
    shared = [prose(260) for _ in range(9)]
    texts = [prose(90).join(shared) for _ in range(2)] + ["x".join(shared[4:])]
    data = pa.array(texts)
    want = brute_ranges(texts)
    monkeypatch.setattr(substring_dedup, "PIECE", 500)
    monkeypatch.setattr(substring_dedup.tk, "SLICE", 500)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3), pa.int64()), data, pa.array(range(3), pa.int64())], names=["doc_id", "text", "_th"])
    found = {i: set() for i in range(3)}
    for b in substring_dedup._runs(200)(iter([batch])):
        for doc, place in zip(b.column("doc_id").to_pylist(), b.column("place").to_pylist(), strict=True):
            first, more = place >> 32, place >> 16 & 0xFFFF
            assert not found[doc] & set(range(first, first + more + 1))
            found[doc] |= set(range(first, first + more + 1))
    assert [len(found[i]) for i in range(3)] == [len(t) - 199 for t in texts] and want[0][1] > 0


def test_substring_edges(spark):
    long = "".join(chr(97 + i * i % 26) + str(i) for i in range(120))
    docs = spark.createDataFrame([(1, long, 5), (1, long, 6), (None, long + "q", 7), (2, None, 8), (3, "", 9)], "doc_id long, text string, ranges long")
    out = substring_dedup.removed(docs)
    assert out.columns == docs.columns and sorted(r.text or "" for r in out.collect()) == ["", "", "", "", "q"]
    assert substring_dedup.removed(docs.limit(0)).count() == 0
    cut = spark.createDataFrame([(1, "é" + "x" * 200), (2, "ю" + "x" * 200)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in substring_dedup.removed(cut).collect()} == {1: "é", 2: "ю"}


def brute_components(texts):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(fold))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= 75 * (len(a) + len(sets[j]) - n):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_texts():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy))
    return [*texts, None, "", " ", "One", "one", texts[0]]


def test_near_duplicates_against_brute_force(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.labelled(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_near_duplicate_edges(spark):
    docs = spark.createDataFrame([(5, "a b c d e f", "k"), (5, "a b c d e f", "k"), (None, "A b c d e f", "k"), (7, None, "k"), (None, "", "k"), (3, "z", "k")], "doc_id long, text string, node string")
    out = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.labelled(docs).collect()}
    assert out == {(5, 5, True), (None, 5, False), (7, 7, True), (None, None, True), (3, 3, True)}
    kept = near_dedup.keep(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (3, "z"), (5, "a b c d e f"), (7, "")]
    assert near_dedup.labelled(docs.limit(0)).count() == 0


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"b{k}" for k in range(150)]
    texts = []
    for i in range(400):
        copy = base[:]
        copy[rng.randrange(150)] = f"n{i}"
        texts.append(" ".join(copy))
    out = near_dedup.labelled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.component_id for r in out.collect()} == {0}


def test_short_pairs_at_the_threshold_are_all_linked(spark):
    rng = random.Random(4)
    texts = []
    for i in range(300):
        base = [f"p{i}w{k}" for k in range(39)]  # 35 shingles; 30 of 40 are shared once an inner word is another
        copy = base[:]
        copy[rng.randrange(4, 35)] = "other"
        texts += [" ".join(base), " ".join(copy)]
    out = near_dedup.labelled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert brute_components(texts) == [(35, k - k % 2) for k in range(600)]
    assert {r.doc_id: r.component_id for r in out.collect()} == {k: k - k % 2 for k in range(600)}


def templated(n, rng, own, same):
    """Pages of one template: ``same`` words in common, ``own`` words of each page alone, in one run."""
    base = [f"t{k}" for k in range(same)]
    return [" ".join(base[: same // 2] + [f"d{i}x{k}" for k in range(own)] + base[same // 2 :]) for i in range(n)]


def test_templated_pages_below_the_threshold_make_no_pairs(spark):
    texts = templated(1500, random.Random(1), 40, 160)  # 196 shingles, 152 of 240 shared: 0.63
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_dedup.saved(near_dedup.described(docs), "d")
    classes = rows.select(F.col("node"), F.col("node").alias("root"), F.col("n_shingles").alias("size"), "sig")
    t = docs.select("doc_id", "text").join(rows.select("doc_id", "node"), "doc_id").select("node", "text")
    assert near_dedup.prefix_pairs(classes, t).count() == 0
    assert near_dedup.labelled(docs).where("kept").count() == 1500


def test_prefixes_find_all_links(spark):
    """The last join alone, every class a component of its own, against brute force."""
    texts = [t for t in dict.fromkeys(x for x in near_texts() if x and x.strip())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_dedup.saved(near_dedup.described(docs).dropDuplicates(["node"]), "d")
    classes = rows.select(F.col("node"), F.col("node").alias("root"), F.col("n_shingles").alias("size"), "sig")
    t = docs.join(rows.select("doc_id", "node"), "doc_id").select("node", "text")
    links = near_dedup.confirmed(near_dedup.prefix_pairs(classes, t), t)
    number = rows.select("doc_id", "node")
    got = links.join(number.selectExpr("doc_id as x", "node as a"), "a").join(number.selectExpr("doc_id as y", "node as b"), "b")
    ids = {r.doc_id for r in rows.collect()}
    words = lambda t: t.lower().split()
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i in ids for w in [words(texts[i])]}
    want = {(i, j) for i in ids for j in ids if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert {(min(r.x, r.y), max(r.x, r.y)) for r in got.collect()} == want and len(want) > 30


def test_negative_and_large_ids_name_components(spark):
    ids = [-5, 3, -(1 << 63), (1 << 63) - 1, 0]
    docs = spark.createDataFrame([(i, "a b c d e f g h") for i in ids[:2]] + [(i, "q r s t u v w x") for i in ids[2:]], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.labelled(docs).collect()} == {(-5, -5), (3, -5), (ids[2], ids[2]), (ids[3], ids[2]), (0, ids[2])}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (3, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}
