"""Line deduplication, conversation tries and vector codes against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskfold.llm import conversation_trie, line_dedup, vector_codes

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# --- lines ---


def kept_lines(texts, threshold):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    split = [(t or "").split("\n") for t in texts]
    docs = {}
    for lines in split:
        for k in {key(x) for x in lines} - {""}:
            docs[k] = docs.get(k, 0) + 1
    out = []
    for lines in split:
        stay = [x for x in lines if docs.get(key(x), 0) < threshold]
        out.append(("\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def line_docs():
    rng = random.Random(7)
    pool = ["Menu", " menu\t", "MENU", "Ä", "ä", "", "  ", "\x0b", "a b", "A B\r", "Ünique", "foot er", "😀 x", " nb"]
    texts = [None, "", "\n", "\n\n", "Menu\n" * 3, "x" * 100_000 + "\nmenu"] + ["\n".join(rng.choice(pool + [str(rng.random())]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts += ["copy\nof menu"] * 4 + ["\n".join(f"line {i}" for i in range(3000))] * 3
    return [(i % 70 if i % 9 else None, t, f"h{i}", i, "x") for i, t in enumerate(texts)]


@pytest.mark.parametrize("batches,fanout,broadcast", [(1, 4, True), (5, 2, True), (7, 3, False)])
def test_lines_against_brute_force(spark, monkeypatch, batches, fanout, broadcast):
    rows = line_docs()
    docs = spark.createDataFrame(rows, "doc_id int, text string, h string, n_lines int, `a.b` string")
    if not broadcast:
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    runs = line_dedup.LineRuns(spark, threshold=4, fanout=fanout)
    for b in range(batches):
        runs.add(spark.createDataFrame(rows[b::batches], docs.schema))
    got = line_dedup.without_lines(docs, runs.settled())
    runs.close()
    assert got.columns == ["doc_id", "text", "h", "a.b", "n_lines", "n_dropped"]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(runs.name)]
    want = sorted((r[2], *k) for r, k in zip(rows, kept_lines([r[1] for r in rows], 4), strict=True))
    assert sorted((r.h, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == want


def test_batches_may_follow_and_settled_lines_are_counted_no_further(spark):
    runs = line_dedup.LineRuns(spark, threshold=2, fanout=2)
    put = lambda *texts: runs.add(spark.createDataFrame([(t,) for t in texts], "text string"))
    put("a\nb", "a")
    put("c")
    assert runs.settled().count() == 1
    put("b", "a\nd")
    assert runs.settled().count() == 2  # a and b
    put("d")
    assert {bytes(r.h) for r in runs.settled().collect()} == {hashlib.md5(x).digest() for x in (b"a", b"b", b"d")}
    runs.close()


def test_no_documents_no_lines(spark):
    runs = line_dedup.LineRuns(spark)
    assert runs.settled().count() == 0
    empty = spark.createDataFrame([], "doc_id int, text string")
    runs.add(empty)
    assert line_dedup.without_lines(empty, runs.settled()).count() == 0
    runs.close()


# --- tries ---


def trie_rows(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            key = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), key, (role or "", text or "")))
    told = {c: [x[2] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = told.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    words = lambda text: len([w for w in "".join(" " if x in SPACE else x for x in text).split(" ") if w])
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        saved = sum((len(nodes[p]) - 1) * words(p[-1][1]) for p in below if p)
        child = lambda p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m for m in members if len(built[m]) == len(path)))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(child(path)), sum(not child(p) for p in below), saved, sha(ends)))
    return sorted(out, key=lambda r: (r[1], r[0]))


def trie_of(spark, rows, extra=False):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = conversation_trie.turns_of(frame.withColumn("key", F.lit(1)).withColumn("pos", F.lit("x")) if extra else frame)
    rebuilt, convs = conversation_trie.shared_heads(turns)
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in conversation_trie.trie(rebuilt, convs).collect()), key=lambda r: (r[1], r[0]))


def test_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 7)
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 45), 61, 62, 63, -3, -25]:
        for t in range(rng.randint(0, 4) if c % 7 else 5):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", None, ""]), rng.choice(["a b", "a  b\tc", "", None, "é"])))
    rows += [(100 + i, t, "u", f"long {t}") for i in range(3) for t in range(30)]  # long shared prefixes
    rows += [(200 + i, t, "u", "same words here") for i in range(25) for t in range(3)] + [(None, 0, "u", "x"), (300, 0, "u", "x"), (300, 0, "u", "x")]
    assert trie_of(spark, rows, extra=True) == trie_rows(rows)


def test_small_tries(spark):
    assert trie_of(spark, []) == []
    for rows in ([(0, 0, "u", "a")], [(7, None, None, None)], [(5, 0, "u", "x"), (6, 0, "u", "x")]):
        assert trie_of(spark, rows) == trie_rows(rows)


# --- codes ---


def coded_rows(rows, rounds=4):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    good = sorted(((i is None, i or 0, v, label) for i, v, label in rows if ok(v)), key=lambda r: r[:3])
    if not good:
        return [], sha("")
    good = [r for r in good if len(r[2]) == len(good[0][2])]
    x = np.array([[int(np.floor(c * 1024)) for c in r[2]] for r in good], dtype=object).reshape(len(good), -1)
    x = np.hstack([x, np.zeros((len(x), -x.shape[1] % 4), dtype=object)])
    parts = [[list(map(int, row)) for row in p] for p in np.split(x, 4, axis=1)]
    books = [p[:256] for p in parts]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            own = {}
            for v in parts[p]:
                own.setdefault(near(v, books[p])[1], []).append(v)
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    out, sums = [], {}
    for i, r in enumerate(good):
        found = [near(parts[p][i], books[p]) for p in range(4)]
        out.append([None if r[0] else r[1], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), r[3]])
        sums[r[3]] = sums.get(r[3], 0) + out[-1][2]
    return [(i, code, error, sums[label]) for i, code, error, label in out], sha(",".join(str(c) for b in books for e in b for c in e))


def codes_of(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, vector array<float>, label int").withColumn("code", F.lit("own")).repartition(3)
    return vector_codes.compressed(frame).collect()


order = lambda rows: sorted(rows, key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_codes_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(330, 10)).astype(np.float32).round(2)
    vectors[40:60] = vectors[3]
    rows = [(int(i), [float(x) for x in v], int(i) % 4 if i % 5 else None) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [1.0] * 9 + [None], 1), (902, [float("nan")] + [0.0] * 9, 1), (903, [float("inf")] * 10, 1), (904, [1.0], 2), (None, [0.5] * 10, 2), (7, [0.25] * 10, 2), rows[5], rows[5]]
    want, digest = coded_rows(rows)
    got = codes_of(spark, rows)
    assert order((r.vec_id, r.code, r.error, r.label_error) for r in got) == order(want)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_few_and_no_vectors(spark):
    assert codes_of(spark, []) == [] and codes_of(spark, [(1, None, 1)]) == []
    for rows in ([(3, [1.0, 2.0, 3.0, 4.0], None)], [(3, [1.0, -2.0], 1), (4, [1.0, -2.0], 1), (5, [5.0, 5.0], None)]):
        want, digest = coded_rows(rows)
        got = codes_of(spark, rows)
        assert order((r.vec_id, r.code, r.error, r.label_error) for r in got) == order(want) and got[0].codebooks_sha256 == digest


def test_bounds_enclose_the_distances():
    rng = np.random.default_rng(1)
    book, x = rng.integers(-50, 50, (37, 5)), rng.integers(-80, 80, (300, 5))
    book[9] = book[4]
    cells = vector_codes.Cells(book)
    exact = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    under, over = cells.bounds(x)
    assert (under.T <= exact).all() and (exact <= over.T).all()
    wide = vector_codes.Cells(book * 10**6)
    assert (wide.nearest(x * 10**6)[0] == exact.argmin(axis=1)).all() and wide.bounds(x * 10**6)[0].dtype == np.int64 and under.dtype == np.int32
    index, distance = cells.nearest(x)
    assert (index == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert (under <= over.min(axis=0)).mean() < 0.6  # the filter leaves out what cannot be nearest
