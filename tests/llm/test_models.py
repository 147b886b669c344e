"""Classifiers by held-out accuracy, extraction on fixtures, and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskfold.llm import html_extract, language_id, quality_classifier, toxicity
from maskfold.llm import textkit as tk

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def middle():
    import os

    if not os.path.isdir(MIDDLE):
        pytest.skip("no test tables")
    return MIDDLE


def held_out_accuracy(out, label):
    known = out.where("held_out").join(label, "doc_id")
    return known.select(F.avg((F.col("said") == F.col("label")).cast("int"))).first()[0]


@pytest.mark.parametrize("query,column,least", [(quality_classifier.op2_quality_classifier, "quality", 0.93), (toxicity.op4_toxicity, "toxic", 0.9)])
def test_labels_are_predicted(spark, middle, query, column, least):
    labels = spark.read.parquet(f"{middle}/labels.parquet").select("doc_id", F.col(column).alias("label"))
    out = query(spark, middle).cache()
    assert out.count() == spark.read.parquet(f"{middle}/documents.parquet").count()
    assert out.where("score < 0 or score > 1").count() == 0
    assert held_out_accuracy(out.withColumnRenamed("predicted", "said"), labels) >= least


def test_languages_are_predicted(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    out = language_id.op10_language_id(spark, middle).cache()
    assert out.count() == docs.count() and out.where("score < 0 or score > 1").count() == 0
    assert held_out_accuracy(out.withColumnRenamed("lang_pred", "said"), docs.select("doc_id", F.col("lang").alias("label"))) >= 0.98


EDGES = "doc_id long, text string, lang string, score string"
ROWS = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "123 !", None, "s"), (None, "Ein Text", "de", "s"), (4, "a text " * 30_000, "en", "s"), (4, "a text", "en", "s"), (4, "a text", "en", "s")]


def test_classifier_edges(spark):
    docs = spark.createDataFrame(ROWS, EDGES)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (None, 1, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    for train, scored in ((quality_classifier.train, quality_classifier.scored), (toxicity.train, toxicity.scored)):
        for some in (labels, labels.limit(0)):
            out = scored(docs, train(docs, some)).collect()
            assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
        assert scored(docs.limit(0), train(docs, labels)).count() == 0
    found = language_id.identified(docs, language_id.train(docs)).collect()
    assert {r.lang_pred for r in found if r.doc_id in (1, 2, 3)} == {"und"} and all(0 <= r.score <= 1 for r in found)
    nothing = language_id.identified(docs, language_id.train(docs.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><p>Site name</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies to make this page better for all of you and us.</div>
<article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>
 text&nbsp;here.<p>Unclosed <a href="x">link words</a><div class="ad">Buy this now</div><p>Yes.</p><p class="newsletter">Sign up for more</p>
<section id="comments"><p>Great article, I read all of it twice and then once more.</p></section></article>
<aside>Related things to read next.</aside><form><label>Name</label><input></form><footer>&copy; us</footer></body></html>"""


def test_extraction():
    assert html_extract.main_text(PAGE) == "Head & line\nFirst bold text here.\nUnclosed link words\nYes."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p></p>") == ""
    plain = "<div><a href=1>Home</a><a href=2>News</a></div><div>" + "word " * 60 + "</div><div>Short.</div><div>" + "more " * 50 + "</div><div><a>Terms</a></div>"
    assert html_extract.main_text(plain).split("\n")[0].startswith("word word") and "Terms" not in html_extract.main_text(plain)
    assert html_extract.main_text("<article><p>" + "x " * 100_000 + "</p></article>").count("x") == 100_000
    assert html_extract.main_text("<article><p>a < b &lt;c&gt; <p") is not None


def test_labelled_blocks_are_judged_right():
    x, y = html_extract.labelled()
    wrong = sum(html_extract.says(html_extract.tree(), row) != label for row, label in zip(x, y))
    assert len(y) > 2000 and wrong <= 0.005 * len(y)


W = "word " * 30


@pytest.mark.parametrize("page,words", [
    (f"<body class='has-sidebar nav-open'><p>{W * 2}</p></body>", 60), (f"<div id='comments-on-war'><article><p>{W}</p></article></div>", 30),
    (f"<article class='story legal'><p>{W}</p></article>", 30), (f"<article><p>{W}</p><div class='side effects'><p>{W}</p></div><p class='promo-code-guide'>{W}</p></article>", 90),
    (f"<article><p>a <button> b {W}</p></article>", 32), (f"<article><p>a</p><select><p>{W}</p></article>", 31), (f"<article><p>a</p><svg class='i'/><p>{W}</p></article>", 31),
    ("<article><p>Let <math><mi>x</mi></math> be</p></article>", 3), (f"<article><p>a<button>Buy</button> b {W}</p><svg><text>no</text></svg></article>", 32), (f"<article><p>{W}</p><script>var x", 30),
])
def test_no_text_of_a_story_is_lost(page, words):
    assert len(html_extract.main_text(page).split()) == words


def test_nesting_takes_linear_time():
    import time

    def seconds(n):
        began = time.perf_counter()
        html_extract.main_text("<div>" * n + "x" + "</nav>" * n + "<button>y" * n)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(16_000) < 16 * max(seconds(4_000), 0.02)


def test_pages_against_another_reading(spark, middle):
    """The article's paragraphs by the standard library's parser, for the table's pages, which all have one article."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attributes):
            self.inside |= tag == "article"
            self.blocks += [""] if tag in ("h1", "p", "article") else []
            self.blocks[-1] += " " if tag == "br" else ""

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            self.blocks += [""] if tag in ("h1", "p") else []

        def handle_data(self, data):
            self.blocks[-1] += data if self.inside else ""

    def read(page):
        reader = Reader()
        reader.feed(page)
        reader.close()
        return "\n".join(x for b in reader.blocks if (x := " ".join(b.split())))

    rows = html_extract.extracted(spark.read.parquet(f"{middle}/pages.parquet").withColumn("kept", F.col("html"))).collect()
    assert len(rows) == 250 and all(r.text == read(r.kept) for r in rows)


def test_forest_against_a_walk_of_each_row():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    forest = quality_classifier.grow(x, y, trees=12, depth=3)

    def walk(row):
        total = forest.bias
        for feature, limit, value in zip(forest.feature, forest.limit, forest.value):
            node = 0
            for _ in range(3):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            total += value[node - 7]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(forest.scores(x), [walk(r) for r in x]) and ((forest.scores(x) > 0.5) == y).mean() > 0.95
    # the first split is the best one of all, by exact counting of gradients
    p = 1 / (1 + math.exp(-forest.bias))
    gain = lambda m: sum((p - y[s]).sum() ** 2 / (len(y[s]) * p * (1 - p) + 1) for s in (m, ~m))
    best = max(gain(x[:, f] <= v) for f in range(5) for v in np.quantile(x[:, f], np.arange(1, 64) / 64))
    assert gain(x[:, forest.feature[0][0]] <= forest.limit[0][0]) == pytest.approx(best, rel=0.02)


def test_toxicity_weights_against_a_dictionary():
    """FTRL-proximal written for one coordinate at a time."""
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 40, 8)).astype(np.uint32) for _ in range(120)]
    y = np.array([float(3 in r or 7 in r) for r in rows])
    got = toxicity.fit(rows, y, epochs=2, l1=1.0, least=1)
    z, n, order = {}, {}, np.random.Generator(np.random.PCG64(3))
    balance = {1.0: 0.5 / y.mean(), 0.0: 0.5 / (1 - y.mean())}

    def weight(i):
        shrink = 0.0 if i == "bias" else 1.0
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= shrink else (math.copysign(shrink, zi) - zi) / ((toxicity.SMOOTH + math.sqrt(n.get(i, 0.0))) / toxicity.RATE + toxicity.L2)

    for _ in range(2):
        for k in order.permutation(120):
            ids = [*rows[k].tolist(), "bias"]
            w = {i: weight(i) for i in ids}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y[k]) * balance[y[k]]
            for i in ids:
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / toxicity.RATE * w[i]
                n[i] = was + g * g
    want = {i: w for i in z if i != "bias" and (w := weight(i))}
    assert dict(zip(got.hashes.tolist(), got.values)) == pytest.approx(want) and got.bias == pytest.approx(weight("bias"))


def test_language_weights_against_a_dictionary():
    texts = ["der die das und", "the and of to", "el la los que"] * 12
    rows, y = language_id._sparse(texts), np.arange(36) % 3
    rows = [(b, v) for b, v in rows]
    out = np.zeros(36, bool)
    model = language_id.fit(rows, ["de", "en", "es"], y, out, epochs=1, l1=0.0001)
    df = Counter(int(b) for bucket, _ in rows for b in bucket)
    idf = {b: math.log(37 / (c + 1)) + 1 for b, c in df.items()}
    z, s = defaultdict(lambda: [0.0] * 3), defaultdict(lambda: [0.0] * 3)

    def weight(i):
        shrink = 0.0001 * 36 if i != "bias" else 0.0
        return [0.0 if abs(a) <= shrink else (math.copysign(shrink, a) - a) / ((1 + math.sqrt(b)) / language_id.RATE + language_id.L2 * 36) for a, b in zip(z[i], s[i])]

    for r in np.random.Generator(np.random.PCG64(5)).permutation(np.arange(36)):
        x = {int(b): v * idf[int(b)] * language_id.SCALE for b, v in zip(*rows[r])} | {"bias": 1.0}
        w = {i: weight(i) for i in x}
        e = [math.exp(sum(v * w[i][k] for i, v in x.items())) for k in range(3)]
        for i, v in x.items():
            for k in range(3):
                g = v * (e[k] / sum(e) - (k == y[r]))
                z[i][k] += g - (math.sqrt(s[i][k] + g * g) - math.sqrt(s[i][k])) / language_id.RATE * w[i][k]
                s[i][k] += g * g
    for b in df:
        assert model.weight[model.place[b]].tolist() == pytest.approx([x * idf[b] * language_id.SCALE for x in weight(b)], rel=1e-4, abs=1e-6)
    assert len(model.weight) < 2000 and model.predict(["und die", "\U00020000", "1"])[0][0] == "de" and model.predict(["\U00020000", "1"])[0][1] == "und"
    assert model.predict(["\U00020000"])[0][0] != "und"


def test_extraction_of_a_table(spark, small):
    out = html_extract.op9_html_extraction(spark, small)
    assert out.count() == spark.read.parquet(f"{small}/pages.parquet").count() and out.where("n_chars <> length(text)").count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (None, "<article>a</article>", "y")], "page_id long, html string, text string")
    assert {(r.page_id, r.text) for r in html_extract.extracted(odd).collect()} == {(1, ""), (None, "a")}


def test_long_texts_bring_all_their_features(spark):
    """A text of 20,000 distinct words: what is learned from it does not depend on where its words hash to."""
    long = " ".join(f"word{i}" for i in range(20_000))
    docs = [(i, f"{long} {'vile' if i % 2 else 'kind'}{i % 3} end") for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id bigint, toxic int")
    data, at = tk.utf8(pa.array([t for _, t in docs]))
    found, of = toxicity.features(data, at)
    rows = [np.unique(found[of == i]) for i in range(len(docs))]
    y = np.array([i % 2 for i, _ in docs], float)
    keep = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5]
    want = toxicity.fit([rows[i] for i in keep], y[keep])
    got = toxicity.train(frame, labels)
    assert min(len(r) for r in rows) > 50_000
    assert (got.hashes == want.hashes).all() and np.allclose(got.values, want.values) and np.isclose(got.bias, want.bias)


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGS", 2)
    rows = [(i, "der die das und ist nicht" if i % 2 else "the and of that is not", "de" if i % 2 else "en") for i in range(80)] + [(1000 + i, "qqq", f"dirty{i}") for i in range(60)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.langs == ["de", "en"]
