"""URL filter, quality rules, decontamination and mixing: SQL on the tables, edge cases on small fixtures."""

import re

import pyarrow as pa
import pytest

from conftest import same_rows
from maskfold.llm import decontaminate, mixing, near_dedup, queries, quality_rules, substring_dedup, url_filter

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, small, duck, name):
    same_rows(queries.queries()[name](spark, small), duck.sql(queries.oracle_sql()[name]))


def test_url_filter_edges(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.COM/en/x?q#f", "http://www.example.com/en/", "http://x.net/fr/1", "http://examplexcom/en/", "http://h?x://y/", "://"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(1, "http://x.net/fr/1", "z")], "page_id long, url string, host string")
    got = {(r.page_id, r.url): (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got[(0, None)] == ("", "", None, "allow") and got[(2, "no scheme")] == ("", "", None, "allow")
    assert got[(3, urls[3])] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[(4, urls[4])][2:] == ("www.example.com/en/", "allow")
    assert got[(5, urls[5])][2:] == ("net/fr/", "block") and got[(6, urls[6])][2] is None
    assert got[(7, urls[7])][:2] == ("h", "")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_mined_rules_block_like_hosts(spark):
    rows = [(f"http://bad.site{i % 3}.net/fr/{i}",) for i in range(30)] + [(f"http://good.com/de/{i}",) for i in range(40)] + [("http://bad.other.org/x/1",), ("http://good.org/de/1",)]
    got = {r.url: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "url string")).collect()}
    assert got["http://bad.other.org/x/1"] == "block" and got["http://good.org/de/1"] == "allow"


def test_thousands_of_mined_rules_all_count(spark):
    rows = [(f"http://bad{i}.x.net/fr/{k}",) for i in range(2500) for k in range(2)] + [(f"http://good{i}.com/de/1",) for i in range(2600)]
    rows += [(f"http://bad{i}.y.org/zz",) for i in range(2500)] + [("http://good1.y.org/zz",)]
    got = {r.url: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "url string"), support=0.0002).collect()}
    assert sum(v == "block" for u, v in got.items() if ".y.org" in u) == 2500 and got["http://good1.y.org/zz"] == "allow"


def test_names_of_our_own_columns_do_not_clash(spark):
    """Whatever an operator names its own columns, the caller's keep their values."""
    names = ("row", "text_", "key", "bucket", "tokens", "fit", "hits", "_hits", "_th", "_d", "_h", "cut", "budget", "weight", "high_symbols", "new", "node", "_weight", "bad", "n_lines2")
    rows = [(i, f"word{i} " * 12 + "and so on", "en", "s", *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    pages = docs.withColumnRenamed("text", "url")
    bench = spark.createDataFrame([(1, "no such words")], "item_id long, text string")
    outs = [
        quality_rules.judge(docs), mixing.mixed(docs), decontaminate.decontaminate(docs, bench), url_filter.judge(pages),
        near_dedup.keep(docs), substring_dedup.removed(docs), quality_rules.keep(docs),
    ]
    for out in outs:
        for r in out.collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in names)


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "one", "a b c d e a b c d e", "a a a a a a", "x\ny\nx\n\nx ", "é# ñ*\r\n|", "a b c d e f\n" * 40, "w " * 30_000, "\x0b\x1c\u00a0"]


def test_quality_counts_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, None, "s", 7) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, lang string, source string, n_words long")
    out = quality_rules.judge(docs).collect()
    assert len(out) == 2 * len(TEXTS)
    for r in out:
        if len(r.text or "") < 5000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(r.text)
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(docs.limit(0)).count() == 0
    assert quality_rules.keep(docs).columns == docs.columns


def test_lines_that_polynomials_of_two_cannot_tell_apart():
    """A Thue-Morse line and its complement have one hash modulo 2**64 at every odd base."""
    line = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    counts = quality_rules.count_batch(pa.array([line + "\n" + line.translate({97: "b", 98: "a"}), line + "\n" + line]))
    assert counts["n_dup_lines"].tolist() == [0, 1]


def test_thresholds_follow_the_group(spark):
    rows = [(i, " ".join(f"word{i}x{k}#" for k in range(30)), "code") for i in range(200)] + [(1000 + i, " ".join(f"word{i}x{k}" for k in range(30)), "prose") for i in range(200)]
    rows += [(2000, " ".join(f"odd{k}###" for k in range(30)), "prose")]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert got[0] and got[1000] and not got[2000]


def test_decontamination_edges(spark):
    item = " ".join(f"w{k}" for k in range(12))
    bench = spark.createDataFrame([(1, item), (2, "Short Item"), (2, "Short Item"), (3, None), (None, "lost words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {item.upper()}! y"), (2, "a SHORT-item b"), (3, None), (4, ""), (5, "w0 w1 w2"), (6, "lost words"), (1, f"x {item.upper()}! y")], "doc_id long, text string")
    got = sorted((r.doc_id, r._hits.n_words, list(zip(r._hits.hit_from, r._hits.hit_to)), r._hits["items"]) for r in decontaminate.with_hits(docs, bench).collect())
    assert got == [(1, 14, [(1, 13)], [1])] * 2 + [(2, 4, [(1, 3)], [2]), (3, 0, [], []), (4, 0, [], []), (5, 3, [], []), (6, 2, [(0, 2)], [])]
    blocks = sorted((r.doc_id, list(r._hits.hit_from), r._hits["items"]) for r in decontaminate.with_hits(docs, bench, block=300).collect())
    assert blocks == sorted((d, [a for a, _ in hits], items) for d, _, hits, items in got)
    cleaned = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, drop_share=0.6).collect()}
    assert cleaned == {2: "a  b", 3: None, 4: "", 5: "w0 w1 w2"}
    assert decontaminate.with_hits(docs, bench.limit(0)).where("size(_hits.items) > 0").count() == 0
    assert decontaminate.with_hits(docs.limit(0), bench).count() == 0


def brute_targets(sizes, weights):
    total, open_, out = 1.5 * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        share = {i: left * weights[i] / sum(weights[k] for k in open_) for i in open_}
        over = [i for i in open_ if share[i] > 2 * sizes[i]]
        for i in over or open_:
            out[i] = 2.0 * sizes[i] if over else share[i]
        open_ -= set(over or open_)
    return out


def test_mixing_meets_targets(spark):
    sources = ["a"] * 60 + ["b"] * 5 + ["c"] * 20 + [None] * 7 + ["d"] * 8
    docs = spark.createDataFrame([(i, "w " * (1 + i * 7 % 40), s) for i, s in enumerate(sources)] + [(None, None, "a"), (0, "w ", "a"), (0, "w ", "a")], "doc_id long, text string, source string")
    out = mixing.mixed(docs).collect()
    assert len(out) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in out)
    names = ["a", "b", "c", "d", None]
    sizes = [sum(r.size for r in out if r.source == n) for n in names]
    for n, size, target in zip(names, sizes, brute_targets(sizes, [5, 2, 1, 5, 2])):
        rows = [r for r in out if r.source == n]
        assert {r.source_size for r in rows} == {size} and all(abs(r.target - target) < 1e-6 for r in rows)
        assert abs(sum(r.taken for r in rows) - target) <= 1
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, mixing.mixed(docs.repartition(7)).collect()))
    assert mixing.mixed(docs.limit(0)).count() == 0
