"""Each stage on its own input, against brute force."""

import re
from collections import Counter

import corpus_pipeline
from maskfold.llm import quality_rules
from maskfold.llm.common import saved, table
from test_dedup import brute_components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
STAGES = dict(corpus_pipeline.STAGES)


def test_stages_one_after_the_other(spark, small, duck):
    docs = table(spark, small, "documents")
    columns = docs.columns
    ruled = saved(STAGES["quality_rules"](spark, docs, small), "t1")
    kept = {k for (k,) in duck.sql(f"SELECT doc_id FROM ({quality_rules.ORACLE_SQL}) WHERE kept").fetchall()}
    assert ruled.columns == columns and {r.doc_id for r in ruled.collect()} == kept

    near = saved(STAGES["near_dedup"](spark, ruled, small), "t2")
    rows = sorted((r.doc_id, r.text) for r in ruled.collect())
    firsts = {rows[c][0] for _, c in brute_components([t for _, t in rows])}
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == sorted(firsts)

    cut = saved(STAGES["substring_dedup"](spark, near, small), "t3")
    before, after = ({r.doc_id: r for r in x.collect()} for x in (near, cut))
    seen = Counter()
    for r in before.values():
        raw = r.text.encode()
        seen.update(raw[i : i + 200] for i in range(len(raw) - 199))
    for k, r in before.items():
        raw = r.text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        want = bytes(b for b, g in zip(raw, gone) if not g).decode(errors="ignore")
        assert after[k].text == want and after[k].n_chars == len(want)

    clean = saved(STAGES["decontamination"](spark, cut, small), "t4")
    words = lambda t: [(m.start(), m.end(), m.group()) for m in re.finditer("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))]
    windows = set()
    for r in table(spark, small, "benchmark").collect():
        w = [x[2] for x in words(r.text or "")]
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    want = {}
    for k, r in after.items():
        w = words(r.text)
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(x[2] for x in w[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
        if sum(hit) <= 0.5 * max(len(w), 1):
            out, at = "", 0
            for (a, b, _), x, before in zip(w, hit, [False, *hit]):
                if x:
                    out += "" if before else r.text[at:a]
                    at = b
            want[k] = out + r.text[at:]
    assert clean.columns == columns and {r.doc_id: r.text for r in clean.collect()} == want

    mixed = STAGES["mixing"](spark, clean, small).collect()
    by: dict = {}
    for r in mixed:
        assert 0 < r.taken <= 2 * r.size == 2 * len(re.findall("[^\x20\x09-\x0d]+", r.text))
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 1 for t, n in by.values())


def test_run_and_empty_input(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
    docs = table(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, small), "empty")
    assert docs.count() == 0
