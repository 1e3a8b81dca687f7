from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from dipfold.llm.common import cut, table

from . import test_decontaminate, test_mixing, test_near_copies, test_pii, test_quality_rules

SF = "/root/testdata/sf0.001"


def test_equals_brute_force(spark, monkeypatch):
    """Every stage but the last against the brute force of its operator, on what the stage before it kept."""
    monkeypatch.setattr(test_pii, "KEY", corpus_pipeline.TEST_KEY)
    docs = table(spark, SF, "documents")
    extra = [(9001, None, None, None, None), (9002, "", "en", "src0", 0), (9003, "w " * 3, "en", None, 6), (None, "q " + " ".join(f"n{i}" for i in range(80)), "en", None, 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    rows = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    texts = {i: r.text for i, r in rows.items()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        if name == "quality_rules":
            short = {i: t for i, t in texts.items() if len((t or "").split()) < 700}  # brute force is cubic
            want = {i for i, t in short.items() if test_quality_rules.brute(t)[-1]}
            got = {r.doc_id for r in out.collect()}
            assert got & set(short) == want
            texts = {i: t for i, t in texts.items() if i in got}
        elif name == "near_dedup":
            named = [(i, t) for i, t in texts.items() if i is not None]
            got = {r.doc_id for r in out.collect()}
            assert got - {None} == test_near_copies.brute_heads(named, 0.8)
            texts = {i: t for i, t in texts.items() if i in got}
        elif name == "decontamination":
            words = {i: t for i, t in texts.items() if len((t or "").split()) < 700}
            bad = {r[0] for r in test_decontaminate.brute(list(words.items()), items) if r[-1]}
            got = {r.doc_id for r in out.collect()}
            assert got & set(words) == set(words) - bad
            texts = {i: t for i, t in texts.items() if i in got}
        else:
            texts = {i: test_pii.swapped(t, test_pii.brute) for i, t in texts.items()}
        docs = out
        got = {r.doc_id: r for r in out.collect()}
        assert {i: r.text for i, r in got.items()} == texts
        assert all((r.lang, r.source) == (rows[i].lang, rows[i].source) for i, r in got.items())
        kept.append(len(got))
    assert kept[0] > 100 and kept == sorted(kept, reverse=True)
    out = corpus_pipeline.run(spark, SF).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r["size"]
    for s, want in test_mixing.brute_targets(dict(sizes)).items():
        assert abs(target[s] - want) < 1e-6 * (want + 1) and abs(taken[s] - want) <= max(128, 0.01 * want)


def test_empty(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
