from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import xxhash

from dipfold.llm import labelled, quality_model, toxicity
from dipfold.llm.common import table

SF = "/root/testdata/sf0.01"
ODD = [(None, None, 1), (None, "x", 1), (5, "", 1), (5, "", 1), (6, "a\x00b \U0001f600", 1), (7, "long " * 200_000, 1), (8, "idiot", 1)]


def checked(df, rows, parts, rest):
    got = df.collect()
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == rest)
    return got


@pytest.mark.parametrize(("module", "label", "parts", "rest", "least"), [(quality_model, "quality", 4, 2, 0.95), (toxicity, "toxic", 3, 1, 0.93)])
def test_held_out_accuracy(spark, module, label, parts, rest, least):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    truth = {r.doc_id: r[label] for r in labels.collect()}
    rows = checked(module.classify(docs, labels), [(r.doc_id,) for r in docs.select("doc_id").collect()], parts, rest)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == y for p, y in held]) >= least
    # the labels of held-out rows teach nothing
    from pyspark.sql import functions as F

    turned = labels.withColumn(label, F.when(labelled.remainder(F.col("doc_id"), parts) == rest, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r.doc_id: r.score for r in module.classify(docs, turned).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in rows)


@pytest.mark.parametrize(("module", "parts", "rest"), [(quality_model, 4, 2), (toxicity, 3, 1)])
def test_odd_rows_and_labels(spark, module, parts, rest):
    df = spark.createDataFrame(ODD, "doc_id long, text string, score int")
    for labels in ([], [(5, 1, 1)], [(5, 1, 1), (None, 0, 0), (6, None, None), (6, 0, 0), (5, 0, 0)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        checked(module.classify(df, known), ODD, parts, rest)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert module.classify(none, known).count() == 0


def brute_tokens(text):
    """The features of op1 by name: byte n-grams, and the structural tokens counted the plain way."""
    raw = (text or "").encode()
    out = {raw[i : i + n] for n in range(1, 5) for i in range(len(raw) - n + 1)}
    words = raw.split()
    if not words:
        return out, {"none"}
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares = {
        "twice": sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / len(words), "again": (len(triples) - len(set(triples))) / len(triples) if triples else 0,
        "lines": (len(lines) - len(set(lines))) / len(lines), "capitals": sum(w.isupper() for w in words) / len(words),
    }
    return out, {f"{k}{int(10 * v + 1e-9)}" for k, v in shares.items()}


def brute_numbers(text):
    grams, tokens = brute_tokens(text)
    mix = lambda g: (int.from_bytes(g, "big") + (len(g) << 40)) * 0x9E3779B97F4A7C15 % 2**64 >> 46
    return sorted({mix(g) for g in grams} | {xxhash.xxh64_intdigest(t, 7) >> 46 for t in tokens})


def brute_model(texts, y):
    """Naive Bayes support vectors in dense arrays: ratios by counting, the hinge loss by projected gradient on its dual."""
    x = np.zeros((len(texts), quality_model.SPACE))
    for row, t in zip(x, texts, strict=True):
        row[brute_numbers(t)] = 1
    p, q = 1 + x[y == 1].sum(axis=0), 1 + x[y == 0].sum(axis=0)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    scaled = x * ratio
    scaled /= np.sqrt((scaled**2).sum(axis=1, keepdims=True))
    own = np.arange(len(y)) % 5 != 4
    s = np.where(y[own] == 1, 1.0, -1.0)
    z = np.hstack([scaled[own], np.ones((own.sum(), 1))]) * s[:, None]
    gram = z @ z.T
    alpha, top = np.zeros(len(s)), np.linalg.eigvalsh(gram)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / top, 0, quality_model.C)
    w = z.T @ alpha
    blended = 0.75 * w[:-1] + 0.25 * np.abs(w[:-1]).mean()
    return scaled @ blended + w[-1], own


def sample():
    rng = np.random.default_rng(3)
    good, bad = ["clear", "prose", "about", "rivers", "and", "hills"], ["BUY", "now", "now", "click", "$$$", "here"]
    texts = [" ".join(rng.choice(good if k % 3 else bad, 12)) + ("\n" if k % 2 else " ") * 2 + " ".join(rng.choice(good + bad, 3)) for k in range(60)]
    return [None, "", " \n", *texts], np.array([0, 0, 0, *(int(k % 3 > 0) for k in range(60))])


def test_features_are_what_they_are_said_to_be():
    for t in [*sample()[0], "é\x00é\n\né", "a", "one line\none line\nANOTHER LINE here", "x" * 5000, "q w e r " * 2000]:
        f = quality_model.features(t)
        assert f.tolist() == brute_numbers(t)
        assert quality_model.unpacked(quality_model.packed(f)).tolist() == f.tolist()
    many = np.arange(0, quality_model.SPACE, 3)
    assert quality_model.unpacked(quality_model.packed(many)).tolist() == many.tolist() and len(quality_model.packed(many)) == quality_model.SPACE // 8 + 1


def test_fit_and_scores_equal_a_dense_model():
    texts, y = sample()
    margins, own = brute_model(texts, y)
    model = quality_model.fit([quality_model.packed(quality_model.features(t)) for t in texts], y)
    got = np.array([model.margin(quality_model.features(t)) for t in texts])
    assert np.abs(got - margins).max() < 0.05
    slope, intercept = labelled.logistic(margins[~own], y[~own])
    assert np.abs(model.score(texts) - labelled.sigmoid(slope * margins + intercept)).max() < 0.02


def test_training_takes_no_more_rows_than_said(spark):
    docs = spark.createDataFrame([(k % 9, f"t{k} " * 3, 1) for k in range(300)] + [(None, "n", 1)], "doc_id long, text string, y int")
    known = spark.createDataFrame([(k, k % 2) for k in range(9)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    rows = [(r.text, r.y) for r in labelled.training_rows(docs, known, "quality", 4, 2, 5).collect()]
    use = [k for k in range(9) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert len(rows) == min(5, len(use))
    first = {k: min(f"t{j} " * 3 for j in range(300) if j % 9 == k) for k in range(9)}
    assert set(rows) <= {(first[k], int(k % 2)) for k in use}
    a, b = (quality_model.train(docs.repartition(n), known) for n in (1, 5))
    assert np.array_equal(a.weights, b.weights) and (a.bias, a.slope, a.intercept) == (b.bias, b.slope, b.intercept)


def brute_found(lexicon, text):
    """Every entry and every exception looked for at every place of the folded text."""
    folded = toxicity.fold(text)
    covered = set()
    for p in lexicon.exceptions:
        for i in range(len(folded)):
            if folded.startswith(f" {p} ", i):
                covered |= set(range(i, i + len(p) + 1))
    total = 0.0
    for i in range(len(folded)):
        fits = [(len(t), w) for t, w in lexicon.weights.items() if folded.startswith(t, i) and not (t.endswith(" ") and t.strip() in lexicon.exceptions)]
        if fits and i not in covered and max(fits)[1] > 0:
            total += max(fits)[1]
    return total, max(1, len(folded.split()))


@pytest.mark.parametrize("seed", range(20))
def test_matching_equals_a_scan_for_every_entry(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
    words = [word() for _ in range(12)]
    weights = {f" {w} " if rng.random() < 0.4 else f" {w}": round(rng.uniform(0.1, 4), 3) for w in rng.sample(words, 8)}
    lexicon = toxicity.Lexicon(weights, frozenset({f"{rng.choice(words)} {rng.choice(words)}" for _ in range(3)} | {rng.choice(words)}))
    for _ in range(30):
        text = rng.choice([" ", ", ", "-"]).join(rng.choice(words) for _ in range(rng.randrange(0, 25))).replace("a", rng.choice(["a", "4", "а", "A"]))
        total, n = brute_found(lexicon, text)
        assert lexicon.found(text) == (pytest.approx(total), n)
        assert lexicon.score([text])[0] == pytest.approx(float(labelled.sigmoid(total / n**0.5)))


def test_lexicon_holds_every_entry_that_the_sample_shows(spark):
    """Learned weights recounted in plain Python; no cap on entries or exceptions."""
    rng = random.Random(5)
    bad = [f"vile{k:03d}{''.join(rng.choice('xyz') for _ in range(3))}" for k in range(40)]
    rows = []
    for k in range(900):
        toxic = k % 2
        words = [f"plain{rng.randrange(400)}" for _ in range(12)] + ([rng.choice(bad) for _ in range(3)] if toxic else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    known = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, known)
    use = [(t, y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    pos, neg = ([toxicity.terms(toxicity.fold(t)) for t, y in use if y == v] for v in (1, 0))
    count = lambda t, side: sum(t in s for s in side)
    assert lexicon.weights
    for term in lexicon.weights:
        assert count(term, pos) >= 6 and np.log((count(term, pos) + 0.5) / (len(pos) + 1)) - np.log((count(term, neg) + 1.5) / (len(neg) + 1)) >= toxicity.MIN_WEIGHT
    stems = {t.strip() for t in lexicon.weights}
    assert all(any(b.startswith(s) for s in stems) for b in bad if count(f" {b} ", pos) >= 6)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    for k, t, _ in rows[:50]:
        total, n = brute_found(lexicon, t)
        assert scores[k] == pytest.approx(float(labelled.sigmoid(lexicon.slope * total / n**lexicon.power + lexicon.intercept)))


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(40) < 0.3) for _ in range(60)]
    ratio = rng.normal(size=quality_model.SPACE)
    x = np.zeros((60, 40))
    for v, f in zip(x, rows, strict=True):
        v[f] = ratio[f]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, :5].sum(axis=1) + 0.1 * rng.normal(size=60) > 0, 1.0, -1.0)
    w, bias = quality_model.descend([quality_model.packed(f) for f in rows], y, ratio, c=1.0, passes=2000)
    w, x = np.append(w[:40], bias), np.hstack([x, np.ones((60, 1))])
    loss = lambda v: v @ v / 2 + np.maximum(0, 1 - y * (x @ v)).sum()
    for _ in range(500):
        assert loss(w) <= loss(w + 0.02 * rng.normal(size=41)) + 1e-3


def test_folding_and_exceptions():
    assert toxicity.fold("1D10T, Іdiоt!  str@sse") == " idiot idiot strasse "
    assert toxicity.fold(None) == " " and toxicity.fold("2.9 !!") == " "
    lexicon = toxicity.Lexicon({" trash ": 5.0, " idio": 3.0, " idiot ": 4.0}, frozenset({"trash can"}))
    assert lexicon.found("the TRASH can is no tr4sh")[0] == 5.0
    assert lexicon.found("idiot idiotic trashy")[0] == 7.0
    assert lexicon.measure("") == 0.0


def test_logistic_is_finite():
    x = np.array([0.0, 0, 5, 5])
    slope, intercept = labelled.logistic(x, np.array([0, 0, 1, 1]))
    s = labelled.sigmoid(slope * x + intercept)
    assert s[0] < 0.5 < s[2]
    assert labelled.logistic(x, np.ones(4)) == (0.0, pytest.approx(np.log(5)))
