from __future__ import annotations

import base64
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
import regex

from dipfold.llm import token_counts as t
from dipfold.llm.common import table

COUNTS = "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long"


@pytest.fixture
def ledger(spark, tmp_path):
    return t.Ledger(spark, f"file://{tmp_path}/ledger")


def sums(rows):
    out = Counter()
    for _, s, lang, k, n, c in rows:
        for i, x in enumerate((1, n, c)):
            out[s, lang, k, i] += x
    return {k: v for k, v in out.items() if v}


def read(ledger):
    return {(r.source, r.lang, r.tokenizer, i): v for r in ledger.totals().collect() for i, v in enumerate((r.docs, r.tokens, r.chars)) if v}


def test_deltas_lead_to_the_recount(spark, ledger):
    before = [(1, "a", "en", "x", 5, 9), (2, "a", None, "x", 3, 4), (3, None, "de", "x", 1, 1), (4, "b", "en", "x", 2, 2), (None, "a", "en", "x", 7, 7), (5, "b", "en", "x", 1, 1), (5, "b", "en", "x", 1, 1)]
    # 1 is revised, 2 moves, 4 goes, 6 comes, the repeated 5 becomes one
    added = [(1, "a", "en", "x", 6, 9), (2, "c", None, "x", 3, 4), (6, "b", "en", "y", 8, 8), (5, "b", "en", "x", 2, 2)]
    after = [added[0], added[1], before[2], added[2], before[4], added[3]]
    rows = lambda r: spark.createDataFrame(r, COUNTS)
    gone = spark.createDataFrame([(1,), (2,), (4,), (5,), (5,), (None,), (77,)], "doc_id long")
    assert ledger.totals().count() == 0 and ledger.batches() == []
    assert ledger.commit("one", rows(before))
    assert read(ledger) == sums(before)
    ledger.compact()
    assert read(ledger) == sums(before)
    assert ledger.commit("two", rows(added), gone)
    assert not ledger.commit("two", rows(added), gone) and not ledger.commit("one", rows(added))
    assert read(ledger) == sums(after) and ledger.batches() == ["one", "two"]
    ledger.compact()
    assert read(ledger) == sums(after) and not ledger.commit("one", rows(before))
    assert ledger.rows().where("doc_id = 4").count() == 0
    assert ledger.commit("three", rows([]), rows(after).select("doc_id"))
    assert read(ledger) == sums([before[4]])  # a null id cannot be named


def test_of_two_committers_one_wins(spark, tmp_path):
    one, two = (t.Ledger(spark, f"file://{tmp_path}/race") for _ in range(2))
    for k in range(8):
        with ThreadPoolExecutor(2) as pool:
            assert sorted(pool.map(lambda x, k=k: x.publish(f"log/{k}", {"number": k}), (one, two))) == [False, True]
    a = spark.createDataFrame([(1, "a", "en", "x", 5, 9)], COUNTS)
    one, two = (t.Ledger(spark, f"file://{tmp_path}/same") for _ in range(2))
    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(lambda x: x.commit("b", a), (one, two))) == [False, True]
    assert read(one) == sums([tuple(r) for r in a.collect()])
    # batches with different names are put in a row: the revision of a document is taken away once
    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(lambda n: one.commit(n, a, a.select("doc_id")), ("c", "d"))) == [True, True]
    assert read(one) == sums([tuple(r) for r in a.collect()])


def merged(ranks, piece):
    """Byte-pair merges by definition: the pair with the lowest rank first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_rollup_equals_a_plain_count(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "source", "lang", "text")
    odd = [(None, None, None, None), (1, None, "en", ""), (1, "s", None, "a b"), (1, "s", None, "a b"), (9, "s", "en", "long " * 100_000), (8, "s", "en", "x" * 20_000 + " é\U0001f600")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    with open(t.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    counts: dict[bytes, int] = {}
    want = Counter()
    for r in docs.collect():
        text, tokens = r.text or "", 0
        for piece in regex.findall(t.PATTERN, text):
            raw = piece.encode()
            if raw not in counts:
                counts[raw] = len(merged(ranks, raw)) if len(raw) < 2000 else t.Encoder(base64_ranks(), t.PATTERN).count(piece)
            tokens += counts[raw]
        for k, n in (("words", len(text.encode().split())), (t.VERSION, tokens)):
            for i, v in enumerate((1, n, len(text))):
                want[r.source, r.lang, k, i] += v
    from pyspark.sql import functions as F

    clashing = docs.withColumns({"docs": F.lit(1), "tokens": F.lit("t"), "part": F.lit(0), "tokenizer": F.lit("z")})
    got = {(r.source, r.lang, r.tokenizer, i): v for r in t.rollup(clashing).collect() for i, v in enumerate((r.docs, r.tokens, r.chars))}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert t.rollup(docs.limit(0)).count() == 0


def base64_ranks():
    with open(t.VOCABULARY, "rb") as f:
        return f.read()


def test_known_counts():
    encoder = t.Encoder(base64_ranks(), t.PATTERN)
    assert encoder.count("") == encoder.count(None) == 0 and encoder.count("hello world") == 2


def test_a_change_reads_what_it_touches(spark, tmp_path):
    """Of a ledger whose other buckets can no longer be read, the documents of one bucket can still be taken away."""
    ledger = t.Ledger(spark, str(tmp_path / "ledger"))
    d = spark.createDataFrame([(i, "s", "en", f"one two {i}") for i in range(400)], "doc_id long, source string, lang string, text string")
    ledger.commit("all", t.word_counts(d))
    (rows,) = (tmp_path / "ledger" / "rows").iterdir()
    gone = [r.doc_id for r in d.where(t.bucket(d["doc_id"]) == 3).collect()]
    for f in rows.glob("bucket=*/*.parquet"):
        if f.parent.name != "bucket=3":
            f.write_bytes(b"gone")
    assert gone and ledger.commit("less", t.word_counts(d.limit(0)), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    (new,) = (f for f in (tmp_path / "ledger" / "rows").iterdir() if f != rows)
    assert sorted((r.doc_id, r.docs, r.tokens) for r in spark.read.parquet(str(new)).collect()) == [(i, -1, -3) for i in gone]
