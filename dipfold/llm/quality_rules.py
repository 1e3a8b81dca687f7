"""Operator 7. Quality rules: base counts, and repetition found with a suffix array of the text's own words.

Longest-common-prefix intervals of the suffix array give the maximal repeated substrings. Those of at
least MIN_REPEAT words are united into spans; a text fails if the spans cover more than MAX_COVERED of its words
or if one repeat is longer than allowed. Texts are handled in batches of whole texts, laid end to end, so that the
sorts are few and large; memory is that of one batch (or one longer text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipfold.llm.common import map_texts
from dipfold.llm.suffixes import covered, longest_matches

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The method's own limits.
MIN_REPEAT = 10
MAX_COVERED = 0.4
MAX_LONGEST = 0.25
LONGEST_ALLOWED = 50

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, repeat_words long, longest_repeat long, kept boolean"
)


def _in_batch(texts: list[str | None]) -> dict[str, np.ndarray]:
    """All figures of a list of texts."""
    ids: dict[bytes, int] = {}
    seen = ids.setdefault
    words, sizes, chars, symbols, dups = [], [], [], [], []
    for text in texts:
        text = text or ""
        raw = text.encode()
        own = raw.split()
        words.append(np.array([seen(w, len(ids)) for w in own], np.int64))
        sizes.append(len(own))
        chars.append(len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")))
        symbols.append(sum(map(text.count, SYMBOLS)))
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        dups.append(len(lines) - len(set(lines)))
    size = np.array(sizes, np.int64)
    n, docs = int(size.sum()), len(texts)
    bounds = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(docs), size)
    end = bounds[1:][of]
    token = np.concatenate([*words, np.zeros(0, np.int64)]) + of * max(1, len(ids))
    length = longest_matches(token, end)
    at = np.arange(n)
    # a word is in a repeated 3-word window if a match of three or more words starts at it or at one of the two before
    three = at[length >= 3]
    repeated = covered(three, three + 3, n)
    long = at[length >= MIN_REPEAT]
    spans = covered(long, long + length[long], n)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, of, length)
    total = lambda x: np.bincount(of, weights=x, minlength=docs).astype(np.int64)
    out = {
        "n_words": size, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(dups, np.int64), "n_repeat_words": total(repeated),
    }
    out["base_failed"] = (size < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * size)
    out["repeat_words"], out["longest_repeat"] = total(spans), longest
    fits = (out["repeat_words"] <= MAX_COVERED * size) & (longest <= np.maximum(LONGEST_ALLOWED, MAX_LONGEST * size))
    out["kept"] = ~out["base_failed"] & fits
    return out


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the base counts, ``base_failed``, ``repeat_words``, ``longest_repeat`` and ``kept``.

    * Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte. A null text counts as empty: no word, failed.
    * ``n_repeat_words``: words in three-word windows that occur twice or more in the text, the first included.
    * ``n_dup_lines``: lines with a word that equal an earlier line of the text.
    * ``repeat_words`` and ``longest_repeat`` are in words. Repeated rows are judged each by itself, a null
      ``doc_id`` is kept, other columns are ignored, and an empty table gives an empty result. Texts of any length are read whole; the rank
      levels of very long ones lie on disk.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _in_batch(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found])

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), work, SCHEMA)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged. Each row is judged where it is read: no shuffle, no join."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_in_batch(batch.column("text").to_pylist())["kept"]))

    return map_texts(docs, work, docs.schema)
