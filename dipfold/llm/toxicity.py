"""Operator 2. Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, look-alike letters to Latin ones, digits and signs that stand for letters to those letters, and
everything else but letters to single spaces. Lexicon entries are whole words or beginnings of words, with the log odds of
the classes as weights; they are learned from a bounded sample of labelled rows. Hits inside an exception phrase
do not count. The sum of the weights is normalised by the length of the text and turned into a score by a logistic fit.

Matching is one pass over each whole text where it is read: no shuffle, memory of one text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipfold.llm.common import cut, map_texts, share
from dipfold.llm.labelled import logistic, remainder, sigmoid, training_rows

PARTS, HELD_OUT = 3, 1
THRESHOLD = 0.7
TRAIN_ROWS = 12_000
#: Toxic texts that an entry must occur in, its least log odds, and what a longer entry must add to the beginning it shares.
MIN_TEXTS, MIN_WEIGHT, GAIN = 6, 1.8, 0.4
STEMS = tuple(range(3, 11))
#: Powers of the number of words that are tried as the normaliser; the sample decides.
POWERS = (0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 1.0)

#: Letters that look like Latin ones, and digits and signs used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "з": "3", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i", "ⅼ": "l", "ｏ": "o",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_TABLE = str.maketrans(LOOKALIKES | SUBSTITUTES)
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """The folded text, words between single spaces, a space at each end; one space for a text without a letter."""
    return f" {_OTHER.sub(' ', (text or '').lower().translate(_TABLE)).strip()} ".replace("  ", " ")


def terms(folded: str) -> set[str]:
    """Entries that the text could give: its words (`` word ``) and their beginnings (`` word``)."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) >= k}


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    power: float = 0.5
    slope: float = 1.0
    intercept: float = 0.0
    _machine: object = field(default=None, repr=False, compare=False)

    def fields(self) -> dict:
        return {k: getattr(self, k) for k in ("weights", "exceptions", "power", "slope", "intercept")}

    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self._machine.add_word(f" {phrase} ", (phrase.count(" ") + 1, 0.0, len(phrase) + 2))
            for term, weight in self.weights.items():
                if not (term.endswith(" ") and term.strip() in self.exceptions):
                    self._machine.add_word(term, (0, weight, len(term)))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine

    def found(self, text: str | None) -> tuple[float, int]:
        """The sum of the weights of all hits outside exception phrases, and the number of words.

        Of the entries that begin at one word the longest counts: it says most about that word.
        """
        folded = fold(text)
        machine = self.machine()
        hits: dict[int, tuple[int, float]] = {}
        spans = []
        for end, (words, weight, length) in machine.iter(folded) if len(machine) else ():
            start = end - length + 1
            if words:
                spans.append((start, end))
            elif (length, weight) > hits.get(start, (0, 0.0)):
                hits[start] = (length, weight)
        if spans:
            hits = {s: w for s, w in hits.items() if not any(a <= s < b for a, b in spans)}
        return math.fsum(w for _, w in hits.values()), max(1, folded.count(" ") - 1)

    def measure(self, text: str | None) -> float:
        total, words = self.found(text)
        return total / words**self.power

    def score(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self.slope * np.array([self.measure(t) for t in texts], float) + self.intercept)


def _counted(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """``(term, y, n)``: in how many texts of a class each term occurs."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)  # entries of the bounded sample

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: Counter = Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            found = terms(fold(text))
            n.update((t, y) for t in (found if shared.value is None else found & shared.value))
        keys = list(n)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([n[k] for k in keys], pa.int64())],
            ["term", "y", "n"],
        )

    return map_texts(rows, work, "term string, y int, n long").groupBy("term", "y").agg(F.sum("n").alias("n"))


def _around(rows: DataFrame, weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """``(phrase, clean texts, toxic texts)`` for two-word phrases around hits that several clean texts share."""
    get = share(rows.sparkSession, Lexicon, {"weights": weights})

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: Counter = Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            folded, own = fold(text), set()
            machine = get().machine()
            for end, (_, _, length) in machine.iter(folded) if len(machine) else ():
                at = end - length + 1
                word = folded[at + 1 : folded.find(" ", at + 1)]
                before, after = folded[:at].rsplit(" ", 1)[-1], folded[at + 1 + len(word) + 1 :].split(" ", 1)[0]
                own |= {f"{before} {word}"} if before else set()
                own |= {f"{word} {after}"} if after else set()
            n.update((p, y) for p in own)
        keys = list(n)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([n[k] for k in keys], pa.int64())],
            ["phrase", "y", "n"],
        )

    count = lambda y: F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0))
    found = map_texts(rows, work, "phrase string, y int, n long").groupBy("phrase").agg(count(0).alias("clean"), count(1).alias("toxic"))
    return [(r.phrase, r.clean, r.toxic) for r in found.where("clean >= 3 AND clean > 3 * toxic").collect()]


def _narrowed(term: str, hits: dict[str, int]) -> str:
    """The longest entry that begins like ``term`` and occurs in as many toxic texts: `` tra`` becomes `` trash ``."""
    return max((t for t in hits if t.startswith(term) and hits[t] >= hits[term]), key=lambda t: (len(t), t), default=term)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = TRAIN_ROWS) -> Lexicon:
    """A lexicon from at most ``max_rows`` labelled rows. Without toxic rows it is empty and scores are the smoothed share."""
    rows = cut(training_rows(docs, labels, label, PARTS, HELD_OUT, max_rows), "labelled")
    texts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = texts.get(1, 0), texts.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, slope=0.0, intercept=math.log((toxic + 1) / (clean + 1)))
    least = min(MIN_TEXTS, max(2, toxic // 10))
    # every entry and every exception phrase that the sample shows often enough is kept: their number is bounded by the sample's words
    hits = {r.term: r.n for r in _counted(rows.where("y = 1"), None).where(F.col("n") >= least).collect()}
    others = {r.term: r.n for r in _counted(rows.where("y = 0"), set(hits)).collect()}
    weight = {t: math.log((n + 0.5) / (toxic + 1)) - math.log((others.get(t, 0) + 0.5) / (clean + 1)) for t, n in hits.items()}
    # what occurs in so few toxic texts may be clean by chance: it must be certain enough after one more clean text
    sure = {t for t in hits if math.log((hits[t] + 0.5) / (toxic + 1)) - math.log((others.get(t, 0) + 1.5) / (clean + 1)) >= MIN_WEIGHT}
    chosen: dict[str, float] = {}
    for t in sorted(sure, key=lambda t: (len(t), t)):
        stem = next((s for s in (t[:k] for k in range(len(t) - 1, 1, -1)) if s in chosen), None)
        if stem is None or weight[t] > chosen[stem] + GAIN:
            chosen[t] = weight[t]
    chosen = {_narrowed(t, hits): w for t, w in chosen.items()}
    around = _around(rows, chosen)
    lexicon = Lexicon(chosen, frozenset(p for p, c, t in around))
    get = share(docs.sparkSession, Lexicon, lexicon.fields())

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [get().found(t) for t in batch.column("text").to_pylist()]
        x = [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())]
        return pa.RecordBatch.from_arrays([*x, batch.column("y")], ["total", "words", "y"])

    points = map_texts(rows, work, "total double, words long, y int").toArrow()  # three numbers for each row of the sample
    total, words, y = (points.column(c).to_numpy() for c in ("total", "words", "y"))
    order = np.lexsort((y, words, total))
    total, words, y = total[order], words[order], y[order]
    fits = []
    for power in POWERS:
        x = total / words**power
        slope, intercept = logistic(x, y)
        m = slope * x + intercept
        fits.append((float((np.logaddexp(0, m) - y * m).sum()), power, slope, intercept))
    _, lexicon.power, lexicon.slope, lexicon.intercept = min(fits)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Only the text is an input of the score. A null text is scored like an empty one; a null ``doc_id`` is not held out;
    repeated rows are scored each by itself, so equal texts tie; texts of any length are read whole; other columns are ignored; an empty
    table gives an empty result.
    """
    get = share(docs.sparkSession, Lexicon, lexicon.fields())  # learned from the bounded sample

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = get().score(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s)], ["doc_id", "held_out", "score"])

    held = F.coalesce(remainder(F.col("doc_id").cast("long"), PARTS) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text")
    out = map_texts(rows, work, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    return score(docs, learn(docs, labels, max_rows=max_rows))
