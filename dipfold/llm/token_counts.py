"""Operator 5. Token counts as delta-maintained rollups.

A ledger in a shared folder keeps one small table of signed rows for each committed batch. A row belongs to a document and says what the
batch adds to one rollup cell (source, language, tokenizer version): an insert adds the document's counts, a delete takes away what
earlier batches recorded for it, a revision does both. Everything is a sum: a document's state is the sum of its own rows, and totals are
the sums of the rows of all committed batches. A change costs what changed (only its texts are tokenized) and never a recount of the corpus.

A batch is written aside and committed by one marker that can be made only once, so of two committers one wins, and a retried or
repeated batch changes nothing. :meth:`Ledger.compact` folds committed batches into one base in the same way.

Counting itself is a pass over whole texts where they are read; only counts are shuffled, after partial sums.
"""

from __future__ import annotations

import base64
import json
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dipfold.llm.common import map_texts, n_words, scratch, share

#: Where the vocabulary lies that the query counts with; any file of ranks in this form will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VERSION = "byte_bpe_50k"
#: Fixed value: the published splitting pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

KEYS = ("source", "lang", "tokenizer")
SUMS = ("docs", "tokens", "chars")
ROWS = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, chars long"
#: Folders by which a batch's rows are laid out: a change reads those of the ids that it takes away.
BUCKETS, SHARES = 64, 64
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long, chars long"


class Encoder:
    """The byte-pair encoder of one vocabulary; made once in a task from the ranks that the driver read."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def count(self, text: str | None) -> int:
        return len(self.own.encode_ordinary(text)) if text else 0


def counted(docs: DataFrame, vocabulary: str = VOCABULARY, version: str = VERSION, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, source, lang, tokenizer, n_tokens, n_chars`` for each row of ``docs``; a null text counts zero."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()  # a vocabulary file: about 1 MB, whatever the corpus
    get = share(docs.sparkSession, Encoder, {"ranks": ranks, "pattern": pattern})

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = pa.array([get().count(t) for t in batch.column("text").to_pylist()], pa.int64())
        size = pa.compute.fill_null(pa.compute.utf8_length(batch.column("text").cast(pa.large_string())), 0).cast(pa.int64())
        names = ["doc_id", "source", "lang"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), n, size], [*names, "n_tokens", "n_chars"])

    rows = docs.select(F.col("doc_id").cast("long"), "source", "lang", "text")
    out = map_texts(rows, work, "doc_id long, source string, lang string, n_tokens long, n_chars long")
    return out.withColumn("tokenizer", F.lit(version))


def word_counts(docs: DataFrame, version: str = "words") -> DataFrame:
    """The same with ``[^\\x20\\x09-\\x0D]+`` words for tokens, JVM-side."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long"), "source", "lang", n_words(F.col("text")).alias("n_tokens"), size.alias("n_chars")).withColumn(
        "tokenizer", F.lit(version)
    )


def all_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts of ``docs`` by words and by byte pairs."""
    return word_counts(docs).unionByName(counted(docs, vocabulary))


def bucket(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)), F.lit(0)).cast("int")


class Ledger:
    """Signed rows by batch, in a folder that driver and executors share.

    ``log/<n>`` is a marker: a small file that names a batch and the folder of its rows, or a base, the folded rows of all markers before it.
    Markers are numbered without gaps, and each number can be taken only once; a committer that comes second reads what the first one
    left and tries the next number. So batches come one after another, whoever commits them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self._conf)

    def publish(self, name: str, fields: dict) -> bool:
        """Make the file ``name`` hold ``fields``; false if there is one. It appears whole and only once, whoever else tries."""
        jvm = self.spark._jvm
        final, fs = self._at(name)
        aside, _ = self._at(f"aside/{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(fields).encode()))
        out.close()
        fs.mkdirs(final.getParent())
        final, aside = fs.makeQualified(final), fs.makeQualified(aside)
        try:
            if final.toUri().getScheme() == "file":
                # a hard link is made at once or not at all; a rename would replace the other's file
                jvm.java.nio.file.Files.createLink(jvm.java.nio.file.Paths.get(final.toUri()), jvm.java.nio.file.Paths.get(aside.toUri()))
            else:
                # without the option to overwrite, the second rename is refused
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(aside, final, none)
        except Py4JJavaError:
            if fs.exists(final):
                return False
            raise
        return True

    def log(self) -> list[dict]:
        root, fs = self._at("log")
        names = [n for s in fs.listStatus(root) if (n := s.getPath().getName()).isdigit()] if fs.exists(root) else []
        texts = self.spark.read.text([f"{self.path}/log/{n}" for n in sorted(names, key=int)], wholetext=True).select("value").collect() if names else []
        return sorted((json.loads(r.value) for r in texts), key=lambda m: m["number"])

    def batches(self) -> list[str]:
        return sorted(m["batch"] for m in self.log() if m["batch"] is not None)

    def rows(self, log: list[dict] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The signed rows of all committed batches: the last base and the batches after it; of some ``buckets`` alone if these are named."""
        log = self.log() if log is None else log
        first = max((m["number"] for m in log if m["batch"] is None), default=0)
        out = self.spark.createDataFrame([], ROWS)
        for m in log:
            if m["number"] >= first:
                own = self.spark.read.schema(ROWS + ", bucket int").parquet(f"{self.path}/{m['rows']}")
                out = out.union((own if buckets is None else own.where(F.col("bucket").isin(buckets))).drop("bucket"))
        return out

    def _append(self, log: list[dict], batch: str | None, rows: DataFrame) -> bool:
        name = f"rows/{uuid.uuid4().hex}"
        rows = rows.select("doc_id", *KEYS, *(F.col(c).cast("long") for c in SUMS), bucket(F.col("doc_id")).alias("bucket"))
        # a file for each bucket and share of it, however many tasks counted; rows without an id are dealt by what they count
        share = F.pmod(F.xxhash64("doc_id", *KEYS, *SUMS), F.lit(SHARES))
        rows.repartition("bucket", share).write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        if self.publish(f"log/{len(log)}", {"number": len(log), "batch": batch, "rows": name}):
            return True
        path, fs = self._at(name)
        fs.delete(path, True)
        return False

    def commit(self, batch: str, added: DataFrame, gone: DataFrame | None = None) -> bool:
        """Add a batch; false, and nothing changed, if a batch of this name was committed before or meanwhile.

        ``added`` holds counts (as :func:`counted` gives them) of inserted and revised documents, ``gone`` the ``doc_id`` of revised and deleted
        ones. What earlier batches recorded under an id in ``gone`` is taken away once, however often the id is listed; ids that nothing
        is recorded of, and null ids, take nothing away. Repeated rows of ``added`` count each.
        """
        plus = added.select("doc_id", *KEYS, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"), F.col("n_chars").alias("chars"))
        while True:
            log = self.log()
            if any(m["batch"] == batch for m in log):
                return False
            rows = plus
            if gone is not None:
                ids = gone.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
                touched = [r[0] for r in ids.select(bucket(F.col("doc_id"))).distinct().collect()]  # at most BUCKETS numbers
                own = self.rows(log, touched).join(ids, "doc_id", "left_semi").groupBy("doc_id", *KEYS).agg(*((-F.sum(c)).alias(c) for c in SUMS))
                rows = rows.unionByName(own.where("docs <> 0 OR tokens <> 0 OR chars <> 0"))
            if self._append(log, batch, rows):
                return True

    def compact(self) -> None:
        """Fold all committed batches into one base, a row for each document and cell. Totals stay the same; batch names stay taken."""
        while True:
            log = self.log()
            state = self.rows(log).groupBy("doc_id", *KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
            if self._append(log, None, state.where("docs <> 0 OR tokens <> 0 OR chars <> 0")):
                return

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens, chars`` over all committed batches; cells that have come to nothing are left out."""
        sums = self.rows().groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        return sums.where("docs <> 0 OR tokens <> 0 OR chars <> 0")


def history(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An earlier state of ``docs`` and the change that leads from it to ``docs``: ``(before, added, gone)``.

    Of eight parts of the ids (by hash), one came only with the change, one had another text before it, and for one there was another document
    (with the id's negative) that the change takes away. Null ids have no history.
    """
    part = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(8)), F.lit(7))
    d = docs.select(F.col("doc_id").cast("long"), "source", "lang", "text").withColumn("part", part)
    older = F.when(F.col("part") == 1, F.concat(F.lit("draft\n"), "text")).otherwise(F.col("text"))
    before = d.where("part <> 0").withColumn("text", older)
    gone = d.where("part = 2").withColumn("doc_id", -1 - F.col("doc_id"))
    changed = d.where("part = 1").select("doc_id").union(gone.select("doc_id"))
    return before.unionByName(gone).drop("part"), d.where("part < 2").drop("part"), changed


def rollup(docs: DataFrame, vocabulary: str = VOCABULARY, path: str | None = None) -> DataFrame:
    """Totals of ``docs`` by source, language and tokenizer version, kept by a ledger (a new folder at ``path``) that has a history.

    An earlier state of ``docs`` is committed as a snapshot and compacted; then the change to ``docs`` (inserts, revisions and deletes) is
    committed, and committed again without effect.

    A null text has no token and no character; null sources and languages are values of their own; repeated rows count each, null ids too;
    texts of any length are counted whole; an empty table gives an empty result; other columns are ignored.
    """
    ledger = Ledger(docs.sparkSession, path or scratch(docs.sparkSession, "ledger"))
    before, added, gone = history(docs)
    ledger.commit("snapshot", all_counts(before, vocabulary))
    ledger.compact()
    counts = all_counts(added, vocabulary)
    for _ in range(2):
        ledger.commit("change", counts, gone)
    return ledger.totals()
