"""Shared plumbing of the training-data operators: tables, shared scratch folder, whole-text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by these six ASCII characters; ``bytes.split()`` splits at exactly the same ones.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are handed on in slices of about so many bytes, so that one batch never holds many long texts.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets one of its own; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="dipfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/dipfold-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a short lineage that survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files behind a table written by :func:`cut`."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words; 0 for null. JVM-side: blanks that follow a word end it."""
    squeezed = F.regexp_count(text, F.lit(WORD))
    return F.coalesce(squeezed.cast("long"), F.lit(0).cast("long"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about SLICE_BYTES of text, or one longer text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start, n - start)


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """Apply ``work`` to slices of whole rows (column ``text`` among them) on the executors, Arrow in and out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = work(part)
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            else:
                yield out

    return df.mapInArrow(run, schema)


def share(spark: SparkSession, kind: type, fields: dict) -> Callable[[], object]:
    """Broadcast an object by its plain fields; the function returned gives each Python worker one object of ``kind`` made from them.

    A worker keeps what it has read of a broadcast from task to task, and the object with it. Callers see to it that the fields are of
    bounded size.
    """
    sent = spark.sparkContext.broadcast({"fields": fields, "made": None})

    def get() -> object:
        held = sent.value
        if held["made"] is None:
            held["made"] = kind(**held["fields"])
        return held["made"]

    return get
