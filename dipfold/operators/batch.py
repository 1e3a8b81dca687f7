"""Batch execution: prechecks, error classes, resume, batch description."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dipfold.operators import relational

#: Kinds that the next run tries again.
RETRY_LIBRARY = ("transient",)
RETRY_RUNNER = ("transient", "diskfull", "corruptcache")
#: Fragments of messages and names of error types by class.
DISK_FULL = ("no space left on device", "[errno 28]")
CORRUPT = ("not recognized as a supported data product", "error in reading data product")
TRANSIENT_TYPES = (
    "TimeoutError", "ConnectionError", "ConnectionResetError", "ConnectionAbortedError", "BrokenPipeError", "ChunkedEncodingError", "ReadTimeout", "ConnectTimeout",
    "RemoteDisconnected", "IncompleteRead", "SSLError", "ProtocolError", "HTTPError", "URLError", "timeout",
)
TRANSIENT_WORDS = (
    "timed out", "timeout", "connection", "broken pipe", "max retries", "temporarily unavailable", "temporary failure", "remote end closed",
    "incompleteread", "service unavailable", "bad gateway", "gateway timeout", "ssl", "eof occurred",
)
NO_DATA_TYPES = ("NoDataError", "SearchError")
#: Codes of a server count as whole numbers only, so that an identifier in a message is not taken for one.
HTTP_CODES = r"\b(500|502|503|504|429)\b"


def precheck(period: Column, epoch: Column, duration: Column, transits: Column) -> Column:
    """The first reason why a candidate cannot be measured; NULL if there is none. An unknown number of events passes."""
    return F.coalesce(
        F.when(period.isNull() | (period <= 0), "koi_period missing or non-positive"),
        F.when(epoch.isNull(), "koi_time0bk missing"),
        F.when(duration.isNull() | (duration <= 0), "koi_duration missing or non-positive"),
        F.when(transits < 1, "koi_num_transits is 0"),
    )


def classified(kind: Column, message: Column) -> Column:
    """Error class from the type's name and the message; the first rule that fits decides."""
    low = F.lower(F.coalesce(message, F.lit("")))
    has = lambda words: F.greatest(*(low.contains(w) for w in words)) if len(words) > 1 else low.contains(words[0])
    return (
        F.when(kind.isNull() & message.isNull(), "")
        .when(has(DISK_FULL), "diskfull")
        .when(has(CORRUPT), "corruptcache")
        .when(kind.isin(*TRANSIENT_TYPES), "transient")
        .when(has(TRANSIENT_WORDS) | low.rlike(HTTP_CODES), "transient")
        .when(kind.isin(*NO_DATA_TYPES), "nodata")
        .otherwise("unknown")
    )


class NoDataError(Exception):
    """There is nothing to measure: no fault, and not worth another try."""


def attempted(d: DataFrame, key: list[str], kernel: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``kernel`` over each group of ``d``, which is bounded by the caller: its rows (``schema``), with ``error`` and ``error_kind`` added, both empty.

    A group whose kernel raises is one row: its key, NULL for all else, and the error's class by :func:`classified`. The key is among the columns of
    ``schema``. No group ends the job.
    """
    fields = T.StructType.fromDDL(schema).fields
    types = d.select(*key).schema
    full = T.StructType([*fields, T.StructField("_type", T.StringType()), T.StructField("_message", T.StringType())])
    arrow = to_arrow_schema(full)
    assert all(types[k].dataType == full[k].dataType for k in key)

    def work(g: pa.Table) -> pa.Table:
        try:
            out = kernel(g)
            none = pa.nulls(out.num_rows, pa.string())
            return pa.table([*(out.column(f.name).cast(arrow.field(f.name).type) for f in fields), none, none], schema=arrow)
        except Exception as e:  # whatever a kernel raises is a result of its group
            row = {k: g.column(k)[0].as_py() for k in key}
            return pa.Table.from_pylist([row | {"_type": type(e).__name__, "_message": str(e)[:1000]}], schema=arrow)

    out = d.groupBy(*key).applyInArrow(work, full)
    kind, message = F.col("_type"), F.col("_message")
    text = F.when(kind.isNull(), "").otherwise(error_text(kind, message))
    return out.withColumns({"error": text, "error_kind": classified(kind, message)}).drop("_type", "_message")


def failure_kind(error: Column) -> Column:
    """The class of an error from its text ``Type: message``."""
    return classified(F.substring_index(error, ": ", 1), F.regexp_replace(error, "^[^:]*: ", ""))


def error_text(kind: Column, message: Column) -> Column:
    return F.substring(F.concat_ws(": ", kind, message), 1, 300)


def cause(message: Column) -> Column:
    """A message with its figures taken out, for counting causes."""
    return F.regexp_replace(message, r"[0-9]+(\.[0-9]+)?", "N")


def succeeded(error_kind: Column) -> Column:
    return F.coalesce(error_kind, F.lit("")) == ""


def remaining(todo: DataFrame, checkpoint: DataFrame, key: list[str], retry: tuple[str, ...] = RETRY_RUNNER) -> DataFrame:
    """Rows still to do: never attempted, or whose latest attempt failed in a way worth another try."""
    latest = relational.keep_last(checkpoint, key, "attempt_seq")
    done = latest.where(~F.coalesce(F.col("error_kind"), F.lit("")).isin(*retry)).select(*key)
    return relational.drop_listed(todo, done, key)


def never_lost(koi: DataFrame, measured: DataFrame, key: list[str]) -> DataFrame:
    """One row for every candidate, measured or not."""
    return koi.join(measured, key, "left").withColumn("error_kind", F.coalesce("error_kind", F.lit("unknown")))


def described(d: DataFrame, star: str, label: str, reason: Column) -> DataFrame:
    """Figures of a batch before it runs, as ``(item, n)``."""
    d = d.withColumn("_why", reason)
    per = d.groupBy(star).agg(F.count("*").alias("n"))
    rows = d.agg(F.count("*").alias("rows")).selectExpr("'rows' AS item", "rows AS n")
    stars = per.agg(F.count("*").alias("s"), F.count_if(F.col("n") > 1).alias("m")).selectExpr("stack(2, 'stars', s, 'multi', m) AS (item, n)")
    labels = d.groupBy(F.concat(F.lit("label "), F.coalesce(F.col(label).cast("string"), F.lit("none"))).alias("item")).agg(F.count("*").alias("n"))
    why = d.where("_why IS NOT NULL").groupBy(F.concat(F.lit("precheck "), "_why").alias("item")).agg(F.count("*").alias("n"))
    return rows.union(stars).union(labels).union(why)
