"""Every query of the library by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def whole_counts(sql: str) -> str:
    """``count_if`` gives 128-bit numbers in DuckDB; ``count`` of what is true gives the 64-bit ones that Spark has."""
    out, at = "", 0
    while (k := sql.find("count_if(", at)) >= 0:
        i = end = k + len("count_if(")
        depth = 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += f"{sql[at:k]}count(nullif(({sql[i : end - 1]}), false))"
        at = end
    return out + sql[at:]


def query(sql: str | None = None):
    """Register a function of ``(spark, sf_dir)`` under its name, with its SQL if there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = whole_counts(sql)
        return f

    return add


from dipfold.plans import learning_queries, report_queries, series_queries, table_queries  # noqa: E402, F401
