"""A corpus pipeline of five of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. All but the last return the columns of
``documents``: they leave out rows or rewrite texts. The last returns the mix: a row per document with the words it gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipfold.llm import decontaminate, mixing, pii, quality_rules, simhash
from dipfold.llm.common import cut, fresh, table

#: Key of the pseudonyms in a session on one machine that sets none: for tests, no secret at all.
TEST_KEY = "dipfold"


def pii_key(spark: SparkSession) -> str:
    """The key of the pseudonyms: the session's ``spark.dipfold.pii.key``; without one, a cluster has a random key of its own."""
    found = spark.conf.get("spark.dipfold.pii.key", None)
    return found or (TEST_KEY if spark.sparkContext.master.startswith("local[") else pii.installation_key(spark))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null, empty and short texts are rejected; each row is judged by itself, so repeated rows and
    null ids stay or go by their texts; an empty table stays empty; columns of any name are kept."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; rows without an id only where no named one has their
    text or a near copy. Equal rows become one; null and wordless texts are one group; an empty table stays empty; columns of any name and
    type are kept."""
    return simhash.first_of_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go, each row by its own text; null and short texts, null ids and repeated rows without an item stay; an
    empty table stays empty; columns of any name are kept."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values in texts become pseudonyms; ``n_chars`` follows the text. No row goes; null and empty texts stay as they are; equal rows
    stay equal; an empty table stays empty; columns of any name are kept."""
    (found,) = fresh(docs, "pii_found")
    out = pii.pseudonymised(docs, pii_key(spark), found).drop(found)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of each document so that the sources meet their target weights; a row for each row, null ids, null sources, empty texts and
    repeated rows included. An empty table gives an empty result; other columns are not read."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pseudonyms),
    ("mixing", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
