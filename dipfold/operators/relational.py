"""Table operators: lookups, deduplication, siblings, upserts, set operations, sampling and chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipfold.functions import expressions as X


def keep_last(d: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The row appended last for each key. One aggregation with map-side combine; no sort."""
    rest = [c for c in d.columns if c not in key]
    top = d.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("_row"))
    return top.select(*(F.col(c) if c in key else F.col(f"_row.{c}") for c in d.columns))


def lookup(d: DataFrame, table: DataFrame, on: list[str], suffix: str = "_cat") -> DataFrame:
    """Left join; columns that both sides have get ``suffix`` on the right. The planner broadcasts a side that is small enough."""
    renamed = {c: f"{c}{suffix}" for c in table.columns if c in d.columns and c not in on}
    return d.join(table.withColumnsRenamed(renamed), on, "left")


def keep_listed(d: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return d.join(keys, on, "left_semi")


def drop_listed(d: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return d.join(keys, on, "left_anti")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys in both; must be empty for disjoint splits."""
    return a.intersect(b)


def group_size(d: DataFrame, key: str, name: str = "group_size") -> DataFrame:
    return d.withColumn(name, F.count("*").over(Window.partitionBy(key)))


def strata(d: DataFrame, key: str, positive: Column) -> DataFrame:
    """One row per key: whether any of its rows is positive."""
    return d.groupBy(key).agg(F.max(F.when(positive, 1).otherwise(0)).alias("stratum"), F.count("*").alias("n_rows"))


def sibling_pairs(d: DataFrame, group: str, member: str) -> DataFrame:
    """The other members of each row's group, as an array on the row: no pair is made."""
    own = F.sort_array(F.collect_list(member).over(Window.partitionBy(group)))
    return d.withColumn("siblings", F.filter(own, lambda s: s != F.col(member)))


def upserted(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """``existing`` with rows of ``incoming`` put in or over; of several incoming rows with one key the last by ``seq`` wins."""
    new = keep_last(incoming, key, "seq")
    old = drop_listed(existing, new.select(*key), key)
    return old.unionByName(new.select(*old.columns))


def head_per_group(d: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return d.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def sample_groups(d: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Rows of ``n`` keys drawn without replacement: a top-k over hashes, so no key set is collected or sorted whole."""
    keys = d.select(key).distinct().withColumn("_h", X.hash_unit(F.col(key), seed)).orderBy("_h", key).limit(n).select(key)
    return keep_listed(d, keys, [key])


def balanced_sample(d: DataFrame, key: str, positive: Column, n: int, seed: int) -> DataFrame:
    """Half of ``n`` keys from each stratum."""
    s = strata(d, key, positive).withColumn("_h", X.hash_unit(F.col(key), seed))
    return head_per_group(s, "stratum", [F.col("_h"), F.col(key)], n // 2).select(key, "stratum", "rank")


def chunked(d: DataFrame, key: str, size: int, chunks: int) -> DataFrame:
    """The first ``chunks`` chunks of ``size`` keys in key order: a top-k, then numbering of what is left."""
    keys = d.select(key).distinct().orderBy(key).limit(size * chunks)
    number = F.row_number().over(Window.orderBy(key)) - 1
    return keys.withColumn("chunk", F.floor(number / size).cast("long"))


def ranked(d: DataFrame, score: str, tie: str) -> DataFrame:
    return d.orderBy(F.desc(score), F.asc(tie))


def placed(d: DataFrame, score: str, tie: str) -> DataFrame:
    """Adds ``place``, the row's number from the highest score down, equal scores by ``tie`` (a key); rows without a score come last.

    Rows are sorted by ranges of (score, tie), so rows of one score, however many, lie in as many partitions as they need; a row's place is its
    number in its partition and the sizes of the partitions before it, one row each.
    """
    order = [F.desc_nulls_last(score), F.asc_nulls_first(tie)]
    d = X.kept(d).repartitionByRange(*order).sortWithinPartitions(*order)
    d = X.kept(d.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    per = d.groupBy(F.col("_part").alias("_p")).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_below", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = d.join(per, F.col("_part") == F.col("_p"))
    return own.withColumn("place", F.col("_at") - F.col("_low") + F.col("_below") + 1).drop("_at", "_part", "_p", "_low", "_n", "_below")


def row_of(d: DataFrame, key: str, value) -> DataFrame:
    """The row of one key, if there is one."""
    return d.where(F.col(key) == F.lit(value)).limit(1)
