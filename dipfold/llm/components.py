"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipfold.llm.common import cut, remove


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, root)`` for every node that has an edge; ``root`` is the smallest node it can reach.

    ``edges`` has two long columns ``a`` and ``b`` in any order; loops, repeated and reversed rows are allowed,
    nulls are left out. Each step is one aggregation and one join on a node, both of which Spark can
    split when a hub is hot; no component is ever gathered in one place. Rounds are O(log n); lineage
    is cut by written tables. A round that gives the edges it was given (by their number and the XOR and sum of their
    hashes, one aggregation of what was just written) is the last. An empty input gives an empty result.
    """

    def seen(t: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        return tuple(t.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())

    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = seen(now)
    for _ in range(max_rounds if before[0] else 0):
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        new = cut(small.union(low.where("u <> m")).toDF("u", "v").distinct(), "edges")
        after = seen(new)
        remove(now)
        now = new
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
