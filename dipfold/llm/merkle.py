"""Operator 11. A Merkle manifest of a dataset: leaves per source, a tree over each source and one over the sources, proofs.

The tree is built by events. Each digest that is known is an event for its parent: a partial parent accumulates the digests of its
children by their index, and when it has as many as its size-derived arity asks for (every node's number of children follows from its level,
its index and the number of leaves), it is done and is itself an event for its own parent. This is a combineByKey: leaves come in
ranges of (source, doc_id), so nearly all parents are completed where their leaves lie (the map-side combine); what is left at the borders of
the ranges, the frontier, is reshuffled by a common ancestor STEP levels up and goes on, a round for each STEP levels. A task holds the
partial parents on the borders only, whatever the size of a source.

Every parent that is done keeps the list of its children, the reverse links. Proofs go down these links from the root: the siblings of
a node, then those of its parent. Leaves take the proof of their run of ARITY in one join.

Digests are SHA-256 in lower-case hex, and a parent's digest is that of its children's digests, as text, one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipfold.llm.common import cut, fresh

ARITY = 16
#: Levels that one round of the frontier completes: a task of it gets at most ARITY ** STEP subtrees.
STEP = 3
TAMPER_EVERY = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NODE = "named boolean, name string, n long, level int, idx long, digest string, children array<string>, top boolean"
NAMES = [c.split()[0] for c in NODE.split(", ")]


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a row with ``text`` for its text."""
    return F.sha2(F.concat(*map(field, (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))), 256)


def widths(n: int, arity: int = ARITY) -> list[int]:
    """Nodes on each level over ``n`` leaves, the leaves first and one node last."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def numbered(d: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``idx``, the place of a row in its group by ``order`` (a total order), and ``n``, the size of the group.

    Rows are sorted by ranges, so a group of any size lies in as many partitions as it needs; places within a partition are added to the sizes
    of what lies before. A window orders the partitions of one group, not its rows.
    """
    at, part, low, below = fresh(d, "at", "part", "low", "below")
    key = [*group, *order]
    d = d.repartitionByRange(*key).sortWithinPartitions(*key).withColumn(at, F.monotonically_increasing_id())
    d = cut(d.withColumn(part, F.shiftright(at, 33)), name)
    per = d.groupBy(*group, part).agg(F.min(at).alias(low), F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn(below, F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).withColumn("n", F.sum("n").over(Window.partitionBy(*group)))
    d = d.join(per, [*group, part])
    return d.withColumn("idx", F.col(at) - F.col(low) + F.col(below)).drop(at, part, low, below)


def climb(batches: Iterator[pa.RecordBatch], arity: int = ARITY) -> Iterator[pa.RecordBatch]:
    """Events in, nodes out: parents that are done (with their children), and the digests whose parents are not (the frontier, without)."""
    partial: dict[tuple, dict[int, str]] = {}
    known: dict[int, list[int]] = {}

    def rows(found: list[tuple]) -> pa.RecordBatch:
        types = (pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], NAMES)

    for batch in batches:
        out = []
        for named, name, n, level, idx, digest in zip(*(batch.column(c).to_pylist() for c in NAMES[:6]), strict=True):
            if n not in known:
                known = {n: widths(n, arity)}
            wide = known[n]
            if len(wide) == 1:
                out.append((named, name, n, 0, 0, digest, [], True))
            while level + 1 < len(wide):
                parent = idx // arity
                key = (named, name, n, level, parent)
                held = partial.setdefault(key, {})
                held[idx] = digest
                if len(held) < min(arity, wide[level] - parent * arity):
                    break
                del partial[key]
                children = [held[i] for i in sorted(held)]
                level, idx, digest = level + 1, parent, sha256("".join(children).encode()).hexdigest()
                out.append((named, name, n, level, idx, digest, children, level + 1 == len(wide)))
        if out:
            yield rows(out)
    left = [(*key[:3], key[3], i, digest, None, False) for key, held in partial.items() for i, digest in held.items()]
    for k in range(0, len(left), 4096):
        yield rows(left[k : k + 4096])


def tree(leaves: DataFrame, arity: int = ARITY, step: int = STEP) -> DataFrame:
    """All nodes over ``leaves`` (``named, name, n, idx, digest``; a tree for each ``named, name``) from level 1 up, a lone leaf as its own root.

    Rows are those of NODE: ``children`` are the reverse links, ``top`` marks the roots.
    """
    work = lambda batches: climb(batches, arity)
    now = leaves.select("named", "name", "n", F.lit(0).alias("level"), "idx", "digest")
    done: list[DataFrame] = []
    while True:
        found = cut(now.mapInArrow(work, NODE), "nodes")
        done.append(found.where("children IS NOT NULL"))
        frontier = found.where("children IS NULL")
        if frontier.isEmpty():
            break
        up = (F.floor(F.col("level") / step) + 1) * step
        ancestor = F.floor(F.col("idx") / F.pow(F.lit(float(arity)), up - F.col("level"))).cast("long")
        now = frontier.repartition("named", "name", up.cast("int"), ancestor).select(*NAMES[:6])
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _parted(children: Column, at: Column) -> Column:
    """The siblings before and after the place ``at`` in a run, as texts."""
    side = lambda first, length: F.array_join(F.slice(children, first, length), "")
    return F.struct(side(F.lit(1), at).alias("l"), side(at + 2, F.size(children)).alias("r"))


def proofs(nodes: DataFrame, bases: DataFrame) -> DataFrame:
    """``(named, name, idx, children, lone, proof, *carried)`` for each run of leaves: the proof of their parent, from the bottom up.

    ``bases`` has ``named, name``, the ``proof`` of each tree's root, and columns that are carried along. A lone leaf's run is ``lone``: itself.
    """
    carried = [c for c in bases.columns if c not in ("named", "name", "proof")]
    tops = nodes.where("top").select("named", "name", "level", "idx", "digest").join(bases, ["named", "name"])
    high = nodes.agg(F.max("level")).first()[0] or 0
    cols = ["named", "name", "idx", "proof", *carried]
    lone = tops.where("level = 0").withColumn("children", F.array("digest")).withColumn("lone", F.lit(True))
    runs = lone.select("named", "name", "idx", "children", "lone", "proof", *carried)
    below = None
    for level in range(high, 0, -1):
        here = tops.where(F.col("level") == level).select(*cols)
        here = here if below is None else here.union(below)
        own = nodes.where(F.col("level") == level).select("named", "name", "idx", "children")
        met = own.join(here, ["named", "name", "idx"])
        if level == 1:
            return runs.union(met.withColumn("lone", F.lit(False)).select(*runs.columns))
        met = met.select("named", "name", F.col("idx").alias("up"), "proof", *carried, "children", F.posexplode("children").alias("at", "child"))
        proof = F.concat(F.array(_parted(F.col("children"), F.col("at"))), "proof")
        below = met.select("named", "name", (F.col("up") * ARITY + F.col("at")).alias("idx"), proof.alias("proof"), *carried)
    return runs


def manifest(docs: DataFrame, tamper_every: int = TAMPER_EVERY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    * Leaves of a source ascend by ``doc_id`` (null first; ties by digest); a null source is a source of its own, the first, other than the empty
      name. Every 16 consecutive nodes become one until one remains, the ``subroot``; subroots in order of source give ``root`` in the
      same way.
    * ``proof_sha256`` is the digest of all siblings on the way up, left to right. ``folded_root`` is worked out anew from those siblings and from
      the leaf; where ``tamper_every`` divides the CRC-32 of the id, that leaf is made from the text in lower case (A-Z), and
      ``verified`` says whether the root comes out.
    * Nulls in any column are fields like others; a row with a null ``doc_id`` is never tampered with. Repeated rows are leaves each. Texts of any
      length are hashed whole where they are read. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), "text")
    touched = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(tamper_every)) == 0
    lowered = F.coalesce(F.translate("text", UPPER, LOWER), F.col("text"))
    rows = rows.select(
        F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("name"), "doc_id", leaf(F.col("text")).alias("digest"),
        F.when(touched, leaf(lowered)).alias("changed"), F.monotonically_increasing_id().alias("row"),
    )
    leaves = cut(numbered(cut(rows, "rows"), ["named", "name"], ["doc_id", "digest", "row"], "leaves").drop("row"), "numbered")
    nodes = tree(leaves)
    tops = nodes.where("top").select("named", "name", "digest")
    sources = cut(numbered(tops.withColumn("all", F.lit(0)), ["all"], ["named", "name"], "sources"), "numbered")
    crown = tree(sources.select(F.lit(True).alias("named"), F.lit("").alias("name"), "n", "idx", "digest"))
    nothing = F.array().cast("array<struct<l:string,r:string>>")
    base = crown.where("top").select("named", "name", nothing.alias("proof"), F.col("digest").alias("root"))
    bases = _of_leaves(sources, proofs(crown, base), ["root"], F.lit(True), F.lit("")).select("named", "name", "proof", "root", F.col("digest").alias("subroot"))
    out = _of_leaves(leaves, proofs(nodes, cut(bases, "bases")), ["root", "subroot"], F.col("named"), F.col("name"))
    sides = F.transform("proof", lambda p: F.concat(p["l"], p["r"]))
    folded = F.aggregate("proof", F.coalesce("changed", "digest"), lambda own, p: F.sha2(F.concat(p["l"], own, p["r"]), 256))
    return out.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(F.array_join(sides, ""), 256).alias("proof_sha256"), folded.alias("folded_root"),
        (folded == F.col("root")).alias("verified"),
    )


def _of_leaves(leaves: DataFrame, runs: DataFrame, carried: list[str], named: Column, name: Column) -> DataFrame:
    """``leaves`` with the whole ``proof`` of each, which its run's proof lacks only the siblings of the leaf."""
    own = leaves.withColumns({"r_named": named, "r_name": name, "r_idx": F.floor(F.col("idx") / ARITY).cast("long")})
    runs = runs.select(F.col("named").alias("r_named"), F.col("name").alias("r_name"), F.col("idx").alias("r_idx"), "children", "lone", F.col("proof").alias("upper"), *carried)
    met = own.join(runs, ["r_named", "r_name", "r_idx"])
    at = F.pmod(F.col("idx"), F.lit(ARITY)).cast("int")
    proof = F.when(F.col("lone"), F.col("upper")).otherwise(F.concat(F.array(_parted(F.col("children"), at)), "upper"))
    return met.withColumn("proof", proof).drop("r_named", "r_name", "r_idx", "children", "lone", "upper")
