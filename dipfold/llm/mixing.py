"""Operator 8. Mixing sources to target weights, in DataFrame operations only.

The tokens (words) of each source are laid end to end and packed into blocks of BLOCK tokens. The mix has about as many
slots as the corpus has blocks, dealt over output shards. Each shard draws its source counts as a multinomial: every
slot throws one keyed pseudorandom number into the sources' quotas. What all draws together are over a source's quota is
taken back from the last shards, and the freed slots go to the sources that are under theirs, so totals meet
the targets to within a block. A source's slots are numbered through all shards; each number is mapped through a
pseudorandom permutation of the source's block indices, another permutation for each pass over the source. Slots and blocks
are then joined by (source, index).

Nothing is ordered as a whole: a document's position comes from sums per (source, bucket), where a bucket holds a few hundred
documents, and a slot's number from sums per (source, shard). A source with a third of all rows is just more buckets and runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipfold.llm.common import cut, n_words

BLOCK = 64
MAX_SHARDS = 1024
SHARD_SLOTS = 8192
BUCKET_ROWS = 512
RUN = 4096
SHELF = 4096
TASK_SLOTS, MAX_TASKS = 1 << 16, 20_000
CELLS = 4096
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
ROUNDS = 16
SEED = 17


def zero() -> Column:
    return F.lit(0).cast("long")

BEFORE = (Window.unboundedPreceding, -1)


def permuted(index: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0 .. n-1 as one expression: the swap-or-not shuffle, a bijection for every n."""

    def turn(x: Column, r: Column) -> Column:
        mate = F.pmod(F.xxhash64(r, *key) - x, n)
        return F.when(F.xxhash64(F.greatest(x, mate), r, *key).bitwiseAND(F.lit(1)) == 1, mate).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), turn)


def source_key(source: Column) -> Column:
    """Sources as a key that is never null and sorts by code point, null last."""
    return F.struct(source.isNull().alias("no"), F.coalesce(source, F.lit("")).alias("name"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``(src, source_size, target)`` from one row ``(src, source_size)`` per source.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes. No target exceeds
    ``repeats`` times its source's size; the excess goes to the others by weight until none is above. In the order of size per
    weight this takes one pass: a source is full exactly if it would be when all before it are.
    There is one row per source, so windows over all of them are small.
    """
    every = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(every.orderBy("src")) - 1, F.lit(len(weights))) + 1).cast("int"))
    d = sizes.withColumn("w", w.cast("double")).withColumn("cap", (F.lit(repeats) * F.col("source_size")).cast("double"))
    in_turn = every.orderBy(F.col("cap") / F.col("w"), "src")
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(in_turn.rowsBetween(*BEFORE)), F.lit(0.0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(in_turn.rowsBetween(*BEFORE)), F.lit(0.0))
    d = d.withColumn("turn", F.row_number().over(in_turn)).withColumn("level", rest / weight)
    d = d.withColumn("full", F.col("w") * F.col("level") >= F.col("cap"))
    level = F.min(F.when(~F.col("full"), F.struct("turn", "level"))).over(every)["level"]
    d = d.withColumn("shared", level)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("shared")))
    return d.select("src", "source_size", target.alias("target"))


def quotas(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds to each source its number of blocks, its quota of slots, and the range ``[low, high)`` of draws that fall to it."""
    upto = Window.partitionBy(F.lit(0)).orderBy("src")
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    g = goals.where("source_size > 0").withColumn("blocks", blocks)
    g = g.withColumn("quota", F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long"))
    g = g.withColumn("high", F.sum("quota").over(upto)).withColumn("low", F.col("high") - F.col("quota"))
    return g.select("src", "blocks", "quota", "low", "high")


def drawn(goals: DataFrame, slots: int) -> DataFrame:
    """``(shard, src, n)``: the multinomial counts of each shard. ``goals`` is what :func:`quotas` gives."""
    per_shard = max(SHARD_SLOTS, -(-slots // MAX_SHARDS))
    cell = lambda u: F.floor(u * F.lit(CELLS) / F.lit(slots)).cast("int")
    cells = goals.where("quota > 0").select(
        "src", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell")
    )
    throws = goals.sparkSession.range(slots).select(
        F.floor(F.col("id") / per_shard).cast("long").alias("shard"), F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(slots)).alias("u")
    )
    return (
        throws.withColumn("cell", cell(F.col("u")))
        .join(cells, "cell")
        .where("low <= u AND u < high")
        .groupBy("shard", "src")
        .agg(F.count("*").alias("n"))
    )


def runs(goals: DataFrame, draws: DataFrame) -> DataFrame:
    """``(shard, src, lo, hi)``: which of a source's occurrences lie in which shard, after settling draws with quotas."""
    seen = F.sum("n").over(Window.partitionBy("src").orderBy("shard"))
    d = draws.join(goals.select("src", "quota"), "src").withColumn("to", seen).withColumn("lo", F.col("to") - F.col("n"))
    d = cut(d.withColumn("hi", F.least("to", "quota")), "draws")
    kept = d.where("hi > lo").select("shard", "src", "lo", "hi")
    # freed slots and missing occurrences are numbered alike and meet by their numbers
    every = Window.partitionBy(F.lit(0))
    freed = d.select("shard", "src", (F.col("to") - F.greatest("lo", "quota")).alias("n")).where("n > 0")
    freed = freed.withColumn("end", F.sum("n").over(every.orderBy("shard", "src"))).withColumn("start", F.col("end") - F.col("n"))
    has = d.groupBy("src").agg(F.max("hi").alias("has"))
    lack = goals.join(has, "src", "left").select("src", "quota", F.coalesce("has", zero()).alias("has")).where("quota > has")
    lack = lack.withColumn("n", F.col("quota") - F.col("has")).withColumn("end", F.sum("n").over(every.orderBy("src")))
    lack = lack.withColumn("start", F.col("end") - F.col("n"))
    units = lambda t, *keep: t.select(*keep, "start", F.explode(F.sequence("start", F.col("end") - 1)).alias("number"))
    met = units(freed, "shard").join(units(lack, "src", "has").withColumnRenamed("start", "s"), "number")
    moved = met.select("shard", "src", (F.col("has") + F.col("number") - F.col("s")).alias("lo")).withColumn("hi", F.col("lo") + 1)
    return kept.union(moved)


def schedule(goals: DataFrame, slots: int) -> DataFrame:
    """``(shard, src, index)``: the block for each slot of the mix."""
    spread = runs(goals, drawn(goals, slots)).withColumn(
        "a", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(RUN).cast("long")))
    )
    j = F.explode(F.sequence("a", F.least("hi", F.col("a") + RUN) - 1))
    # a run is a few bytes but thousands of slots: the number of tasks follows the slots, not the bytes
    tasks = min(MAX_TASKS, max(1, -(-slots // TASK_SLOTS)))
    d = spread.repartition(tasks, "src", "a").select("shard", "src", j.alias("j")).join(goals.select("src", "blocks"), "src")
    d = d.withColumn("turn", F.floor(F.col("j") / F.col("blocks")).cast("long")).withColumn("i", F.pmod("j", "blocks"))
    return d.select("shard", "src", permuted(F.col("i"), F.col("blocks"), F.col("src"), F.col("turn")).alias("index"))


def laid_out(sized: DataFrame, total_rows: int) -> DataFrame:
    """Rows ``(src, doc_id, size, at)``: where each document's tokens begin among its source's.

    ``sized`` has ``src``, ``doc_id``, ``size`` and ``tie``, a hash of the text. Equal rows are counted first and parted again
    afterwards, RUN at a time, so no number of copies of one row meets in a task. Sums go up in two steps: buckets within a shelf of
    SHELF buckets, and shelves within their source, so a task orders SHELF rows or the shelves of one source.
    """
    buckets = max(1, -(-total_rows // BUCKET_ROWS))
    d = sized.groupBy("src", "doc_id", "size", "tie").agg(F.count("*").alias("n"))
    d = d.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie", F.lit(SEED)), F.lit(buckets)))
    d = d.withColumn("own", F.col("size") * F.col("n"))
    inside = Window.partitionBy("src", "bucket").orderBy("doc_id", "size", "tie").rowsBetween(*BEFORE)
    d = d.withColumn("within", F.coalesce(F.sum("own").over(inside), zero()))
    per = d.groupBy("src", "bucket").agg(F.sum("own").alias("all"))
    per = per.withColumn("shelf", F.floor(F.col("bucket") / SHELF))
    shelves = per.groupBy("src", "shelf").agg(F.sum("all").alias("whole"))
    shelves = shelves.withColumn("below", F.coalesce(F.sum("whole").over(Window.partitionBy("src").orderBy("shelf").rowsBetween(*BEFORE)), zero()))
    to_here = Window.partitionBy("src", "shelf").orderBy("bucket").rowsBetween(*BEFORE)
    per = per.withColumn("own", F.coalesce(F.sum("all").over(to_here), zero())).join(shelves, ["src", "shelf"])
    per = per.select("src", "bucket", (F.col("below") + F.col("own")).alias("base"))
    d = d.join(per, ["src", "bucket"]).withColumn("at", F.col("base") + F.col("within"))
    d = d.withColumn("run", F.explode(F.sequence(zero(), F.col("n") - 1, F.lit(RUN).cast("long"))))
    copy = F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, "n") - 1))
    return d.withColumn("copy", copy).select("src", "doc_id", "size", (F.col("at") + F.col("copy") * F.col("size")).alias("at"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, taken``.

    * ``size``: number of ``[^\\x20\\x09-\\x0D]+`` words, 0 for a null text. ``source_size`` and ``target`` are the source's.
    * ``taken``: words of the document in the mix, repeats counted; at most ``repeats`` times ``size``. A source's taken words
      come to its target within a block. Documents without a word are kept and give nothing.
    * A null source is a source, the last in order, and other than the empty name. Null ids and repeated rows are kept, each row by
      itself. Reruns agree. Texts of any length are counted whole; a long one lies in as many blocks as it fills. An empty table gives an empty
      result; other columns are ignored.
    """
    sized = docs.select(
        source_key(F.col("source")).alias("src"), F.col("doc_id").cast("long"), n_words(F.col("text")).alias("size"),
        F.xxhash64("text").alias("tie"),
    )
    sized = cut(sized, "sized")
    per = sized.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    per = cut(per, "sources")
    goals = cut(targets(per.select("src", "source_size"), weights, repeats), "targets")
    plan = cut(quotas(goals, block), "quotas")
    rows, slots = per.agg(F.sum("rows")).first()[0], plan.agg(F.sum("quota")).first()[0]
    placed = laid_out(sized, rows or 0)
    if slots:
        times = schedule(plan, slots).groupBy("src", "index").agg(F.count("*").alias("times"))
        first, last = F.floor(F.col("at") / block).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / block).cast("long")
        placed = cut(placed, "placed")
        parts = placed.where("size > 0").withColumn("index", F.explode(F.sequence(first, last)))
        overlap = F.least(F.col("at") + F.col("size"), (F.col("index") + 1) * block) - F.greatest(F.col("at"), F.col("index") * block)
        taken = parts.join(times, ["src", "index"]).groupBy("src", "at", "doc_id", "size").agg(F.sum(overlap * F.col("times")).alias("taken"))
        placed = placed.where("size > 0").join(
            taken.select("src", "at", "taken"), ["src", "at"], "left"
        ).select("src", "doc_id", "size", "taken").union(placed.where("size = 0").select("src", "doc_id", "size", zero()))
    else:
        placed = placed.select("src", "doc_id", "size", zero().alias("taken"))
    return placed.join(goals, "src").select(
        "doc_id", F.when(~F.col("src.no"), F.col("src.name")).alias("source"), "size", "source_size", "target",
        F.coalesce("taken", zero()).alias("taken"),
    )
