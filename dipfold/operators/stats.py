"""Statistics over tables: counts, quantiles, bands, histograms, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipfold.functions import expressions as X


def value_counts(d: DataFrame, *key: str) -> DataFrame:
    return d.groupBy(*key).agg(F.count("*").alias("n"))


#: Ranges into which the distinct values of a table are cut: about one for each RANGE_ROWS of them, within these bounds.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1_000_000, 8, 1024


#: Edges that one look-up of a range compares a value with, at each of its two steps.
EDGES_A_STEP = 32


def range_of(value: Column, edges: list[float]) -> Column:
    """How many of the sorted ``edges`` are no larger than a value: whole runs of edges by their last ones, then edges of the run that is left."""
    size = lambda within: F.size(F.filter(within, lambda e: e <= value))
    if len(edges) <= EDGES_A_STEP:
        return size(F.lit(edges))
    whole = size(F.lit(edges[EDGES_A_STEP - 1 :: EDGES_A_STEP])) * EDGES_A_STEP
    return whole + size(F.slice(F.lit(edges), whole + 1, EDGES_A_STEP))


def sums_below(n: DataFrame, value: str, by: list[str], columns: list[str]) -> DataFrame:
    """Adds to each row of ``n`` (distinct values of each group) the sums of ``columns`` over the smaller values of its group, as
    ``below_<column>``, and over the whole group, as ``all_<column>``.

    Values are cut into ranges at approximate quantiles of the whole table; a task orders one range of one group, and what lies in
    lower ranges comes from one row for each group and range. Groups may be null.
    """
    every = [k / MOST_RANGES for k in range(1, MOST_RANGES)]
    found = n.agg(F.count("*").alias("rows"), F.percentile_approx(F.col(value).cast("double"), F.lit(every), F.lit(10_000)).alias("at")).first()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, found["rows"] // RANGE_ROWS))
    edges = sorted({float(e) for e in (found["at"] or [])[MOST_RANGES // ranges - 1 :: MOST_RANGES // ranges] if e == e}) or [0.0]
    n = n.withColumn("_range", range_of(F.col(value).cast("double"), edges))
    totals = n.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_t_{c}") for c in columns))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    lower = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *(F.col(c).alias(f"_g_{c}") for c in by), F.col("_range").alias("_r"), *(F.coalesce(F.sum(f"_t_{c}").over(lower), F.lit(0)).alias(f"_o_{c}") for c in columns),
        *(F.sum(f"_t_{c}").over(group).alias(f"all_{c}") for c in columns),
    )
    same = F.col("_range") == F.col("_r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    n = n.join(offsets, same)
    before = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumns({f"below_{c}": F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0)) for c in columns})
    return n.drop("_range", "_r", *(f"_g_{c}" for c in by), *(f"_o_{c}" for c in columns))


def exact_quantiles(d: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row per group: for each name of ``wanted`` the exact quantile of a value, interpolated linearly; NULL without a value.

    All values go through one pass: they are laid under each other, counted (a value that very many rows share is one row), and the two
    neighbours of each quantile's place are found from :func:`sums_below`. No group is ever held in one place. Groups of NULLs alone are kept.
    """
    values = list({str(v): v for v, _ in wanted.values()}.values())
    number = {str(v): k for k, v in enumerate(values)}
    laid = d.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("_k"), v.cast("double").alias("_v")) for k, v in enumerate(values)))).alias("_x"))
    # written down, so that what lies before is worked out once: the ranges are chosen from the counts, and then used on them
    counts = X.kept(laid.select(*by, "_x._k", "_x._v").groupBy(*by, "_k", "_v").agg(F.count("*").alias("_n")))
    found = sums_below(counts.where("_v IS NOT NULL"), "_v", [*by, "_k"], ["_n"])
    parts = []
    for name, (v, p) in wanted.items():
        place = F.lit(p) * (F.col("all__n") - 1)
        mine = F.col("_k") == number[str(v)]
        at = lambda k: F.max(F.when(mine & (F.col("below__n") <= k) & (k < F.col("below__n") + F.col("_n")), F.col("_v")))
        share = F.max(F.when(mine, place - F.floor(place)))
        low, high = at(F.floor(place)), at(F.ceil(place))
        parts.append(F.when(low == high, low).otherwise(low + (high - low) * share).alias(name))
    # a group whose values are all NULL has a row too
    hollow = counts.where("_v IS NULL").select(*by, "_k", F.lit(None).cast("double").alias("_v"), F.lit(0).cast("long").alias("_n"))
    hollow = hollow.withColumns({"below__n": F.lit(0).cast("long"), "all__n": F.lit(0).cast("long")})
    return found.select(*by, "_k", "_v", "_n", "below__n", "all__n").unionByName(hollow).groupBy(*by).agg(*parts)


def with_quantiles(d: DataFrame, by: list[str], plain: list[Column], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """Plain aggregates and exact quantiles of each group, side by side."""
    q = exact_quantiles(d, by, wanted)
    if not by:
        return d.agg(*plain).join(F.broadcast(q))  # one row each
    q = q.withColumnsRenamed({c: f"_q_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return d.groupBy(*by).agg(*plain).join(q, same, "left").drop(*(f"_q_{c}" for c in by))


def quantiles(d: DataFrame, value: str, by: list[str], points: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, and the spread between the quartiles."""
    v = F.col(value)
    g = exact_quantiles(d, by, {**{name: (v, p) for name, p in points.items()}, "_q1": (v, 0.25), "_q3": (v, 0.75)})
    return g.withColumn("iqr", F.col("_q3") - F.col("_q1")).drop("_q1", "_q3")


def in_band(d: DataFrame, band: Column, value: str) -> DataFrame:
    """``(band, value)`` of the rows in a band, written down: counts and quantiles are both made from it."""
    return X.kept(d.select(band.alias("band"), value).where("band IS NOT NULL"))


def banded(d: DataFrame, band: Column, value: str) -> DataFrame:
    """Count, median and 90th percentile of a value by band; rows outside all bands are dropped."""
    d = in_band(d, band, value)
    return with_quantiles(d, ["band"], [F.count("*").alias("n")], {"median": (F.col(value), 0.5), "p90_abs": (F.abs(value), 0.9)})


def banded_spread(d: DataFrame, band: Column, value: str) -> DataFrame:
    """Count, signed and absolute median, spread between the quartiles and 90th percentile of a value by band."""
    d, v = in_band(d, band, value), F.col(value)
    wanted = {"median": (v, 0.5), "median_abs": (F.abs(v), 0.5), "_q1": (v, 0.25), "_q3": (v, 0.75), "p90_abs": (F.abs(v), 0.9)}
    g = with_quantiles(d, ["band"], [F.count("*").alias("n")], wanted)
    return g.withColumn("iqr", F.col("_q3") - F.col("_q1")).drop("_q1", "_q3")


def histogram(d: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    return d.withColumn("bin", X.in_bands(value, edges, "left")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


def average_ranks(d: DataFrame, value: str, by: list[str], name: str, weight: Column | None = None) -> DataFrame:
    """``(by, value, name)``: the rank of each distinct value, ties at their mean; a row counts ``weight`` times.

    Only distinct values with their counts are ranked, range by range, so neither a value that very many rows share nor a group with most
    of the rows makes one task's work.
    """
    n = d.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(F.lit(1) if weight is None else weight).alias("_n"))
    return sums_below(n, value, by, ["_n"]).select(*by, value, (F.col("below__n") + (F.col("_n") + 1) / 2.0).alias(name))


def spearman(d: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    r = d.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    # written down, so that what lies before is worked out once: both ranks are counted from the pairs
    pairs = X.kept(r.groupBy(*by, a, b).agg(F.count("*").alias("_w")))
    pairs = pairs.join(average_ranks(pairs, a, by, "_ra", F.col("_w")), [*by, a]).join(average_ranks(pairs, b, by, "_rb", F.col("_w")), [*by, b])
    # sums of whole numbers (twice the ranks) are exact in any order
    x, y, w = (2 * F.col("_ra")).cast("decimal(12,0)"), (2 * F.col("_rb")).cast("decimal(12,0)"), F.col("_w").cast("decimal(12,0)")
    sums = (("sx", w * x), ("sy", w * y), ("sxx", w * x * x), ("syy", w * y * y), ("sxy", w * x * y))
    g = pairs.groupBy(*by).agg(*(F.sum(e).cast("double").alias(n) for n, e in sums), F.sum("_w").alias("n"))
    n = F.col("n")
    below = F.sqrt((n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy")))
    return g.select(*by, X.ratio(n * F.col("sxy") - F.col("sx") * F.col("sy"), below).alias("rho"), "n")


def circular_mean(d: DataFrame, angle: Column, by: list[str]) -> DataFrame:
    """Mean direction as a fraction of a turn; ``angle`` in turns."""
    a = 2 * F.pi() * angle
    return d.groupBy(*by).agg((F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))) / (2 * F.pi())).alias("mean_turn"))


def column_health(d: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Number and rate of missing values and the median, for each column: the columns are laid under each other."""
    by = by or []
    long = d.unpivot(by, columns, "column", "value")
    plain = [F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_null")]
    g = with_quantiles(long, [*by, "column"], plain, {"median": (F.col("value"), 0.5)})
    return g.withColumn("null_rate", X.ratio(F.col("n_null"), F.col("n")))


def found_by_group(d: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """For each group and column: how many are positive, how many measured, and the median of the positive ones."""
    long = d.unpivot([group], columns, "column", "value")
    pos = F.col("value") > 0
    plain = [F.count_if(pos).alias("found"), F.count("value").alias("total")]
    g = with_quantiles(long, [group, "column"], plain, {"median_found": (F.when(pos, F.col("value")), 0.5)})
    return g.withColumn("share", X.ratio(F.col("found"), F.col("total")))
