"""Operators on long light curves: cleaning, folding, masks, binning, runs.

A curve is rows ``(star_id, t_us, flux)``; a candidate is a row ``(star_id, koi, period_us, epoch_us, duration_us)``. Curve and
candidates meet once, by ``star_id``; everything after that stays partitioned by ``(star_id, koi)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipfold.functions import expressions as X

KEY = ["star_id", "koi"]
MIN_POINTS = 50
MIN_SHARE = 0.25


def deduplicated(curve: DataFrame) -> DataFrame:
    """One point per time stamp, the first product's; adds nothing."""
    first = Window.partitionBy("star_id", "t_us").orderBy(*[c for c in ("product_id", "flux") if c in curve.columns])
    return curve.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def duplicate_times(curve: DataFrame) -> DataFrame:
    n = F.count("*") - F.countDistinct("t_us")
    return curve.groupBy("star_id").agg(F.count("*").alias("n_points"), n.alias("n_duplicate_times"))


def cadence(curve: DataFrame) -> DataFrame:
    """Median gap in minutes per star."""
    gap = F.col("t_us") - F.lag("t_us").over(Window.partitionBy("star_id").orderBy("t_us"))
    return curve.withColumn("gap", gap).groupBy("star_id").agg((F.median("gap") / 60e6).alias("cadence_minutes"), F.count("*").alias("n_points"))


def clipped(curve: DataFrame, upper: float = 5.0, lower: float = 20.0, rounds: int = 5) -> DataFrame:
    """Drop points more than ``upper`` deviations above or ``lower`` below the median of their star, up to ``rounds`` times.

    All rounds are windows by star, so one shuffle serves them; a round that drops nothing leaves nothing for the next.
    """
    w = Window.partitionBy("star_id")
    for _ in range(rounds):
        curve = curve.withColumns({"_m": F.median("flux").over(w), "_s": F.stddev_pop("flux").over(w)})
        keep = (F.col("flux") <= F.col("_m") + upper * F.col("_s")) & (F.col("flux") >= F.col("_m") - lower * F.col("_s"))
        curve = curve.where(F.col("flux").isNull() | keep).drop("_m", "_s")
    return curve


def enough_points(curve: DataFrame, least: int = MIN_POINTS) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("star_id"))
    return curve.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def stitched(curve: DataFrame) -> DataFrame:
    """Each product's flux divided by its median, then taken together."""
    level = F.median("flux").over(Window.partitionBy("star_id", "product_id"))
    return curve.withColumn("flux", X.ratio(F.col("flux"), level))


def loaded(points: DataFrame, products: DataFrame, exptime_s: float = 1800.0) -> tuple[DataFrame, DataFrame]:
    """The cleaned curve of every star at one cadence, and one row about each star: ``(curve, info)``.

    Products of that cadence are stitched, sorted into one curve without repeated times, clipped, and held against the least number of
    points. ``info`` has ``n_products_all, n_products_used, cadences_seen, flux_origin, n_raw_points, n_duplicate_times, cadence_minutes``
    and ``no_data``, the reason why there is no curve (NULL if there is one). Stars without a product have no row.
    """
    is_it = X.close_to(F.col("exptime_s"), exptime_s)
    of_star = products.groupBy("star_id").agg(
        F.count("*").alias("n_products_all"), F.count_if(is_it).alias("n_products_used"),
        F.array_join(F.sort_array(F.collect_set(F.rint("exptime_s").cast("int"))), "|").alias("cadences_seen"),
        F.min_by(F.when(is_it, F.col("flux_origin")), F.when(is_it, F.col("product_id"))).alias("flux_origin"),
    )
    chosen = products.where(is_it).select("star_id", "product_id")
    whole = stitched(points.join(chosen, ["star_id", "product_id"], "left_semi"))
    number = lambda: F.count("*").over(Window.partitionBy("star_id"))
    once = deduplicated(whole.withColumn("_all", number()))
    gap = F.col("t_us") - F.lag("t_us").over(Window.partitionBy("star_id").orderBy("t_us"))
    clean = X.kept(clipped(once.withColumn("_again", F.col("_all") - number())).withColumn("_gap", gap))
    measured = clean.groupBy("star_id").agg(
        F.count("*").alias("n_raw_points"), F.max("_again").cast("long").alias("n_duplicate_times"), (F.median("_gap") / 60e6).alias("cadence_minutes")
    )
    info = of_star.join(measured, "star_id", "left").withColumn("n_raw_points", F.coalesce("n_raw_points", F.lit(0)).cast("long"))
    star, used = F.col("star_id").cast("string"), F.col("n_products_used")
    why = F.when(used == 0, F.concat(F.lit(f"no {int(exptime_s)}s products for star "), star, F.lit("; available: "), F.col("cadences_seen"))).when(
        F.col("n_raw_points") < MIN_POINTS, F.concat(F.lit("only "), F.col("n_raw_points").cast("string"), F.lit(" points left after cleaning star "), star, F.lit(f" (floor is {MIN_POINTS})"))
    ).when(~(F.col("cadence_minutes") > 0), F.concat(F.lit("no cadence for star "), star))
    return enough_points(clean).select("star_id", "t_us", "flux"), info.withColumn("no_data", why)


def folded(curve: DataFrame, koi: DataFrame) -> DataFrame:
    """Every point of a star with each of the star's candidates: ``ph_us``, ``cycle`` and ``parity`` are added."""
    d = koi.join(curve, "star_id")
    t, p, e = F.col("t_us"), F.col("period_us"), F.col("epoch_us")
    d = d.withColumns({"ph_us": X.phase(t, p, e), "cycle": X.cycle(t, p, e)})
    return d.withColumn("parity", F.pmod("cycle", F.lit(2)))


def primary_mask(d: DataFrame) -> DataFrame:
    return d.withColumn("in_primary", X.near_event(F.col("ph_us"), F.col("duration_us")))


def secondary_mask(d: DataFrame) -> DataFrame:
    """Primary, or near half a period from it."""
    away = F.abs(2 * F.abs("ph_us") - F.col("period_us"))
    return d.withColumn("in_secondary", F.col("in_primary") | (away < 3 * F.col("duration_us")))


def with_siblings(koi: DataFrame, everything: DataFrame) -> DataFrame:
    """Adds ``siblings``, the ephemerides of the star's other candidates in the unfiltered table, as an array on the candidate's row."""
    one = F.struct("koi", "period_us", "epoch_us", "duration_us")
    per = everything.groupBy("star_id").agg(F.sort_array(F.collect_list(one)).alias("_all"))
    own = F.filter("_all", lambda s: s["koi"] != F.col("koi"))
    none = F.array().cast(f"array<struct<koi:{dict(koi.dtypes)['koi']},period_us:bigint,epoch_us:bigint,duration_us:bigint>>")
    out = koi.join(per, "star_id", "left").withColumn("siblings", F.coalesce(own, none))
    return out.drop("_all").withColumn("n_siblings", F.size("siblings"))


def sibling_mask(d: DataFrame) -> DataFrame:
    """Near an event of any valid sibling. The siblings sit on the row, so the curve is not multiplied by them."""

    def hit(s: Column) -> Column:
        valid = (s["period_us"] > 0) & (s["duration_us"] > 0) & s["epoch_us"].isNotNull()
        return F.coalesce(F.when(valid, X.near_event(X.phase(F.col("t_us"), s["period_us"], s["epoch_us"]), s["duration_us"])), F.lit(False))

    return d.withColumn("in_sibling", F.coalesce(F.exists("siblings", hit), F.lit(False)))


def masked(curve: DataFrame, koi: DataFrame, everything: DataFrame | None = None) -> DataFrame:
    d = folded(curve, with_siblings(koi, koi if everything is None else everything))
    return sibling_mask(secondary_mask(primary_mask(d)))


def detrend_rung(d: DataFrame, least: float = MIN_SHARE) -> DataFrame:
    """The widest mask that leaves ``least`` of the points: full, then without siblings, then the primary alone, else none."""
    n = F.count("*")
    share = lambda c: X.ratio(F.sum(F.when(~c, 1).otherwise(0)), n)
    a, b, c = F.col("in_secondary") | F.col("in_sibling"), F.col("in_secondary"), F.col("in_primary")
    g = d.groupBy(*KEY).agg(n.alias("n_points"), share(a).alias("open_full"), share(b).alias("open_secondary"), share(c).alias("open_primary"))
    rung = F.when(F.col("open_full") >= least, "").when(F.col("open_secondary") >= least, "secondary_only").when(F.col("open_primary") >= least, "primary_only").otherwise("none")
    open_ = F.when(F.col("open_full") >= least, F.col("open_full")).when(F.col("open_secondary") >= least, F.col("open_secondary")).when(F.col("open_primary") >= least, F.col("open_primary")).otherwise(0.0)
    return g.withColumn("detrend_fallback", rung).withColumn("detrend_masked_fraction", 1 - open_)


def window_points(duration_us: Column, cadence_minutes: Column) -> Column:
    """Detrending window: three durations in points, cut to a whole number, at least five, odd."""
    n = F.greatest(F.floor(3 * duration_us / 60e6 / cadence_minutes).cast("int"), F.lit(5))
    return F.when(n % 2 == 0, n + 1).otherwise(n)


def local_bins(d: DataFrame, n_bins: int, n_windows: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """Fixed-width bins of the folded curve around the event, empty ones included.

    The slice is ``|phase| < D * n_windows / 2``, bins are ``D * n_windows / n_bins`` wide and begin at the smallest phase present.
    ``c2n`` is the bin centre in units of 1 / (2 n_bins) microseconds, a whole number; ``flux`` is the mean, NULL if the bin is empty.
    The slice's minimum is a window over the key by which the bins are then grouped: one shuffle for both.
    """
    key = [*KEY, *by]
    d = d.where(2 * F.abs("ph_us") < n_windows * F.col("duration_us"))
    d = d.withColumn("min_ph", F.min("ph_us").over(Window.partitionBy(*key)))
    idx = F.expr(f"(ph_us - min_ph) * {n_bins} div ({n_windows} * duration_us)")
    full = d.withColumn("idx", idx).groupBy(*key, "duration_us", "min_ph", "idx").agg(F.sum("flux").alias("s"), F.count("flux").alias("n"), F.count("*").alias("n_points"))
    return gridded(full, key, ["duration_us", "min_ph"]).withColumn(
        "c2n", 2 * n_bins * F.col("min_ph") + (2 * F.col("idx") + 1) * n_windows * F.col("duration_us")
    )


def gridded(full: DataFrame, key: list[str], carried: list[str]) -> DataFrame:
    """A row for each bin from 0 to the last that is filled: the key's bins are laid on a sequence in place, without another join."""
    cells = F.sort_array(F.collect_list(F.struct("idx", "s", "n", "n_points")))
    g = full.groupBy(*key, *carried).agg(cells.alias("cells"), F.max("idx").alias("top"))
    g = g.withColumn("cells", F.map_from_entries(F.transform("cells", lambda c: F.struct(c["idx"], F.struct(c["s"], c["n"], c["n_points"])))))
    g = g.select(*key, *carried, "cells", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("idx"))
    cell = F.try_element_at("cells", F.col("idx"))
    flux = X.ratio(cell["s"], cell["n"])
    return g.select(*key, *carried, "idx", flux.alias("flux"), F.coalesce(cell["n_points"], F.lit(0)).cast("long").alias("n_points"))


def occupancy_figures() -> list[Column]:
    filled = F.sum(F.when(F.col("n_points") > 0, 1).otherwise(0))
    return [
        F.sum("n_points").alias("n_local_points"), F.count("*").alias("n_local_bins"), filled.alias("n_local_bins_filled"),
        F.median("n_points").alias("local_points_per_bin_median"),
    ]


def occupancy(bins: DataFrame) -> DataFrame:
    return bins.groupBy(*KEY).agg(*occupancy_figures())


def runs(d: DataFrame, flag: str, order: str, key: list[str] | None = None) -> DataFrame:
    """Half-open runs ``[first, stop)`` of rows where ``flag`` holds, ``order`` being a gapless index. NULL flags break runs."""
    key = key or KEY
    w = Window.partitionBy(*key).orderBy(order)
    d = d.where(F.coalesce(F.col(flag), F.lit(False))).withColumn("_part", F.col(order) - F.row_number().over(w))
    return d.groupBy(*key, "_part").agg(F.min(order).alias("first"), (F.max(order) + 1).alias("stop"), F.count("*").alias("length")).drop("_part")


def longest_run(found: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The longest run of each key, the first of equals."""
    key = key or KEY
    best = Window.partitionBy(*key).orderBy(F.desc("length"), F.asc("first"))
    return found.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
