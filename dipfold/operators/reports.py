"""Reports over a feature table, each a table of its own. The input is what :func:`features.assembled` or a checkpoint gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipfold.functions import expressions as X
from dipfold.operators import batch, relational, stats

#: Edges of bands and histograms, limits and names of variants.
DEPTH_BANDS = [0, 100, 300, 1000, 10_000, 1e9]
RATIO_BANDS = [0, 0.01, 0.05, 0.125, 0.25, 10]
IMPACT_BANDS = [0, 0.3, 0.6, 0.85, 1, 10]
OCCUPANCY_BANDS = [-0.001, 1, 2, 4, 8, 16, 32, 64, 128, 1e9]
BIAS_BANDS = [0, 1, 4.5, 15, 50, 1e9]
BUCKETS = [-0.001, 0.001, 1, 2, 4.5, 10, 25, 60, 150, 1e9]
SPARSE = (4.5, 1.0)
PHASE_EDGES = [0, 0.1, 0.2, 0.3, 0.4, 0.45, 0.5001]
VARIANTS = ("longest", "deepest", "deepest_min2")
FLUX_ORIGIN = "pdcsap_flux"
MESSAGE = 60


def latest(d: DataFrame) -> DataFrame:
    return relational.keep_last(d, ["kepoi_name"], "attempt_seq")


def successes(d: DataFrame) -> DataFrame:
    return d.where(batch.succeeded(F.col("error_kind")))


def run_summary(d: DataFrame) -> DataFrame:
    """Rows, stars and successes of the latest attempts."""
    ok = batch.succeeded(F.col("error_kind"))
    g = d.agg(F.count("*").alias("n_rows"), F.countDistinct("kepid").alias("n_stars"), F.count_if(ok).alias("n_success"))
    return g.withColumn("success", X.share_text(F.col("n_success"), F.col("n_rows")))


def class_balance(d: DataFrame) -> DataFrame:
    """Successes by disposition."""
    return stats.value_counts(successes(d), "disposition")


def error_histogram(d: DataFrame) -> DataFrame:
    """Rows of each kind of error, successes among them, and their share of all rows."""
    kinds = d.groupBy(F.coalesce(F.nullif(F.col("error_kind"), F.lit("")), F.lit("(success)")).alias("error_kind")).agg(F.count("*").alias("n"))
    return kinds.withColumn("share", X.ratio(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))))  # a row for each kind


def failure_messages(d: DataFrame, length: int = MESSAGE) -> DataFrame:
    """Failures by the beginning of their message."""
    return stats.value_counts(d.where(~batch.succeeded(F.col("error_kind"))).withColumn("message", F.substring(F.coalesce("error", F.lit("")), 1, length)), "message")


def cadence_sets(d: DataFrame) -> DataFrame:
    """Rows by the set of cadences that the star was seen at."""
    return stats.value_counts(d.withColumn("cadences_seen", F.coalesce("cadences_seen", F.lit(""))), "cadences_seen")


def wrong_origins(d: DataFrame, expected: str = FLUX_ORIGIN) -> DataFrame:
    """How many rows have another origin of the flux than the expected one, whatever its letters' case; none counts as another."""
    other = F.lower(F.coalesce("flux_origin", F.lit(""))) != expected
    return d.agg(F.count("*").alias("n"), F.count_if(other).alias("n_wrong"))


def cadence_mixing(d: DataFrame) -> DataFrame:
    """Rows whose star was seen at several cadences, by origin of the flux."""
    return d.groupBy("flux_origin").agg(F.count("*").alias("n"), F.count_if(F.col("cadences_seen").contains("|")).alias("mixed"))


def with_error(d: DataFrame, positive: bool = False) -> DataFrame:
    """Rows with a measured depth and a positive catalogue depth, with the relative error; with ``positive`` the measured one is positive too."""
    rel = (F.col("depth") * 1e6 - F.col("koi_depth_ppm")) / F.col("koi_depth_ppm")
    kept = d.where("koi_depth_ppm > 0 AND depth IS NOT NULL")
    return (kept.where("depth > 0") if positive else kept).withColumn("rel_error", rel)


def depth_agreement(d: DataFrame) -> DataFrame:
    e, v = with_error(d), F.col("rel_error")
    a = F.abs(v)
    plain = [
        F.count("*").alias("n"), F.avg(v).alias("mean_signed"), F.count_if(a <= 0.15).alias("within_15"), F.count_if(a <= 0.25).alias("within_25"),
        F.count_if(F.col("depth") < 0).alias("negative"), F.max("depth").alias("deepest"),
    ]
    return stats.with_quantiles(e, [], plain, {"median_signed": (v, 0.5), "median_abs": (a, 0.5)})


def impossible_depths(d: DataFrame, limit: float = 0.9) -> DataFrame:
    """Depths that cannot be, and whether the catalogue agrees with them all the same."""
    rel = F.abs(F.col("depth") - F.col("koi_depth_ppm") / 1e6) / F.col("depth")
    return d.where(F.col("depth") > limit).select("kepoi_name", "depth", "koi_depth_ppm", F.coalesce(rel < 0.5, F.lit(False)).alias("catalogue_agrees"))


def error_by_band(d: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    return stats.banded(with_error(d), X.in_bands(value, edges), "rel_error")


def occupancy_percentiles(d: DataFrame) -> DataFrame:
    points = {f"p{int(100 * p)}": p for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95)}
    return stats.quantiles(d.where("local_points_per_bin_median IS NOT NULL"), "local_points_per_bin_median", [], points)


def sparse_counts(d: DataFrame) -> DataFrame:
    """Rows with an occupancy, those below each limit of SPARSE and those of empty bins in the main, and the extremes of the bin counts."""
    v = F.col("local_points_per_bin_median")
    return d.where(v.isNotNull()).agg(
        F.count("*").alias("n"), F.count_if(v < SPARSE[0]).alias("below_4_5"), F.count_if(v < SPARSE[1]).alias("below_1"), F.count_if(v == 0).alias("empty"),
        F.min("n_local_bins").alias("fewest_bins"), F.max("n_local_bins").alias("most_bins"),
    )


def secondary_variants(d: DataFrame) -> DataFrame:
    """For each way to pick the secondary dip: found, zero, median, and how many lie near half a period away."""
    one = lambda v: F.struct(F.lit(v).alias("variant"), F.col(f"secondary_depth_{v}").alias("dip"), F.col(f"secondary_phase_fraction_{v}").alias("at"))
    long = d.select(F.explode(F.array(*map(one, VARIANTS))).alias("x")).select("x.*")
    dip = F.col("dip")
    plain = [
        F.count(dip).alias("measured"), F.count_if(dip > 0).alias("found"), F.count_if(dip == 0).alias("zero"),
        F.count_if((dip > 0) & (F.abs("at") > 0.45)).alias("near_half"),
    ]
    return stats.with_quantiles(long, ["variant"], plain, {"median_found": (F.when(dip > 0, dip), 0.5)})


def guard_causes(d: DataFrame) -> DataFrame:
    return stats.value_counts(d.where("coalesce(secondary_guard, '') <> ''").withColumn("cause", batch.cause(F.col("secondary_guard"))), "cause")


def secondary_phases(d: DataFrame, variant: str = "deepest_min2") -> DataFrame:
    found = d.where(F.col(f"secondary_depth_{variant}") > 0)
    return stats.histogram(found, F.abs(f"secondary_phase_fraction_{variant}"), PHASE_EDGES)


def variants_by_disposition(d: DataFrame) -> DataFrame:
    return stats.found_by_group(d, "disposition", [f"secondary_depth_{v}" for v in VARIANTS])


def multi_against_single(d: DataFrame) -> DataFrame:
    multi = F.when(F.col("n_koi_for_star") > 1, "multi").otherwise("single")
    return stats.found_by_group(d.withColumn("kind", multi), "kind", [f"secondary_depth_{v}" for v in VARIANTS])


def masked_fraction(d: DataFrame) -> DataFrame:
    plain = [F.count("*").alias("n"), F.max("detrend_masked_fraction").alias("largest")]
    return stats.with_quantiles(d, ["detrend_fallback"], plain, {"median": (F.col("detrend_masked_fraction"), 0.5)})


def occupancy_bias(d: DataFrame) -> DataFrame:
    """Depth error by the number of points in a bin."""
    return stats.banded(with_error(d), X.in_bands(F.col("local_points_per_bin_median"), OCCUPANCY_BANDS), "rel_error")


def impact_bias(d: DataFrame) -> DataFrame:
    """Depth error by impact parameter, from rows that carry ``koi_impact``."""
    return stats.banded_spread(with_error(d, positive=True).where("koi_impact IS NOT NULL"), X.in_bands(F.col("koi_impact"), IMPACT_BANDS), "rel_error")


def sparse_bias(d: DataFrame) -> DataFrame:
    """Depth error by points in a bin, in the bands that decide the number of bins."""
    return stats.banded_spread(with_error(d, positive=True), X.in_bands(F.col("local_points_per_bin_median"), BIAS_BANDS), "rel_error")


def occupancy_buckets(d: DataFrame) -> DataFrame:
    """Depth error by points in a bin, in buckets that leave no row out; zero is a bucket of its own."""
    return stats.banded_spread(with_error(d, positive=True), X.in_bands(F.col("local_points_per_bin_median"), BUCKETS), "rel_error")


def sparse_against_rest(d: DataFrame) -> DataFrame:
    """For each limit of SPARSE: number and median absolute error of the rows below it and of the others, and the difference."""
    e = with_error(d, positive=True).where("local_points_per_bin_median IS NOT NULL")
    side = lambda t: F.struct(F.lit(t).alias("limit"), (F.col("local_points_per_bin_median") < t).alias("below"), F.abs("rel_error").alias("a"))
    long = e.select(F.explode(F.array(*map(side, SPARSE))).alias("x")).select("x.*")
    below, a = F.col("below"), F.col("a")
    plain = [F.count_if(below).alias("n_below"), F.count_if(~below).alias("n_rest")]
    g = stats.with_quantiles(long, ["limit"], plain, {"median_below": (F.when(below, a), 0.5), "median_rest": (F.when(~below, a), 0.5)})
    return g.where("n_below > 0").withColumn("delta", F.col("median_below") - F.col("median_rest"))


def error_rank_correlation(d: DataFrame, other: str, absolute: bool = False, positive: bool = False, above: float | None = None) -> DataFrame:
    """Spearman correlation of the (absolute) error with another column, over rows where that is ``above`` a limit if there is one."""
    e = with_error(d, positive)
    e = e if above is None else e.where(F.col(other) > above)
    return stats.spearman(e.withColumn("rel_error", F.abs("rel_error")) if absolute else e, "rel_error", other, [])


def window_scan_summary(scan: DataFrame, sparse_below: float | None = None) -> DataFrame:
    """Error, spread and bins used for each width of the depth window, from rows with ``d4 .. d12``, ``n4 .. n12``, the catalogue depth and ``ppb``."""
    rows = scan if sparse_below is None else scan.where(F.col("ppb") < sparse_below)
    stack = "stack(4, 4, d4, n4, 6, d6, n6, 8, d8, n8, 12, d12, n12) AS (fraction, depth, used)"
    long = rows.select("koi_depth_ppm", F.expr(stack)).where("depth IS NOT NULL AND koi_depth_ppm > 0")
    rel = (F.col("depth") * 1e6 - F.col("koi_depth_ppm")) / F.col("koi_depth_ppm")
    wanted = {"median": (rel, 0.5), "median_abs": (F.abs(rel), 0.5), "_q1": (rel, 0.25), "_q3": (rel, 0.75), "median_used": (F.col("used"), 0.5)}
    g = stats.with_quantiles(long, ["fraction"], [F.count("*").alias("n")], wanted)
    return g.withColumn("iqr", F.col("_q3") - F.col("_q1")).drop("_q1", "_q3")
