"""The six shape features and the searches behind them, on folded and binned curves.

NULL means the question could not be asked; zero means it was asked and the answer is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipfold.functions import expressions as X
from dipfold.operators import batch, detrend
from dipfold.operators import timeseries as T
from dipfold.sources import tables

KEY = T.KEY
LOCAL_BINS, PARITY_BINS, WINDOWS = 201, 25, 4
MAD = 1.4826
FRACTIONS = (4, 6, 8, 12)


def inside(n_bins: int, part: int = 4):
    """Bin centre within D / part of the event: exact in whole numbers."""
    return part * F.abs("c2n") < 2 * n_bins * F.col("duration_us")


def depth(bins: DataFrame, n_bins: int, key: list[str] | None = None) -> DataFrame:
    """Median of the bins outside the dip less that of the bins inside; may be negative."""
    key = key or KEY
    at = inside(n_bins)
    g = bins.groupBy(*key).agg(F.median(F.when(~at, F.col("flux"))).alias("baseline"), F.median(F.when(at, F.col("flux"))).alias("floor"))
    return g.select(*key, "baseline", (F.col("baseline") - F.col("floor")).alias("depth"))


def asymmetry(bins: DataFrame, n_bins: int) -> DataFrame:
    """Depth before the middle less depth after it, over the bins within half a duration; a bin exactly in the middle is in neither."""
    near = inside(n_bins, 2)
    half = lambda side: F.median(F.when(near & side, F.col("flux")))
    g = bins.groupBy(*KEY).agg(half(F.col("c2n") < 0).alias("before"), half(F.col("c2n") > 0).alias("after"))
    return g.select(*KEY, (F.col("after") - F.col("before")).alias("asymmetry"))


def robust_noise(d: DataFrame, value: str, key: list[str] | None = None) -> DataFrame:
    """1.4826 times the median absolute deviation; NULL if that is zero. Two aggregations on one key."""
    key = key or KEY
    level = d.groupBy(*key).agg(F.median(value).alias("_m"))
    dev = d.join(level, key).groupBy(*key).agg(F.median(F.abs(F.col(value) - F.col("_m"))).alias("_d"))
    return dev.select(*key, F.nullif(F.col("_d") * MAD, F.lit(0.0)).alias("noise"))


def snr(bins: DataFrame, n_bins: int) -> DataFrame:
    away = F.abs("c2n") > n_bins * F.col("duration_us")
    noise = robust_noise(bins.where(away), "flux")
    return depth(bins, n_bins).join(noise, KEY, "left").select(*KEY, X.ratio(F.col("depth"), F.col("noise")).alias("snr"))


def width(bins: DataFrame, n_bins: int) -> DataFrame:
    """Hours between the first and last bin centre of the longest run below half depth; one bin gives 0, no run NULL."""
    d = bins.join(depth(bins, n_bins), KEY).withColumn("low", F.col("flux") < F.col("baseline") - F.col("depth") / 2)
    best = T.longest_run(T.runs(d, "low", "idx"))
    step = bins.select(*KEY, "duration_us").distinct()
    hours = (F.col("length") - 1) * WINDOWS * F.col("duration_us") / n_bins / X.HOUR_US
    return step.join(best, KEY, "left").select(*KEY, hours.alias("width_hours"), F.col("length").alias("run_bins"))


def odd_even(d: DataFrame, n_bins: int = PARITY_BINS) -> DataFrame:
    """Difference of the depths of even and odd events, from points near the primary event only."""
    near = T.primary_mask(d).where("in_primary")
    bins = T.local_bins(near, n_bins, WINDOWS, by=("parity",))
    per = depth(bins, n_bins, [*KEY, "parity"])
    value = lambda k: F.max(F.when(F.col("parity") == k, F.col("depth")))
    g = per.groupBy(*KEY).agg(value(0).alias("even"), value(1).alias("odd"))
    return g.select(*KEY, F.abs(F.col("even") - F.col("odd")).alias("odd_even_diff"))


def secondary_bins(d: DataFrame) -> DataFrame:
    """The whole fold in bins of a quarter of the duration, shifted by half their number so the wrap lies in the middle."""
    d = d.withColumn("min_ph", F.min("ph_us").over(Window.partitionBy(*KEY)))
    idx = F.expr("(ph_us - min_ph) * 4 div duration_us")
    carried = ["duration_us", "period_us", "min_ph"]
    full = d.withColumn("idx", idx).groupBy(*KEY, *carried, "idx").agg(F.sum("flux").alias("s"), F.count("flux").alias("n"), F.count("*").alias("n_points"))
    g = T.gridded(full, KEY, carried)
    n = F.count("*").over(Window.partitionBy(*KEY))
    g = g.withColumn("n_bins", n).withColumn("rot", F.expr("pmod(idx + n_bins div 2, n_bins)"))
    return g.withColumn("c8", 8 * F.col("min_ph") + (2 * F.col("idx") + 1) * F.col("duration_us"))


VARIANTS = ("longest", "deepest", "deepest_min2")


def secondary(d: DataFrame, min_points: int = T.MIN_POINTS) -> DataFrame:
    """The deepest dip away from the primary, three ways, and why it could not be looked for.

    ``longest``: the longest run below three noises; ``deepest``: the run with the deepest median; ``deepest_min2``: the same
    among runs of two bins or more. A dip of 0 means none was found. Phases are fractions of the period, the circular mean of the run.
    Levels, noise, runs and their figures are windows by candidate, so the bins are laid out once and aggregated once.
    """
    hidden = F.sum(F.when(F.col("in_sibling"), 1).otherwise(0))
    own = d.groupBy(*KEY, "period_us", "duration_us").agg(F.count("*").alias("n_all"), hidden.alias("n_hidden"))
    own = own.withColumn("excluded", F.col("n_hidden") / F.col("n_all"))
    blanked = 4 * F.col("duration_us") / F.col("period_us")
    guard = F.when((F.col("n_hidden") > 0) & (F.col("n_all") - F.col("n_hidden") < min_points), "too few points left after excluding sibling transits").when(
        20 * F.col("duration_us") >= 4 * F.col("period_us"), F.format_string("blanking covers %.2f of the orbit", blanked)
    )
    own = own.withColumn("guard", guard).drop("period_us", "duration_us")
    one, away = Window.partitionBy(*KEY), F.when(F.abs("c8") > 16 * F.col("duration_us"), F.col("flux"))
    b = secondary_bins(d.where("NOT in_sibling")).withColumn("away", away).withColumn("base", F.median("away").over(one))
    b = b.withColumn("noise", F.nullif(F.median(F.abs(F.col("away") - F.col("base"))).over(one) * MAD, F.lit(0.0)))
    b = b.withColumn("below", F.coalesce(F.col("away") < F.col("base") - 3 * F.col("noise"), F.lit(False)))
    place = F.row_number().over(Window.partitionBy(*KEY, "below").orderBy("rot"))
    b = b.withColumn("part", F.when(F.col("below"), F.col("rot") - place))
    run, turn = Window.partitionBy(*KEY, "below", "part"), 2 * F.pi() * F.col("c8") / 8 / F.col("period_us")
    b = b.withColumns({
        "length": F.count("*").over(run), "early": -F.min("rot").over(run), "dip": F.col("base") - F.median("flux").over(run),
        "at": F.atan2(F.avg(F.sin(turn)).over(run), F.avg(F.cos(turn)).over(run)) / (2 * F.pi()),
    })
    pick = lambda which, *order: F.max(F.when(F.col("below") & which, F.struct(*order, "early", "dip", "at")))
    g = b.groupBy(*KEY).agg(
        F.first("base").alias("base"), F.first("noise").alias("noise"), F.count("away").alias("n_out"), pick(F.lit(True), "length").alias("longest"),
        pick(F.lit(True), F.col("dip").alias("deep")).alias("deepest"), pick(F.col("length") >= 2, F.col("dip").alias("deep")).alias("deepest_min2"),
    )
    res = own.join(g, KEY, "left")
    guard = F.coalesce(
        F.col("guard"),
        F.when(F.coalesce("n_out", F.lit(0)) == 0, "no data outside the blanked primary"),
        F.when(F.col("base").isNull() | F.col("noise").isNull(), "baseline or noise unmeasurable"),
        F.lit(""),
    )
    res = res.withColumn("secondary_guard", guard)
    ok = F.col("secondary_guard") == ""
    cols = [F.when(ok, F.col("noise")).alias("secondary_noise")]
    for name in VARIANTS:
        cols.append(F.when(ok, F.coalesce(F.col(name)["dip"], F.lit(0.0))).alias(f"secondary_depth_{name}"))
        cols.append(F.when(ok, F.col(name)["at"]).alias(f"secondary_phase_fraction_{name}"))
    return res.select(*KEY, F.col("excluded").alias("secondary_exclusion_fraction"), "secondary_guard", *cols)


def shape(bins: DataFrame, n_bins: int) -> DataFrame:
    """Depth, width, asymmetry, snr and occupancy of each candidate at once: levels and runs are windows by candidate, then one aggregation."""
    at, near, one = inside(n_bins), inside(n_bins, 2), Window.partitionBy(*KEY)
    away = F.when(F.abs("c2n") > n_bins * F.col("duration_us"), F.col("flux"))
    b = bins.withColumns({
        "away": away, "base": F.median(F.when(~at, F.col("flux"))).over(one), "floor": F.median(F.when(at, F.col("flux"))).over(one),
        "level": F.median(away).over(one),
    })
    b = b.withColumn("deep", F.col("base") - F.col("floor"))
    b = b.withColumn("low", F.coalesce(F.col("flux") < F.col("base") - F.col("deep") / 2, F.lit(False)))
    place = F.row_number().over(Window.partitionBy(*KEY, "low").orderBy("idx"))
    b = b.withColumn("part", F.when(F.col("low"), F.col("idx") - place))
    b = b.withColumn("length", F.count("*").over(Window.partitionBy(*KEY, "low", "part")))
    half = lambda side: F.median(F.when(near & side, F.col("flux")))
    noise = F.nullif(F.median(F.abs(F.col("away") - F.col("level"))) * MAD, F.lit(0.0))
    longest = F.max(F.when(F.col("low"), F.col("length")))
    return b.groupBy(*KEY).agg(
        F.first("base").alias("baseline"), F.first("deep").alias("depth"), ((longest - 1) * WINDOWS * F.first("duration_us") / n_bins / X.HOUR_US).alias("width"),
        (half(F.col("c2n") > 0) - half(F.col("c2n") < 0)).alias("asymmetry"), X.ratio(F.first("deep"), noise).alias("snr"), *T.occupancy_figures(),
    )


def window_scan(bins: DataFrame, n_bins: int, fractions: tuple[int, ...] = FRACTIONS) -> DataFrame:
    """Depth and number of filled bins for several widths of the dip, from one binned curve: rows ``(key, fraction, depth, n_in)``."""
    cols = []
    for f in fractions:
        at = inside(n_bins, f)
        value = F.median(F.when(~at, F.col("flux"))) - F.median(F.when(at, F.col("flux")))
        cols += [value.alias(f"d{f}"), F.count(F.when(at, F.col("flux"))).alias(f"n{f}")]
    g = bins.groupBy(*KEY).agg(*cols)
    stack = ", ".join(f"{f}, d{f}, n{f}" for f in fractions)
    return g.select(*KEY, F.expr(f"stack({len(fractions)}, {stack}) AS (fraction, depth, n_in)"))


def scanned(curve: DataFrame, koi: DataFrame, n_bins: int = LOCAL_BINS, fractions: tuple[int, ...] = FRACTIONS) -> DataFrame:
    """The window scan of every candidate on its detrended curve; siblings are not masked, so the chain of masks is secondary, primary, none.

    ``depth`` is NULL and ``n_in`` 0 where there is no data inside the window or none outside it.
    """
    d = T.secondary_mask(T.primary_mask(T.folded(curve, koi))).withColumn("in_sibling", F.lit(False))
    d = detrend.flattened(d).withColumn("flux", F.col("flat")).drop("flat", "status")
    out = window_scan(T.local_bins(d, n_bins), n_bins, fractions)
    return out.withColumn("n_in", F.when(F.col("depth").isNull(), F.lit(0)).otherwise(F.col("n_in")).cast("long"))


def curve_to_measure(curve: DataFrame, koi: DataFrame, everything: DataFrame | None = None, detrending: bool = True) -> DataFrame:
    """The folded and masked curve of every candidate, detrended or as it is, written down once for all features."""
    d = T.masked(curve, koi, everything)
    if detrending:
        d = detrend.flattened(d).withColumn("flux", F.col("flat")).drop("flat", "status")
    return X.kept(d.drop("siblings"))


def measured(curve: DataFrame, koi: DataFrame, everything: DataFrame | None = None, n_bins: int = LOCAL_BINS, detrending: bool = True) -> DataFrame:
    """Features and diagnostics of every candidate whose star has a curve, one row each: the six of the model and what tells how they came about."""
    d = curve_to_measure(curve, koi, everything, detrending)
    share = lambda c: F.avg(F.col(c).cast("int"))
    masks = d.groupBy(*KEY).agg(F.first("n_siblings").cast("long").alias("n_siblings"), share("in_sibling").alias("sibling_masked_fraction"))
    out = T.detrend_rung(d).select(*KEY, "detrend_masked_fraction", "detrend_fallback").join(masks, KEY)
    for part in (shape(T.local_bins(d, n_bins), n_bins), odd_even(d), secondary(d)):
        out = out.join(part, KEY, "left")
    return out.withColumn("secondary_depth", F.col("secondary_depth_deepest_min2"))


def assembled(points: DataFrame, products: DataFrame, koi: DataFrame, n_bins: int = LOCAL_BINS, detrending: bool = True) -> DataFrame:
    """Whole rows, one for each row of ``koi``, measured or not: identity, reference, features, diagnostics, error and its kind.

    ``koi`` has ``star_id, koi, disposition, period_us, epoch_us, duration_us, koi_depth_ppm, koi_num_transits``. A candidate that fails its
    precheck, or whose star has no curve, keeps its row with NULL features and the reason; candidates that cannot be measured are siblings
    to the others all the same.

    ``points`` may have an ``error`` (``Type: message``), as archives give it, for a product that could not be read. A star with such a product at the
    wanted cadence is not measured: its rows have the error, and its kind by :func:`batch.classified`.
    """
    failed = None
    if "error" in points.columns:
        chosen = products.where(X.close_to(F.col("exptime_s"), 1800.0)).select("star_id", "product_id")
        failed = points.where("error IS NOT NULL").join(chosen, ["star_id", "product_id"], "left_semi").groupBy("star_id").agg(F.min("error").alias("failure"))
        points = points.where("error IS NULL").drop("error")
    star, koi = F.col("star_id"), koi.withColumn("n_koi_for_star", F.count("*").over(Window.partitionBy("star_id")))
    reason = batch.precheck(F.col("period_us"), F.col("epoch_us"), F.col("duration_us"), F.col("koi_num_transits"))
    koi = koi.withColumn("reason", reason)
    ephemeris = ["star_id", "koi", "period_us", "epoch_us", "duration_us"]
    curve, info = T.loaded(points, products)
    if failed is None:
        info = info.withColumn("failure", F.lit(None).cast("string"))
    else:
        failed = X.kept(failed)
        curve = curve.join(failed, "star_id", "left_anti")
        info = info.join(failed, "star_id", "full")
    found = measured(curve, koi.where("reason IS NULL").select(*ephemeris), koi.select(*ephemeris), n_bins, detrending)
    d = batch.never_lost(koi.join(info, "star_id", "left"), found.withColumn("error_kind", F.lit("")), KEY)
    none = F.when(F.col("n_products_all").isNull(), F.concat(F.lit("no products for star "), star.cast("string"))).otherwise(F.col("no_data"))
    error = F.coalesce("reason", F.substring("failure", 1, 300), F.when(F.col("error_kind") != "", batch.error_text(F.lit("NoDataError"), F.coalesce(none, F.lit("nothing measured")))), F.lit(""))
    unread = batch.failure_kind(F.col("failure"))
    kind = F.when(F.col("reason").isNotNull(), "precheck").when(F.col("failure").isNotNull(), unread).when(F.col("error_kind") != "", "nodata").otherwise("")
    window = F.when(F.col("detrend_fallback") != "none", T.window_points(F.col("duration_us"), F.col("cadence_minutes")))
    d = d.withColumns({
        "error": error, "error_kind": kind, "flatten_window_points": window, "duration_over_period": X.ratio(F.col("duration_us"), F.col("period_us")),
        "kepid": star, "kepoi_name": F.col("koi").cast("string"), "koi_duration_hours": F.col("duration_us") / X.HOUR_US, "koi_period_days": F.col("period_us") / X.DAY_US,
    })
    ok = F.col("error_kind") == ""
    always = {*tables.names(tables.IDENTITY), *tables.names(tables.REFERENCE), "error", "error_kind"}
    blank = lambda c, t: F.when(ok, F.col(c)).otherwise("" if t == "string" else None).cast(t).alias(c)
    return d.select(*(F.col(c).cast(t).alias(c) if c in always else blank(c, t) for c, t in map(str.split, tables.FEATURES.split(", "))))


def local_view(curve: DataFrame, koi: DataFrame, everything: DataFrame | None = None, n_bins: int = LOCAL_BINS, detrending: bool = True) -> DataFrame:
    """What a picture of a candidate's event needs: ``(key, kind, hours, ppm)`` for single points and for filled bins, in ppm from the baseline."""
    d = curve_to_measure(curve, koi, everything, detrending)
    bins = T.local_bins(d, n_bins)
    base = depth(bins, n_bins).select(*KEY, "baseline")
    near = d.where(2 * F.abs("ph_us") < WINDOWS * F.col("duration_us"))
    raw = near.select(*KEY, F.lit("point").alias("kind"), (F.col("ph_us") / X.HOUR_US).alias("hours"), F.col("flux").cast("double").alias("flux"))
    binned = bins.select(*KEY, F.lit("bin").alias("kind"), (F.col("c2n") / (2 * n_bins) / X.HOUR_US).alias("hours"), "flux")
    out = raw.unionByName(binned).where("flux IS NOT NULL").join(base, KEY)
    return out.select(*KEY, "kind", "hours", ((F.col("flux") - F.col("baseline")) * 1e6).alias("ppm"))
