"""Literal cases of the operators: edges, ties, missing values, and the kernel that has no SQL."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dipfold.functions import expressions as X
from dipfold.operators import batch, boosting, detrend, features, learning, relational, reports, stats
from dipfold.operators import timeseries as T
from dipfold.sources import tables
from tests import kernel

DAY, HOUR = X.DAY_US, X.HOUR_US


def one(df):
    return df.collect()[0]


def curve_of(spark, period=3 * DAY, epoch=DAY, duration=4 * HOUR, depth=0.01, odd_extra=0.0, second=0.0, slope=0.0, step=17 * 60 * 10**6, days=60, gap=None):
    t = np.arange(0, days * DAY, step)
    if gap:
        t = t[(t < gap[0]) | (t >= gap[1])]
    ph = (t - epoch + period // 2) % period - period // 2
    cyc = np.rint((t - epoch) / period)
    flux = np.ones(len(t))
    flux[np.abs(ph) < duration / 2] -= depth
    flux[(np.abs(ph) < duration / 2) & (cyc % 2 == 1)] -= odd_extra
    flux[np.abs(np.abs(ph) - period / 2) < duration / 2] -= second
    noise = np.sin(np.arange(len(t)) * 12.9898) * 1e-4
    curve = spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(t, (flux + noise) * (1 + slope * t / DAY), strict=True)], "star_id long, t_us long, flux double")
    koi = spark.createDataFrame([(1, 1, period, epoch, duration)], "star_id long, koi long, period_us long, epoch_us long, duration_us long")
    return curve, koi


def test_phase_and_cycle(spark):
    rows = [(0, 10, 0), (5, 10, 0), (-5, 10, 0), (-6, 10, 0), (15, 10, 0), (25, 10, 0), (4, 9, 0), (5, 9, 0)]
    d = spark.createDataFrame(rows, "t long, p long, e long")
    got = [tuple(r) for r in d.select(X.phase(F.col("t"), F.col("p"), F.col("e")), X.cycle(F.col("t"), F.col("p"), F.col("e"))).collect()]
    assert got == [(0, 0), (-5, 0), (-5, 0), (4, -1), (-5, 2), (-5, 2), (4, 0), (-4, 1)]


def test_features_of_a_box_dip(spark):
    curve, koi = curve_of(spark, depth=0.01, odd_extra=0.004, second=0.003)
    f = one(features.measured(curve, koi, detrending=False))
    assert f.depth == pytest.approx(0.012, abs=0.003)
    assert f.width == pytest.approx(4.0, rel=0.2)
    assert abs(f.asymmetry) < 0.004 and f.snr > 10
    assert f.odd_even_diff == pytest.approx(0.004, rel=0.2)
    assert f.secondary_depth == pytest.approx(0.003, rel=0.2) and abs(f.secondary_phase_fraction_deepest_min2) == pytest.approx(0.5, abs=0.02)
    assert f.secondary_guard == "" and f.detrend_fallback == ""


def test_flat_curve_has_no_secondary_and_unmeasured_is_null(spark):
    curve, koi = curve_of(spark, depth=0.0)
    assert one(features.measured(curve, koi, detrending=False)).secondary_depth == 0.0
    other = koi.withColumn("star_id", F.lit(2).cast("long"))
    assert features.measured(curve, other, detrending=False).count() == 0


def test_no_row_is_lost(spark):
    """Whole rows: measured, failed precheck, another cadence only, too few points, no product at all; siblings count although they cannot be measured."""
    curve, _ = curve_of(spark, depth=0.01)
    points = curve.selectExpr("star_id", "'q1' AS product_id", "t_us", "flux").cache()
    more = spark.createDataFrame([(2, "a", DAY, 1.0)] + [(3, "s", k * HOUR, 1.0) for k in range(90)] + [(1, "q1", 0, 1.0)], "star_id long, product_id string, t_us long, flux double")
    points = points.unionByName(more)
    products = spark.createDataFrame([(1, "q1", 1800.0, "pdcsap_flux"), (1, "fast", 60.0, "x"), (2, "a", 1800.2e0 - 0.2, "y"), (3, "s", 60.0, "z")], "star_id long, product_id string, exptime_s double, flux_origin string")
    koi = [(1, 1, "CONFIRMED", 3 * DAY, DAY, 4 * HOUR, 1e4, 5.0), (1, 2, "CANDIDATE", None, DAY, 4 * HOUR, 1e4, 5.0), (2, 1, "CANDIDATE", DAY, 0, HOUR, None, None), (3, 1, "FALSE POSITIVE", DAY, 0, HOUR, None, 1.0), (4, 1, "CANDIDATE", DAY, 0, HOUR, None, 1.0)]
    koi = spark.createDataFrame(koi, "star_id long, koi long, disposition string, period_us long, epoch_us long, duration_us long, koi_depth_ppm double, koi_num_transits double")
    for detrending in (True, False):
        out = features.assembled(points, products, koi, 51, detrending)
        assert out.dtypes == spark.createDataFrame([], tables.FEATURES).dtypes
        got = {(r.kepid, r.kepoi_name): r for r in out.collect()}
        assert {k: (r.error_kind, r.error) for k, r in got.items()} == {
            (1, "1"): ("", ""), (1, "2"): ("precheck", "koi_period missing or non-positive"), (2, "1"): ("nodata", "NoDataError: only 1 points left after cleaning star 2 (floor is 50)"),
            (3, "1"): ("nodata", "NoDataError: no 1800s products for star 3; available: 60"), (4, "1"): ("nodata", "NoDataError: no products for star 4"),
        }
        ok = got[1, "1"]
        assert ok.depth == pytest.approx(0.01, rel=0.1) and ok.n_siblings == 1 and ok.n_koi_for_star == 2 and ok.sibling_masked_fraction == 0.0
        assert (ok.n_products_all, ok.n_products_used, ok.cadences_seen, ok.flux_origin, ok.n_duplicate_times) == (2, 1, "60|1800", "pdcsap_flux", 1)
        assert ok.flatten_window_points % 2 == 1 and ok.koi_period_days == 3.0 and ok.duration_over_period == pytest.approx(4 / 72)
        assert got[1, "2"].depth is None and got[1, "2"].cadences_seen == "" and got[1, "2"].koi_depth_ppm == 1e4


def naive_features(t, flux, period, epoch, duration, n_bins):
    """Depth, asymmetry, snr and width of one detrended curve in plain NumPy, from phases in microseconds."""
    ph = (t - epoch + period // 2) % period - period // 2
    near = np.abs(ph) < 2 * duration
    ph, flux = ph[near], flux[near]
    start, step = ph.min(), 4 * duration / n_bins
    idx = ((ph - start) * n_bins // (4 * duration)).astype(int)
    centre = start + (np.arange(idx.max() + 1) + 0.5) * step
    mean = np.array([flux[idx == k].mean() if (idx == k).any() else np.nan for k in range(idx.max() + 1)])
    inside = np.abs(centre) < duration / 4
    base = np.nanmedian(mean[~inside])
    depth = base - np.nanmedian(mean[inside])
    half = np.abs(centre) < duration / 2
    asymmetry = np.nanmedian(mean[half & (centre > 0)]) - np.nanmedian(mean[half & (centre < 0)])
    away = mean[np.abs(centre) > duration / 2]
    noise = 1.4826 * np.nanmedian(np.abs(away - np.nanmedian(away)))
    best = run = 0
    for low in mean < base - depth / 2:
        run = run + 1 if low else 0
        best = max(best, run)
    return depth, asymmetry, depth / noise, (best - 1) * step / HOUR


def test_failures_reach_their_rows(spark):
    """Products that could not be read, each with its class: the others are measured all the same, a failed precheck comes first, other cadences do not count."""
    curve, koi = curve_of(spark)
    errors = {2: "OSError: [Errno 28] No space left on device", 3: "CorruptFileError: error in reading data product: x", 4: "ConnectionResetError: reset", 5: "KeyError: 'a'", 6: None, 7: "OSError: x", 8: "NoDataError: none"}
    points = curve.withColumns({"product_id": F.lit("p"), "error": F.lit(None).cast("string")}).select("star_id", "product_id", "t_us", "flux", "error")
    star = koi.first().star_id
    more = [(s, "p", None, None, e) for s, e in errors.items()] + [(star, "short", None, None, "OSError: of another cadence")]
    points = points.union(spark.createDataFrame(more, "star_id long, product_id string, t_us long, flux double, error string"))
    products = spark.createDataFrame([(s, "p", 1800.0, "o") for s in (star, *errors)] + [(star, "short", 60.0, "o")], "star_id long, product_id string, exptime_s double, flux_origin string")
    one_of = koi.select("star_id", "koi", F.lit("CONFIRMED").alias("disposition"), "period_us", "epoch_us", "duration_us", F.lit(1.0).alias("koi_depth_ppm"), F.lit(3.0).alias("koi_num_transits"))
    every = one_of
    for s in errors:
        every = every.union(one_of.withColumns({"star_id": F.lit(s).cast("long"), "period_us": F.lit(None).cast("long") if s == 7 else F.col("period_us")}))
    got = {r.kepid: r for r in features.assembled(points, products, every, 51).collect()}
    assert {s: r.error_kind for s, r in got.items()} == {star: "", 2: "diskfull", 3: "corruptcache", 4: "transient", 5: "unknown", 6: "nodata", 7: "precheck", 8: "nodata"}
    assert got[star].depth == pytest.approx(0.01, rel=0.1) and got[2].depth is None and got[2].error == errors[2] and got[2].cadences_seen == ""


def test_a_kernel_that_raises_costs_its_group_alone(spark):
    def kernel(g):
        k = g.column("k")[0].as_py()
        if k is None or k % 3:
            raise {1: TimeoutError, 2: batch.NoDataError, None: MemoryError}[k and k % 3](f"group {k} " + "x" * 400)
        return g.group_by("k").aggregate([("v", "sum")]).rename_columns(["k", "total"])

    d = spark.createDataFrame([(k, 1.0) for k in (0, 0, 1, 2, 3, None)], "k long, v double")
    got = {r.k: r for r in batch.attempted(d, ["k"], kernel, "k long, total double").collect()}
    assert {k: (r.total, r.error_kind) for k, r in got.items()} == {0: (2.0, ""), 3: (1.0, ""), 1: (None, "transient"), 2: (None, "nodata"), None: (None, "unknown")}
    assert got[1].error.startswith("TimeoutError: group 1 xxx") and len(got[1].error) == 300 and got[0].error == ""


def test_features_of_a_detrended_curve_equal_plain_numpy(spark):
    curve, koi = curve_of(spark, depth=0.01, slope=0.002, gap=(20 * DAY, 25 * DAY))
    k = koi.first()
    rows = sorted((r.t_us, r.flux + 1e-4 * math.sin(r.t_us / HOUR * 37)) for r in curve.collect())
    t, flux = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    curve = spark.createDataFrame([(k.star_id, *r) for r in rows], "star_id long, t_us long, flux double")
    ph = np.abs((t - k.epoch_us + k.period_us // 2) % k.period_us - k.period_us // 2)
    mask = (2 * ph < 3 * k.duration_us) | (np.abs(2 * ph - k.period_us) < 3 * k.duration_us)
    cadence = np.median(np.diff(t))
    window = max(int(3 * k.duration_us / cadence), 5)
    window += window % 2 == 0
    flat = np.empty(len(t))
    for part in np.split(np.arange(len(t)), np.flatnonzero(np.diff(t) > 5 * cadence) + 1):
        seen = part[~mask[part]]
        flat[part] = flux[part] / plain_trend(np.interp(t[part], t[seen], flux[seen]), window)
    got = one(features.measured(curve, koi, n_bins=101))
    want = naive_features(t, flat, k.period_us, k.epoch_us, k.duration_us, 101)
    assert (got.depth, got.asymmetry, got.snr, got.width) == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_local_view(spark):
    curve, koi = curve_of(spark, depth=0.01)
    got = features.local_view(curve, koi, n_bins=51, detrending=False).collect()
    kinds = {r.kind for r in got}
    assert kinds == {"point", "bin"} and min(r.ppm for r in got if r.kind == "bin") == pytest.approx(-1e4, rel=0.2)
    assert max(abs(r.hours) for r in got) <= 2 * koi.first().duration_us / HOUR


def test_secondary_guards(spark):
    curve, koi = curve_of(spark, duration=15 * HOUR, period=3 * DAY)
    assert "blanking covers 0.83" in one(features.measured(curve, koi, detrending=False)).secondary_guard
    few, koi = curve_of(spark, days=0.5)
    assert not one(features.measured(few, koi, detrending=False)).secondary_guard.startswith("too few")  # few from the start is not the siblings' doing
    both = koi.union(spark.createDataFrame([(1, 2, DAY, 0, 12 * HOUR)], koi.schema))
    f = one(features.measured(few, koi, both, detrending=False))
    assert f.secondary_guard == "too few points left after excluding sibling transits" and f.secondary_exclusion_fraction == 1.0


def test_time_shift_changes_nothing(spark):
    curve, koi = curve_of(spark, second=0.003)
    shift = 7 * DAY + 12345678
    a = one(features.measured(curve, koi, detrending=False))
    b = one(features.measured(curve.withColumn("t_us", F.col("t_us") + shift), koi.withColumn("epoch_us", F.col("epoch_us") + shift), detrending=False))
    for c in ("depth", "width", "asymmetry", "snr", "odd_even_diff", "secondary_depth"):
        assert a[c] == pytest.approx(b[c], rel=1e-9)


def test_empty_bins_break_runs(spark):
    d = spark.createDataFrame([(1, 1, i, f) for i, f in enumerate([True, True, None, True, False, True, True])], "star_id long, koi long, idx long, low boolean")
    got = sorted((r["first"], r["stop"], r["length"]) for r in T.runs(d, "low", "idx").collect())
    assert got == [(0, 2, 2), (3, 4, 1), (5, 7, 2)]
    assert one(T.longest_run(T.runs(d, "low", "idx")))["first"] == 0


def test_siblings(spark):
    koi = spark.createDataFrame([(1, 1, 10 * DAY, 0, HOUR), (1, 2, 0, 0, HOUR), (1, 3, 7 * DAY, DAY, 2 * HOUR), (2, 1, DAY, 0, HOUR)], "star_id long, koi long, period_us long, epoch_us long, duration_us long")
    n = {(r.star_id, r.koi): r.n_siblings for r in T.with_siblings(koi, koi).collect()}
    assert n == {(1, 1): 2, (1, 2): 2, (1, 3): 2, (2, 1): 0}
    curve = spark.createDataFrame([(1, DAY, 1.0), (1, 8 * DAY + 2 * HOUR, 1.0), (1, 3 * DAY, 1.0)], "star_id long, t_us long, flux double")
    d = T.masked(curve, koi.where("star_id = 1 AND koi = 1"), koi)
    assert [r.in_sibling for r in d.orderBy("t_us").collect()] == [True, False, True]


def plain_trend(y, window, order=2):
    """Least squares in each window, by polyfit."""
    n, half = len(y), window // 2
    if n < window:
        return np.full(n, np.median(y))
    out = np.empty(n)
    for i in range(n):
        k = min(max(i, half), n - 1 - half)
        x = np.arange(window) - half
        out[i] = np.polyval(np.polyfit(x, y[k - half : k + half + 1], order), i - k)
    return out


def test_savitzky_golay():
    assert kernel.coefficients(5) * 35 == pytest.approx([-3, 12, 17, 12, -3])
    y = np.random.default_rng(1).normal(size=60)
    for window in (5, 7, 21):
        assert kernel.trend(y, window) == pytest.approx(plain_trend(y, window))
    assert kernel.trend(y[:4], 5) == pytest.approx(np.full(4, np.median(y[:4])))


def test_flatten_keeps_the_dip_and_drops_the_trend(spark):
    curve, koi = curve_of(spark, depth=0.01, slope=0.002, gap=(20 * DAY, 25 * DAY))
    flat = detrend.flattened(T.masked(curve, koi))
    assert {r.status for r in flat.select("status").distinct().collect()} == {""}
    d = flat.withColumn("flux", F.col("flat"))
    assert one(features.measured(curve, koi)).depth == pytest.approx(0.01, rel=0.05)
    away = one(d.where("NOT in_secondary").agg(F.min("flux").alias("a"), F.max("flux").alias("b")))
    assert away.a > 0.998 and away.b < 1.002


def test_flatten_equals_plain_numpy(spark):
    """Random curves: gaps, missing and infinite points, masks of every rung and none, segments shorter than the window and all masked, few points."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for star in range(24):
        n = int(rng.choice([1, 2, 30, 200, 700]))
        t = np.cumsum(rng.integers(900, 1100, n) * 10**6 * np.where(rng.random(n) < 0.02, 40, 1))
        flux = 1000.0 + np.cumsum(rng.normal(size=n)) + 20 * np.sin(np.arange(n) / 9)
        flux[rng.random(n) < 0.03] = np.nan
        duration = int(rng.choice([1000, 9000, 40_000])) * 10**6
        far = rng.random((3, n)) < np.array([0.05, rng.choice([0.1, 0.5]), rng.choice([0.2, 0.9])])[:, None]
        primary, secondary, sibling = far[0] | (star % 7 == 3) | ((t > t[n // 2]) & (star % 5 == 1)), far[0] | far[1] | (star % 7 == 3), far[2]
        if star == 5:
            t[:] = 7
        if star == 6:
            flux[n // 2] = np.inf
        mask, cadence = kernel.rung(primary, secondary, sibling), np.median(np.diff(t)) if n > 1 else 0
        window = max(int(3 * duration / cadence), 5) if cadence > 0 else None
        if mask is None:
            flat, status = np.where(np.isfinite(flux), flux, np.nan), "none"
        elif window is None:
            flat, status = np.full(n, np.nan), "nodata"
        else:
            flat, status = kernel.flatten_group(t.astype(float), flux, mask, window + (window % 2 == 0))
        for i in range(n):
            rows.append((star, 1, duration, i, int(t[i]), None if np.isnan(flux[i]) else float(flux[i]), bool(primary[i]), bool(secondary[i]), bool(sibling[i])))
            want[star, i] = (None if not np.isfinite(flat[i]) else flat[i], status)
    d = spark.createDataFrame(rows, "star_id long, koi long, duration_us long, i int, t_us long, flux double, in_primary boolean, in_secondary boolean, in_sibling boolean").withColumn("siblings", F.array())
    out = detrend.flattened(d)
    assert out.columns == [*d.drop("siblings").columns, "flat", "status"]
    got = {(r.star_id, r.i): (r.flat, r.status) for r in out.collect()}
    assert got.keys() == want.keys() and {w[1] for w in want.values()} == {"", "none", "nodata"}
    for k, (flat, status) in want.items():
        assert got[k][1] == status, k
        assert (flat is None) == (got[k][0] is None) and (flat is None or k[0] == 5 or got[k][0] == pytest.approx(flat, rel=1e-9)), (k, flat, got[k])


def test_flatten_never_raises():
    t = np.arange(10.0)
    for flux in (np.full(10, np.nan), np.zeros(10)):
        out, status = kernel.flatten_group(t, flux, np.zeros(10, bool), 3)
        assert len(out) == 10 and status == "nodata"
    assert kernel.flatten_group(t[:1], t[:1], np.zeros(1, bool), 3)[1] == "nodata"
    assert kernel.flatten_group(np.zeros(10), t, np.zeros(10, bool), 3)[1] == "nodata"
    assert np.isnan(kernel.flatten_group(t, t + 1, np.ones(10, bool), 3)[0]).all()


def test_clip_is_asymmetric(spark):
    flux = [1.0 + 0.001 * ((i * 7) % 5 - 2) for i in range(400)] + [1.02, 0.98]
    d = spark.createDataFrame([(1, i, f) for i, f in enumerate(flux)], "star_id long, t_us long, flux double")
    kept = {r.flux for r in T.clipped(d, rounds=3).collect()}
    assert 1.02 not in kept and 0.98 in kept


def test_detrend_rungs(spark):
    for ratio, rung in ((0.05, ""), (0.14, "primary_only"), (0.3, "none")):
        curve, koi = curve_of(spark, duration=int(ratio * 3 * DAY), days=30)
        assert one(T.detrend_rung(T.masked(curve, koi))).detrend_fallback == rung


def test_precheck_reports_the_first_reason(spark):
    rows = [(None, None, None, 0.0), (1.0, None, 1.0, 5.0), (1.0, 0.0, 0.0, 5.0), (1.0, 0.0, 1.0, 0.5), (1.0, 0.0, 1.0, None), (1.0, 0.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "p double, e double, d double, n double")
    got = [r[0] for r in d.select(batch.precheck(F.col("p"), F.col("e"), F.col("d"), F.col("n"))).collect()]
    assert got == ["koi_period missing or non-positive", "koi_time0bk missing", "koi_duration missing or non-positive", "koi_num_transits is 0", None, None]


def test_error_classes(spark):
    rows = [
        ("OSError", "[Errno 28] No space left on device"), ("X", "not recognized as a supported data product"), ("ReadTimeout", "x"), ("NoDataError", "none for KIC 5001234"),
        ("NoDataError", "server said 503"), ("SearchError", "nothing"), ("ValueError", "x"), (None, None), ("ValueError", "Connection reset by peer"),
    ]
    d = spark.createDataFrame(rows, "k string, m string")
    got = [r[0] for r in d.select(batch.classified(F.col("k"), F.col("m"))).collect()]
    assert got == ["diskfull", "corruptcache", "transient", "nodata", "transient", "nodata", "unknown", "", "transient"]


def test_resume(spark):
    todo = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "kepoi_name string")
    past = spark.createDataFrame([("a", 1, "transient"), ("a", 2, ""), ("b", 1, ""), ("b", 2, "transient"), ("c", 1, "diskfull")], "kepoi_name string, attempt_seq long, error_kind string")
    left = lambda retry: sorted(r[0] for r in batch.remaining(todo, past, ["kepoi_name"], retry).collect())
    assert left(batch.RETRY_LIBRARY) == ["b", "d"] and left(batch.RETRY_RUNNER) == ["b", "c", "d"]


def test_bands_and_histogram_edges(spark):
    d = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.5, 1.0, 1.1, None)], "x double")
    assert [r[0] for r in d.select(X.in_bands(F.col("x"), [0, 0.1, 1])).collect()] == [None, 0, 1, 1, None, None]
    assert [r[0] for r in d.select(X.in_bands(F.col("x"), [0, 0.1, 1], "left")).collect()] == [0, 1, 1, 1, None, None]


def test_spearman_with_ties_and_constant(spark):
    d = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 1.0), (0, 2.0, 3.0), (0, 4.0, 9.0), (1, 1.0, 2.0), (1, 1.0, 3.0), (1, None, 1.0)], "g int, a double, b double")
    got = {r.g: (r.rho, r.n) for r in stats.spearman(d, "a", "b", ["g"]).collect()}
    a, b = np.array([1, 2.5, 2.5, 4]), np.array([1.5, 1.5, 3, 4])
    assert got[0][0] == pytest.approx(np.corrcoef(a, b)[0, 1]) and got[1] == (None, 2)


def test_noise_is_null_when_it_cannot_be_told(spark):
    d = spark.createDataFrame([(1, 1, 5.0), (1, 1, 5.0), (2, 1, None), (3, 1, 1.0), (3, 1, 2.0), (3, 1, 4.0)], "star_id long, koi long, v double")
    got = {r.star_id: r.noise for r in features.robust_noise(d, "v").collect()}
    assert got[1] is None and got[2] is None and got[3] == pytest.approx(1.4826)


@pytest.mark.parametrize("rows", [[(0.1, 0), (0.1, 1), (0.4, 1), (0.8, 1), (0.8, 0), (0.9, 1)], [(0.1, 1)], [(0.5, 1), (0.5, 0)]])
def test_ranking_metrics(spark, rows):
    d = spark.createDataFrame([(0, *r) for r in rows], "g int, score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = None if not neg else sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert one(learning.roc_auc(d, "score", "label", ["g"])).auc == want
    ap, seen = 0.0, 0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp, n = sum(y for s, y in rows if s >= t), sum(s >= t for s, _ in rows)
        ap, seen = ap + (tp - seen) / len(pos) * tp / n, tp
    assert one(learning.average_precision(d, "score", "label", ["g"])).average_precision == pytest.approx(ap)


def test_split_keeps_groups_together(spark):
    d = learning.split(spark.range(4000).withColumn("g", F.col("id") % 1000), "g")
    assert d.select("g", "part").distinct().count() == 1000
    share = {r.part: r["count"] / 4000 for r in d.groupBy("part").count().collect()}
    assert share == {"test": 0.2, "validation": 0.2, "train": 0.6}


@pytest.mark.parametrize("n", [1, 2, 7, 11])
def test_splits_hold_out_whole_numbers_of_groups(spark, n):
    """Rounded up, of few groups too, and of groups without a name."""
    rows = [(k % n, None if k % n == 1 else f"s{k % n}") for k in range(3 * n)]
    d = spark.createDataFrame(rows, "k int, g string")
    for name, test in learning.held_out(d, "g", {"a": 1, "b": 2, "c": 3}).items():
        got = [r.t for r in d.groupBy("k").agg(F.collect_set(test).alias("t")).collect()]
        assert sorted(map(tuple, got)) == [(False,)] * (n - math.ceil(n / 5)) + [(True,)] * math.ceil(n / 5), name
    assert learning.split(d.limit(0), "g").count() == 0


def test_boosting_learns_missing_values_either_way(spark):
    for side in (0, 1):
        rows = [(i, None if i % 2 else float(i % 50), side if i % 2 else 1 - side) for i in range(400)]
        d = spark.createDataFrame(rows, "id long, depth double, y int")
        model = learning.boosted(d, ["depth"], "y", rounds=3, depth=2)
        out = learning.scored(model, d, ["depth"])
        assert out.where("(score >= 0.5) <> (y = 1)").count() == 0
        assert learning.importances(model, ["depth"])["depth"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        learning.boosted(d, ["koi_depth_ppm"], "y")


def naive_gain(x, g, h, least, l2):
    """The best gain over every feature, cut and side for missing values."""
    best = 0.0
    for column in x.T:
        values = np.unique(column[~np.isnan(column)])
        for cut in [*((values[1:] + values[:-1]) / 2), np.inf]:
            for low in (True, False):
                left = np.where(np.isnan(column), low, column <= cut)
                if min(left.sum(), (~left).sum()) >= least:
                    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
                    best = max(best, part(left) + part(~left) - part(np.ones(len(g), bool)))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_splits_are_the_best_there_are(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(60, 3)), 1)
    x[rng.random(x.shape) < 0.2] = np.nan
    g, h = rng.normal(size=60), rng.uniform(0.1, 0.25, 60)
    edges = [(v[1:] + v[:-1]) / 2 for v in (np.unique(c[~np.isnan(c)]) for c in x.T)]
    codes = boosting.binned(x, edges)
    for least, l2 in ((1, 0.0), (8, 1.0), (31, 0.0)):
        found = boosting.splits(boosting.histograms(codes, np.zeros(60, int), g, h, 1), least, l2)[0]
        want = naive_gain(x, g, h, least, l2)
        assert (found is None and want <= 1e-9) or found[0] == pytest.approx(want)


def test_a_split_and_the_side_of_missing_values():
    """One feature, values 0 to 3 and missing ones: the cut between 1 and 2, missing values with the rows that they are like."""
    codes = np.array([[0], [1], [2], [3], [255], [255]], np.uint8)
    h = np.ones(6)
    for g, low in ((np.array([1, 1, -1, -1, 1, 1.0]), True), (np.array([1, 1, -1, -1, -1, -1.0]), False)):
        gain, feature, at, missing_left, left, total = boosting.splits(boosting.histograms(codes, np.zeros(6, int), g, h, 1), 1, 0.0)[0]
        assert (feature, at, missing_left, total) == (0, 1, low, (g.sum(), 6.0)) and left == ((4.0, 4.0) if low else (2.0, 2.0))
        assert gain == pytest.approx(6 - g.sum() ** 2 / 6)
    assert boosting.splits(boosting.histograms(codes, np.zeros(6, int), g, h, 1), 4, 0.0) == [None]
    assert boosting.splits(boosting.histograms(codes, np.array([0, 0, 1, 1, -1, -1]), np.ones(6), h, 2), 1, 0.0) == [None, None]


def naive_tree(codes, g, h, leaves, least, l2, rate):
    """The value of each row, with one split after another of the leaf that gains most."""
    rows, value = {0: np.arange(len(g))}, np.zeros(len(g))
    best = lambda r: boosting.splits(boosting.histograms(codes[r], np.zeros(len(r), int), g[r], h[r], 1), least, l2)[0]
    found, made = {0: best(rows[0])}, 1
    while len(rows) < leaves and any(found[k] for k in rows):
        k = max((k for k in rows if found[k]), key=lambda k: (found[k][0], -k))
        _, j, b, low, _, _ = found[k]
        own = rows.pop(k)
        left = np.where(codes[own, j] == 255, low, codes[own, j] <= b)
        for part in (own[left], own[~left]):
            rows[made], found[made] = part, best(part)
            made += 1
    if len(rows) > 1:
        for own in rows.values():
            value[own] = -rate * g[own].sum() / (h[own].sum() + l2)
    return value


@pytest.mark.parametrize("seed", range(6))
def test_waves_grow_the_tree_that_one_split_after_another_does(seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 40, (400, 3)).astype(np.uint8)
    codes[rng.random(codes.shape) < 0.1] = 255
    g, h = rng.normal(size=400) + (codes[:, 0] > 20) * (codes[:, 1] < 9), rng.uniform(0.1, 0.25, 400)
    for leaves, least, l2 in ((31, 5, 0.0), (6, 20, 1.0), (400, 1, 0.5), (2, 150, 0.0), (31, 300, 0.0)):
        tree, place, waves = boosting.Growing(leaves, least, l2, 0.1), np.zeros(400, int), 0
        while tree.wanted:
            sums = boosting.histograms(codes, tree.slots(place), g, h, len(tree.wanted))
            tree.tell(dict(zip(tree.wanted, boosting.splits(sums, least, l2), strict=True)))
            place, waves = tree.moved(codes, place), waves + 1
        want = naive_tree(codes, g, h, leaves, least, l2, 0.1)
        assert tree.values()[place] == pytest.approx(want) and (place == tree.placed(codes)).all()
        nodes = tree.nodes()
        assert (boosting.added([nodes], codes) if nodes else np.zeros(400)) == pytest.approx(want)
        assert len(nodes) <= 2 * leaves - 1 and waves <= max(2, len(tree.inner) + 1)


def test_rows_in_many_blocks_give_the_same_fits(spark):
    """All runs over one block, and over seven whose histograms are added up: the same scores of the same held-out rows."""
    rng = np.random.default_rng(6)
    rows = [(i, i % 40, None if i % 7 == 0 else float(a), float(round(b, 1)), None if i % 50 == 3 else int(a + b > 0)) for i, (a, b) in enumerate(rng.normal(size=(420, 2)))]
    d = spark.createDataFrame(rows, "id long, star long, a double, b double, label int")
    parts = [F.when(F.col("star") % 4 == k, 1).when((F.col("star") % 4 == 3) & F.lit(k == 1), 2).otherwise(0) for k in range(2)]
    params = {"rounds": 5, "rate": 0.3, "leaves": 6, "least": 10, "l2": 0.5}
    runs = [{"columns": c, "part": p, "params": params | {"rounds": r}} for c, p, r in (([0, 1], 0, 5), ([1], 0, 3), ([0, 1], 1, 5), ([0, 1], 0, 2), ([0, 1], 0, 5))]
    run = lambda size: {(r.run, r.key, r.label): r.score for r in boosting.scores(d, "id", "label", ["a", "b"], runs, parts, size, settled=2).collect()}
    one, many = run(1 << 16), run(64)
    assert one == pytest.approx(many)
    assert {(k, i) for k, i, _ in one} == {(k, i) for k, p in ((0, 0), (1, 0), (2, 1), (3, 0), (4, 0)) for i, s, _, _, y in rows if y is not None and s % 4 == p}
    assert all(one[k, i, y] != one[0, i, y] if k == 3 else one[k, i, y] == one[0, i, y] for k, i, y in one if k > 2)
    a, b = (boosting.model(d, "id", "label", ["a", "b"], params, size, settled=2) for size in (1 << 16, 64))
    x = np.array([[np.nan if r[2] is None else r[2], r[3]] for r in rows])
    assert len(a["trees"]) == 5 and boosting.predict(a, x) == pytest.approx(boosting.predict(b, x))
    assert boosting.model(d.limit(0), "id", "label", ["a", "b"], params)["trees"] == []


def test_cuts_between_bins(spark):
    d = spark.createDataFrame([(float(i % 4), float(i), None) for i in range(1000)] + [(None, float("nan"), None)], "a double, b double, c double")
    few, many, none = boosting.edges_of(d, ["a", "b", "c"])
    assert few == [0.5, 1.5, 2.5] and none == [] and len(many) == 254 and many == sorted(many)
    assert np.diff([0, *many, 1000]).max() < 10


def test_a_model_learns_and_is_stored(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, i // 3, float(a) if i % 4 else None, float(b), int(a > 0 if i % 4 else b > 0)) for i, (a, b) in enumerate(rng.normal(size=(900, 2)))]
    d = spark.createDataFrame(rows, "id long, star long, depth double, width double, label int")
    bundle = learning.fitted(d, "id", "label", ["depth", "width"])
    out = learning.applied(bundle, d)
    assert out.where("(score >= 0.5) <> (label = 1)").count() <= 20
    learning.save_bundle(spark, bundle, str(tmp_path / "m"))
    again, threshold = learning.load_bundle(spark, str(tmp_path / "m"))
    assert again == bundle and threshold == 0.25
    q = learning.queue(again, d, "id").collect()
    assert sorted(r.place for r in q) == list(range(1, 901))
    assert [r.id for r in sorted(q, key=lambda r: r.place)] == [r.id for r in sorted(q, key=lambda r: (-r.score, r.id))]
    none = learning.queue(again, d.withColumn("error", F.when(F.col("id") % 2 == 0, "x")), "id")
    assert none.count() == 450
    loss = {r.feature: r["mean"] for r in learning.permutation_importance(bundle, d, "label", "id", repeats=3, threshold=0.5).collect()}
    assert loss["depth"] > 0.2 > loss["width"] > 0.02
    with pytest.raises(ValueError):
        learning.fitted(d.withColumn("koi_depth_ppm", F.lit(1)), "id", "label", ["koi_depth_ppm"])


def test_fits_do_not_depend_on_the_order_of_rows_and_copies():
    """Two features that cut alike are an exact tie at every node: the first one counts, in any order of rows; copies are weighted cells."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=900)
    codes = boosting.binned(np.stack([a, -a], axis=1), [np.linspace(-2, 2, 60), np.linspace(-2, 2, 60)])
    codes = np.concatenate([codes, codes[:300]])
    y, train = (np.sin(3 * codes[:, 0] / 10) + rng.normal(size=1200) > 0).astype(float), rng.random(1200) < 0.7
    fit = lambda o: boosting.fit_block(codes[o], y[o], train[o], 20, 0.2, 8, 10, 0.0)
    start, trees, margin = fit(np.arange(1200))
    assert {n[0] for nodes in trees for n in nodes} == {-1, 0}
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(1200)
        other = fit(order)
        assert other[:2] == (start, trees) and (other[2] == margin[order]).all()
    g, h = rng.normal(size=1200), rng.random(1200)
    columns = [np.ascontiguousarray(c) for c in codes.T]
    assert boosting.sums_of(columns, np.flatnonzero(train), g, h, np.ones(1200)) == pytest.approx(boosting.histograms(codes, np.where(train, 0, -1), g, h, 1)[:, 0])


def test_a_table_of_some_hundred_thousand_rows_needs_no_wave_over_blocks(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a job for each wave")

    monkeypatch.setattr(boosting, "_Over", refuse)
    d = spark.range(70_000).select("id", (F.col("id") % 1000).cast("double").alias("a"), (F.col("id") % 1000 > 500).cast("int").alias("label"))
    params = {"rounds": 2, "rate": 0.3, "leaves": 4, "least": 10, "l2": 0.0}
    runs = [{"columns": [0], "part": 0, "params": params}]
    got = boosting.scores(d, "id", "label", ["a"], runs, [(F.col("id") % 5 == 0).cast("int")]).groupBy("label").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
    low, high = sorted(got.collect())
    assert low.n + high.n == 14_000 and low.high < high.low
    assert len(boosting.model(d, "id", "label", ["a"], params)["trees"]) == 2


@pytest.mark.parametrize(("block", "jobs"), [(1600, 2), (400, 7)])
def test_a_fit_over_blocks_needs_a_job_a_wave_only_for_nodes_larger_than_a_block(spark, monkeypatch, block, jobs):
    """The tree of 24 leaves is that of one block, also with missing values; its waves below nodes of at most a block need one job."""
    rng = np.random.default_rng(9)
    a, b = rng.random(3000), rng.random(3000)
    y = (a > 0.5) ^ (np.sin(9 * a) * np.cos(7 * b) + rng.normal(size=3000) / 3 > 0.4)
    rows = [(i, float(a[i]), None if i % 11 == 0 else float(b[i]), int(y[i])) for i in range(3000)]
    d = spark.createDataFrame(rows, "id long, a double, b double, label int")
    params, asked, wave = {"rounds": 2, "rate": 0.3, "leaves": 24, "least": 20, "l2": 0.5}, [], boosting._Over.wave
    monkeypatch.setattr(boosting._Over, "wave", lambda self, growing: asked.append(1) or wave(self, growing))
    one, many = (boosting.model(d, "id", "label", ["a", "b"], params, size, settled=1) for size in (3000, block))
    assert many == one and len(one["trees"]) == 2 and all(len(nodes) > 30 for nodes in one["trees"])
    assert 2 <= len(asked) <= 2 * jobs


def test_measurements_are_worked_out_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    d = spark.range(300).select("id", (F.col("id") % 60).alias("star"), (F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 50 > 20).cast("int").alias("label"))
    params = learning.DEFAULTS | {"rounds": 2}
    learning.ablation(d.mapInArrow(counted, d.schema), "id", "star", "label", {"one": ["a"]}, [1, 2], params).collect()
    assert read.value == 300


def test_ranks_and_bands_read_their_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    d = spark.range(200).select((F.col("id") % 7).alias("g"), (F.col("id") % 40).cast("double").alias("a"), (F.col("id") * 13 % 50).cast("double").alias("b"))
    d = d.mapInArrow(counted, d.schema)
    assert stats.spearman(d, "a", "b", []).collect()[0].n == 200 == read.value
    assert sum(r.n for r in stats.banded_spread(d, X.in_bands(F.col("g"), [-1, 3, 6]), "a").collect()) == 200 and read.value == 400


def test_experiments_keep_stars_apart_and_their_metrics_hold(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i // 3, float(a), None if i % 5 == 0 else float(b), int(a + 0.5 * b > 0)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    d = spark.createDataFrame(rows, "id long, star long, a double, b double, label int")
    params = learning.DEFAULTS | {"rounds": 20}
    found = learning.ablation(d, "id", "star", "label", {"both": ["a", "b"], "b": ["b"]}, [100, 101], params)
    got = {(r.config, r.part): r for r in found.collect()}
    assert len(got) == 4
    test = {r.id for r in d.where(learning.held_out(d, "star", {"100": 100})["100"]).collect()}
    assert len({i // 3 for i in test}) * 3 == len(test)
    use = sorted((r for r in rows if r[0] not in test), key=lambda r: r[0])
    held = [r for r in rows if r[0] in test]
    x = lambda rs: np.array([[r[2], np.nan if r[3] is None else r[3]] for r in rs])
    edges = [np.array(e) for e in boosting.edges_of(d, ["a", "b"])]
    start, trees, _ = boosting.fit_block(boosting.binned(x(use), edges), np.array([float(r[4]) for r in use]), np.ones(len(use), bool), **params)
    p, y = boosting.predict({"start": start, "edges": edges, "trees": trees}, x(held)), np.array([r[4] for r in held])
    r = got["both", "100"]
    assert r.tp + r.fp + r.fn + r.tn == len(held)
    assert r.accuracy == pytest.approx(((p >= 0.25) == (y == 1)).mean(), abs=0.02)
    pairs = (p[y == 1][:, None] > p[y == 0]) + 0.5 * (p[y == 1][:, None] == p[y == 0])
    assert r.auc == pytest.approx(pairs.mean(), abs=0.02)
    both, one_ = ({c: v for (k, c), v in ((k, g.accuracy) for k, g in got.items()) if k == name} for name in ("both", "b"))
    assert all(both[s] > one_[s] for s in both)
    grid = [{"rounds": 5, "rate": 0.1}, {"rounds": 20, "rate": 0.1}]
    ratio = one(learning.gap_ratio(learning.grid_search(d, "id", "label", "star", ["a", "b"], grid, folds=3), grid[0]))
    assert ratio.n_configs == 2 and ratio.gap >= 0 and ratio.ratio == pytest.approx(ratio.gap / ratio.pooled)
    assert len(learning.configurations()) == 32 and learning.DEFAULTS in learning.configurations()


@pytest.mark.parametrize("count", [1, 31, 32, 33, 64, 65, 1023])
def test_range_of_counts_the_edges_below(spark, count):
    """In one step or in two, at the edges themselves and between them; the largest range for NaN, the first for NULL."""
    edges = [round(0.5 * k - 7, 1) for k in range(count)]
    values = [None, float("nan"), float("-inf"), float("inf"), *edges, *(e + 0.25 for e in edges), -100.0]
    d = spark.createDataFrame([(v,) for v in values], "v double").withColumn("r", stats.range_of(F.col("v"), edges))
    want = lambda v: count if math.isnan(v) else sum(e <= v for e in edges)
    assert all(r.r == want(r.v) for r in d.where("v IS NOT NULL").collect())
    assert d.where("v IS NULL").first().r == 0


def test_quantiles_and_places_by_ranges(spark):
    """Null groups, values all NULL, one value that most rows share, infinities."""
    rng = random.Random(1)
    rows = [(rng.choice(["a", None, "b"]), 5.0 if rng.random() < 0.6 else round(rng.gauss(0, 3), 1)) for _ in range(500)] + [("c", None), ("b", None)]
    d = spark.createDataFrame(rows, "g string, v double")
    q = {r.g: r for r in stats.quantiles(d, "v", ["g"], {"p10": 0.1, "p50": 0.5}).collect()}
    for g in ("a", None, "b"):
        own = [v for k, v in rows if k == g and v is not None]
        assert (q[g].p10, q[g].p50, q[g].iqr) == pytest.approx((*np.percentile(own, [10, 50]), np.subtract(*np.percentile(own, [75, 25]))))
    assert q["c"].p50 is None
    e = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None), (4, float("inf")), (5, -1.0)], "id long, s double")
    assert [r.id for r in relational.placed(e, "s", "id").orderBy("place").collect()] == [4, 1, 2, 5, 3]
    assert relational.row_of(e, "id", 4).count() == 1
    tied = spark.range(3000).withColumn("s", F.when(F.col("id") % 5 > 0, F.lit(0.5)).when(F.col("id") % 10 == 0, F.col("id") / 3000)).repartition(5)
    want = sorted(range(3000), key=lambda i: (i % 10 == 5, 0 if i % 10 == 5 else -(0.5 if i % 5 else i / 3000), i))
    assert [r.id for r in relational.placed(tied, "s", "id").orderBy("place").collect()] == want
    assert stats.quantiles(d.limit(0), "v", [], {"p": 0.5}).count() <= 1


def test_keep_last_and_upsert(spark):
    d = spark.createDataFrame([("a", 1, 1.0), ("a", 3, None), ("b", 2, 5.0)], "k string, seq long, v double")
    assert sorted((r.k, r.v) for r in relational.keep_last(d, ["k"], "seq").collect()) == [("a", None), ("b", 5.0)]
    old = spark.createDataFrame([("a", 9.0), ("c", 7.0)], "k string, v double")
    once = relational.upserted(old, d, ["k"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, relational.upserted(once, d, ["k"]).collect()), key=str) == [("a", None), ("b", 5.0), ("c", 7.0)]


def test_window_scan_summary(spark):
    d = spark.createDataFrame([("a", 1000.0, 2.0, 0.0009, 0.001, 0.0011, None), ("b", 2000.0, 9.0, 0.0018, 0.002, 0.002, 0.002)], "kepoi_name string, koi_depth_ppm double, ppb double, d4 double, d6 double, d8 double, d12 double")
    d = d.withColumns({f"n{f}": F.lit(f) for f in (4, 6, 8, 12)})
    got = {r.fraction: (round(r["median"], 6), r.n) for r in reports.window_scan_summary(d).collect()}
    assert got == {4: (-0.1, 2), 6: (0.0, 2), 8: (0.05, 2), 12: (0.0, 1)}
    assert {r.n for r in reports.window_scan_summary(d, 4.5).collect()} == {1}


def test_run_report_counts_every_kind(spark):
    """Messages that differ after sixty characters are one, those that differ by a number before are two; missing values count as themselves."""
    long = "NoDataError: only 12 points left after cleaning star 5 and then "
    rows = [("a", "CONFIRMED", None, None, "1800|60", "PDCSAP_FLUX"), ("b", "FALSE POSITIVE", "", "", None, None), ("c", "CONFIRMED", "nodata", long + "x", "60", "sap_flux"),
            ("d", None, "nodata", long + "y", "1800", ""), ("e", "CONFIRMED", "nodata", long.replace("12", "13"), "", ""), ("f", "CONFIRMED", "unknown", None, "", "")]
    d = spark.createDataFrame(rows, "kepoi_name string, disposition string, error_kind string, error string, cadences_seen string, flux_origin string")
    got = lambda x: {tuple(r) for r in x.collect()}
    assert got(reports.class_balance(d)) == {("CONFIRMED", 1), ("FALSE POSITIVE", 1)}
    assert {k: (n, round(s, 6)) for k, n, s in got(reports.error_histogram(d))} == {"(success)": (2, 0.333333), "nodata": (3, 0.5), "unknown": (1, 0.166667)}
    assert got(reports.failure_messages(d)) == {(long[:60], 2), (long.replace("12", "13")[:60], 1), ("", 1)}
    assert got(reports.cadence_sets(reports.successes(d))) == {("1800|60", 1), ("", 1)}
    assert got(reports.wrong_origins(reports.successes(d))) == {(2, 1)}


def test_texts(spark):
    d = spark.createDataFrame([(3, 7), (0, 0)], "a long, b long")
    assert [r[0] for r in d.select(X.share_text(F.col("a"), F.col("b"))).collect()] == ["3/7 (42.9%)", "0/0"]
    assert math.isclose(one(d.select(X.days_to_us(F.lit(1.5)))).asDict().popitem()[1], 1.5 * DAY)
