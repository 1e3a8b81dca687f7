"""Queries of the time-series operators and features, over curves derived from ``events``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from dipfold.functions.expressions import HOUR_US
from dipfold.operators import batch, detrend, stats
from dipfold.operators import features as X
from dipfold.operators import timeseries as T
from dipfold.plans.registry import query
from dipfold.plans.tables import CURVE_SQL, FOLDED_SQL, ROWS_SQL, candidates, catalogue, flat_sql, light_curve, local_bins_sql, products

WITH = "WITH " + CURVE_SQL
N = 25


def curve(spark, d):
    return light_curve(spark, d).drop("product_id")


def folded(spark, d):
    return T.folded(curve(spark, d), candidates(spark, d))


def masked(spark, d):
    return T.masked(curve(spark, d), candidates(spark, d))


def bins(spark, d):
    return T.local_bins(folded(spark, d), N)


@query(WITH + " SELECT star_id, koi, t_us, ph_us, cycle, ((cycle % 2) + 2) % 2 AS parity FROM folded")
def fold_phase(spark, d):
    return folded(spark, d).select("star_id", "koi", "t_us", "ph_us", "cycle", "parity")


@query(WITH + " SELECT star_id, koi, count(*) AS n, count_if(in_primary) AS n_primary FROM masked GROUP BY ALL")
def primary_mask(spark, d):
    m = T.primary_mask(folded(spark, d))
    return m.groupBy("star_id", "koi").agg(F.count("*").alias("n"), F.count_if("in_primary").alias("n_primary"))


@query(WITH + " SELECT star_id, koi, t_us, in_primary, in_secondary FROM masked")
def secondary_mask(spark, d):
    return T.secondary_mask(T.primary_mask(folded(spark, d))).select("star_id", "koi", "t_us", "in_primary", "in_secondary")


@query(WITH + " SELECT star_id, koi, t_us, in_sibling FROM masked")
def sibling_mask(spark, d):
    return masked(spark, d).select("star_id", "koi", "t_us", "in_sibling")


@query(
    WITH + """, s AS (
  SELECT star_id, koi, count(*) AS n_points, count_if(NOT (in_secondary OR in_sibling)) / count(*) AS open_full,
         count_if(NOT in_secondary) / count(*) AS open_secondary, count_if(NOT in_primary) / count(*) AS open_primary
  FROM masked GROUP BY ALL)
SELECT *, CASE WHEN open_full >= .25 THEN '' WHEN open_secondary >= .25 THEN 'secondary_only' WHEN open_primary >= .25 THEN 'primary_only' ELSE 'none' END AS detrend_fallback,
       1 - CASE WHEN open_full >= .25 THEN open_full WHEN open_secondary >= .25 THEN open_secondary WHEN open_primary >= .25 THEN open_primary ELSE 0 END AS detrend_masked_fraction
FROM s"""
)
def detrend_rung(spark, d):
    return T.detrend_rung(masked(spark, d))


@query(WITH + local_bins_sql(N) + " SELECT star_id, koi, idx, c2n, round(flux, 6) AS flux, n_points FROM bins")
def local_bins(spark, d):
    return bins(spark, d).select("star_id", "koi", "idx", "c2n", F.round("flux", 6).alias("flux"), "n_points")


@query(
    WITH + local_bins_sql(N) + """ SELECT star_id, koi, CAST(sum(n_points) AS BIGINT) AS n_local_points, count(*) AS n_local_bins,
  count_if(n_points > 0) AS n_local_bins_filled, median(n_points) AS local_points_per_bin_median FROM bins GROUP BY ALL"""
)
def bin_occupancy(spark, d):
    return T.occupancy(bins(spark, d))


def depth_sql(n: int) -> str:
    return f""", dep AS (SELECT star_id, koi, median(flux) FILTER (NOT 4 * abs(c2n) < {2 * n} * duration_us) AS baseline,
  median(flux) FILTER (4 * abs(c2n) < {2 * n} * duration_us) AS floor FROM bins GROUP BY ALL)"""


DEPTH = depth_sql(N)


@query(WITH + local_bins_sql(N) + DEPTH + " SELECT star_id, koi, round(baseline, 6) AS baseline, round(baseline - floor, 6) AS depth FROM dep")
def depth(spark, d):
    return X.depth(bins(spark, d), N).select("star_id", "koi", F.round("baseline", 6).alias("baseline"), F.round("depth", 6).alias("depth"))


@query(
    WITH + local_bins_sql(N) + f""" SELECT star_id, koi, round(median(flux) FILTER (abs(c2n) < {N} * duration_us AND c2n > 0)
  - median(flux) FILTER (abs(c2n) < {N} * duration_us AND c2n < 0), 6) AS asymmetry FROM bins GROUP BY ALL"""
)
def asymmetry(spark, d):
    return X.asymmetry(bins(spark, d), N).withColumn("asymmetry", F.round("asymmetry", 6))


def noise_sql(n: int) -> str:
    return f""", far AS (SELECT star_id, koi, flux, median(flux) OVER (PARTITION BY star_id, koi) AS m FROM bins WHERE abs(c2n) > {n} * duration_us),
noise AS (SELECT star_id, koi, nullif(median(abs(flux - m)) * 1.4826, 0) AS noise FROM far GROUP BY ALL)"""


NOISE = noise_sql(N)


@query(WITH + local_bins_sql(N) + DEPTH + NOISE + " SELECT star_id, koi, round((baseline - floor) / noise, 6) AS snr FROM dep LEFT JOIN noise USING (star_id, koi)")
def snr(spark, d):
    return X.snr(bins(spark, d), N).withColumn("snr", F.round("snr", 6))


@query(WITH + local_bins_sql(N) + NOISE + " SELECT star_id, koi, round(noise, 6) AS noise FROM noise")
def robust_noise(spark, d):
    b = bins(spark, d)
    return X.robust_noise(b.where(F.abs("c2n") > N * F.col("duration_us")), "flux").withColumn("noise", F.round("noise", 6))


RUNS = """, low AS (SELECT b.*, coalesce(flux < baseline - (baseline - floor) / 2, false) AS low FROM bins b JOIN dep USING (star_id, koi)),
part AS (SELECT star_id, koi, duration_us, idx, idx - row_number() OVER (PARTITION BY star_id, koi ORDER BY idx) AS p FROM low WHERE low),
runs AS (SELECT star_id, koi, duration_us, p, min(idx) AS first, max(idx) + 1 AS stop, count(*) AS length FROM part GROUP BY ALL)"""


@query(WITH + local_bins_sql(N) + DEPTH + RUNS + " SELECT star_id, koi, first, stop, length FROM runs")
def run_detection(spark, d):
    b = bins(spark, d)
    low = b.join(X.depth(b, N), T.KEY).withColumn("low", F.col("flux") < F.col("baseline") - F.col("depth") / 2)
    return T.runs(low, "low", "idx")


@query(
    WITH + local_bins_sql(N) + DEPTH + RUNS + f""", best AS (SELECT *, row_number() OVER (PARTITION BY star_id, koi ORDER BY length DESC, first) AS n FROM runs)
SELECT b.star_id, b.koi, round((length - 1) * 4 * b.duration_us / {N} / 3600000000, 6) AS width_hours, length AS run_bins
FROM (SELECT DISTINCT star_id, koi, duration_us FROM bins) b LEFT JOIN best r ON b.star_id = r.star_id AND b.koi = r.koi AND n = 1"""
)
def width_runs(spark, d):
    return X.width(bins(spark, d), N).withColumn("width_hours", F.round("width_hours", 6))


@query(
    WITH + ", near AS (SELECT *, ((cycle % 2) + 2) % 2 AS parity FROM masked WHERE in_primary)" + local_bins_sql(N, "near", ", parity")
    + f""", par AS (SELECT star_id, koi, parity, median(flux) FILTER (NOT 4 * abs(c2n) < {2 * N} * duration_us) - median(flux) FILTER (4 * abs(c2n) < {2 * N} * duration_us) AS depth
  FROM bins GROUP BY ALL)
SELECT star_id, koi, round(abs(max(depth) FILTER (parity = 0) - max(depth) FILTER (parity = 1)), 6) AS odd_even_diff FROM par GROUP BY ALL"""
)
def odd_even(spark, d):
    return X.odd_even(folded(spark, d)).withColumn("odd_even_diff", F.round("odd_even_diff", 6))


SECONDARY_SQL = """, own AS (
  SELECT star_id, koi, period_us, duration_us, count(*) AS n_all, count_if(in_sibling) AS n_hidden, count_if(in_sibling) / count(*) AS excluded FROM masked GROUP BY ALL
), sl AS (SELECT *, min(ph_us) OVER (PARTITION BY star_id, koi) AS min_ph FROM masked WHERE NOT in_sibling
), fu AS (SELECT star_id, koi, duration_us, period_us, min_ph, (ph_us - min_ph) * 4 // duration_us AS idx, sum(flux) AS s, count(flux) AS n FROM sl GROUP BY ALL
), gr AS (SELECT star_id, koi, duration_us, period_us, min_ph, unnest(generate_series(0, max(idx))) AS idx, max(idx) + 1 AS n_bins FROM fu GROUP BY star_id, koi, duration_us, period_us, min_ph
), sb AS (SELECT g.*, s / nullif(n, 0) AS flux, (g.idx + n_bins // 2) % n_bins AS rot, 8 * g.min_ph + (2 * g.idx + 1) * g.duration_us AS c8
  FROM gr g LEFT JOIN fu f ON g.star_id = f.star_id AND g.koi = f.koi AND g.idx = f.idx
), ou AS (SELECT *, median(flux) OVER (PARTITION BY star_id, koi) AS base FROM sb WHERE abs(c8) > 16 * duration_us
), no AS (SELECT star_id, koi, max(base) AS base, nullif(median(abs(flux - base)) * 1.4826, 0) AS noise, count(flux) AS n_out FROM ou GROUP BY ALL
), pa AS (SELECT o.*, rot - row_number() OVER (PARTITION BY o.star_id, o.koi ORDER BY rot) AS p
  FROM ou o JOIN no USING (star_id, koi) WHERE flux < o.base - 3 * noise
), ru AS (SELECT star_id, koi, p, min(rot) AS first, count(*) AS length, max(base) - median(flux) AS dip,
    atan2(avg(sin(2 * pi() * c8 / 8 / period_us)), avg(cos(2 * pi() * c8 / 8 / period_us))) / (2 * pi()) AS pos FROM pa GROUP BY ALL
), rk AS (SELECT *, row_number() OVER (PARTITION BY star_id, koi ORDER BY length DESC, first) AS a,
    row_number() OVER (PARTITION BY star_id, koi ORDER BY dip DESC, first) AS b,
    row_number() OVER (PARTITION BY star_id, koi ORDER BY (length >= 2) DESC, dip DESC, first) AS c FROM ru
), fo AS (SELECT star_id, koi, max(dip) FILTER (a = 1) AS da, max(pos) FILTER (a = 1) AS pa, max(dip) FILTER (b = 1) AS db, max(pos) FILTER (b = 1) AS pb,
    max(dip) FILTER (c = 1 AND length >= 2) AS dc, max(pos) FILTER (c = 1 AND length >= 2) AS pc FROM rk GROUP BY ALL
), re AS (SELECT o.*, base, noise, da, pa, db, pb, dc, pc, CASE WHEN n_hidden > 0 AND n_all - n_hidden < 50 THEN 'too few points left after excluding sibling transits'
    WHEN 20 * duration_us >= 4 * period_us THEN printf('blanking covers %.2f of the orbit', 4 * duration_us / period_us)
    WHEN coalesce(n_out, 0) = 0 THEN 'no data outside the blanked primary' WHEN base IS NULL OR noise IS NULL THEN 'baseline or noise unmeasurable' ELSE '' END AS g
  FROM own o LEFT JOIN no USING (star_id, koi) LEFT JOIN fo USING (star_id, koi))"""
SECONDARY = WITH + SECONDARY_SQL + """
SELECT star_id, koi, excluded AS secondary_exclusion_fraction, g AS secondary_guard, CASE WHEN g = '' THEN round(noise, 6) END AS secondary_noise,
  CASE WHEN g = '' THEN round(coalesce(da, 0), 6) END AS secondary_depth_longest, CASE WHEN g = '' THEN round(pa, 6) END AS secondary_phase_fraction_longest,
  CASE WHEN g = '' THEN round(coalesce(db, 0), 6) END AS secondary_depth_deepest, CASE WHEN g = '' THEN round(pb, 6) END AS secondary_phase_fraction_deepest,
  CASE WHEN g = '' THEN round(coalesce(dc, 0), 6) END AS secondary_depth_deepest_min2, CASE WHEN g = '' THEN round(pc, 6) END AS secondary_phase_fraction_deepest_min2
FROM re"""


@query(SECONDARY)
def secondary_search(spark, d):
    out = X.secondary(masked(spark, d))
    rounded = [c for c in out.columns if c.startswith(("secondary_depth", "secondary_phase", "secondary_noise"))]
    return out.withColumns({c: F.round(c, 6) for c in rounded})


SCAN = " UNION ALL ".join(
    f"""SELECT star_id, koi, {f} AS fraction, round(median(flux) FILTER (NOT {f} * abs(c2n) < {2 * N} * duration_us) - median(flux) FILTER ({f} * abs(c2n) < {2 * N} * duration_us), 6) AS depth,
  count(flux) FILTER ({f} * abs(c2n) < {2 * N} * duration_us) AS n_in FROM bins GROUP BY star_id, koi""" for f in X.FRACTIONS
)


@query(WITH + local_bins_sql(N) + " " + SCAN)
def depth_window_scan(spark, d):
    return X.window_scan(bins(spark, d), N).withColumn("depth", F.round("depth", 6))


@query(
    WITH + """, g AS (SELECT star_id, t_us, t_us - lag(t_us) OVER (PARTITION BY star_id ORDER BY t_us) AS gap FROM lc)
SELECT star_id, median(gap) / 60e6 AS cadence_minutes, count(*) AS n_points FROM g GROUP BY ALL"""
)
def cadence(spark, d):
    return T.cadence(curve(spark, d))


@query(WITH + " SELECT star_id, count(*) AS n_points, count(*) - count(DISTINCT t_us // 3600000000) AS n_duplicate_times FROM lc GROUP BY ALL")
def duplicate_times(spark, d):
    """Time stamps cut to the hour, so that there are repeats to count."""
    return T.duplicate_times(curve(spark, d).withColumn("t_us", F.floor(F.col("t_us") / HOUR_US)))


@query(
    WITH + """, h AS (SELECT star_id, t_us // 3600000000 AS t_us, flux FROM lc),
n AS (SELECT *, row_number() OVER (PARTITION BY star_id, t_us ORDER BY flux) AS k FROM h) SELECT star_id, t_us, flux FROM n WHERE k = 1"""
)
def deduplicated_times(spark, d):
    return T.deduplicated(curve(spark, d).withColumn("t_us", F.floor(F.col("t_us") / HOUR_US)))


@query(
    WITH + """, s AS (SELECT star_id, median(flux) AS m, stddev_pop(flux) AS s FROM lc GROUP BY ALL)
SELECT star_id, t_us, flux FROM lc JOIN s USING (star_id) WHERE flux <= m + 1.5 * s AND flux >= m - 3 * s"""
)
def asymmetric_clip(spark, d):
    return T.clipped(curve(spark, d), upper=1.5, lower=3.0, rounds=1)


def clip_sql(source: str, upper: float, lower: float, rounds: int) -> str:
    level = f"flux <= median(flux) OVER w + {upper} * stddev_pop(flux) OVER w AND flux >= median(flux) OVER w - {lower} * stddev_pop(flux) OVER w"
    steps = [f"c{k + 1} AS (SELECT * FROM {f'c{k}' if k else source} WINDOW w AS (PARTITION BY star_id) QUALIFY {level})" for k in range(rounds)]
    return ", " + ", ".join(steps) + f" SELECT star_id, t_us, flux FROM c{rounds}"


@query(WITH + clip_sql("lc", 5, 20, 5))
def clip_five_rounds(spark, d):
    """At the limits of the reference: five deviations above, twenty below, up to five rounds."""
    return T.clipped(curve(spark, d))


@query(WITH + clip_sql("lc", 1.2, 2, 3))
def clip_three_rounds(spark, d):
    """At limits that every round cuts something off."""
    return T.clipped(curve(spark, d), upper=1.2, lower=2.0, rounds=3)


@query(
    WITH + """, g AS (SELECT star_id, t_us - lag(t_us) OVER (PARTITION BY star_id ORDER BY t_us) AS gap FROM lc), c AS (SELECT star_id, median(gap) / 60e6 AS m FROM g GROUP BY ALL),
n AS (SELECT star_id, koi, greatest(CAST(floor(3 * duration_us / 60e6 / m) AS INTEGER), 5) AS n FROM koi JOIN c USING (star_id))
SELECT star_id, koi, CASE WHEN n % 2 = 0 THEN n + 1 ELSE n END AS flatten_window_points FROM n"""
)
def window_sizing(spark, d):
    k = candidates(spark, d).join(T.cadence(curve(spark, d)), "star_id")
    return k.select("star_id", "koi", T.window_points(F.col("duration_us"), F.col("cadence_minutes")).alias("flatten_window_points"))


@query(WITH + ", n AS (SELECT star_id, count(*) AS n FROM lc GROUP BY ALL HAVING count(*) >= 50) SELECT star_id, t_us, flux FROM lc SEMI JOIN n USING (star_id)")
def minimum_points(spark, d):
    return T.enough_points(curve(spark, d))


@query(
    WITH + """, m AS (SELECT star_id, product_id, nullif(median(flux), 0) AS m FROM lc GROUP BY ALL)
SELECT star_id, product_id, t_us, round(flux / m, 9) AS flux FROM lc JOIN m USING (star_id, product_id)"""
)
def stitched_products(spark, d):
    return T.stitched(light_curve(spark, d)).withColumn("flux", F.round("flux", 9))


@query(
    WITH + """ SELECT star_id, koi, round(atan2(avg(sin(2 * pi() * ph_us / period_us)), avg(cos(2 * pi() * ph_us / period_us))) / (2 * pi()), 6) AS mean_turn
FROM folded GROUP BY ALL"""
)
def circular_mean(spark, d):
    out = stats.circular_mean(folded(spark, d), F.col("ph_us") / F.col("period_us"), T.KEY)
    return out.withColumn("mean_turn", F.round("mean_turn", 6))


@query(WITH + flat_sql() + " SELECT star_id, koi, t_us, round(flat, 6) AS flat, status FROM flat")
def flatten(spark, d):
    """Masked Savitzky-Golay detrending; held against a plain implementation in the tests, too."""
    return detrend.flattened(masked(spark, d)).select("star_id", "koi", "t_us", F.round("flat", 6).alias("flat"), "status")


@query(
    WITH + local_bins_sql(N) + DEPTH + """, pt AS (SELECT star_id, koi, 'point' AS kind, ph_us / 3600000000 AS hours, flux FROM folded WHERE abs(ph_us) < 2 * duration_us
UNION ALL SELECT star_id, koi, 'bin', c2n / """ + str(2 * N) + """ / 3600000000, flux FROM bins WHERE flux IS NOT NULL)
SELECT star_id, koi, kind, round(hours, 6) AS hours, round((flux - baseline) * 1e6, 3) AS ppm FROM pt JOIN dep USING (star_id, koi)"""
)
def local_view(spark, d):
    out = X.local_view(curve(spark, d), candidates(spark, d), n_bins=N, detrending=False)
    return out.withColumns({"hours": F.round("hours", 6), "ppm": F.round("ppm", 3)})


@query(
    WITH + local_bins_sql(X.LOCAL_BINS) + depth_sql(X.LOCAL_BINS) + noise_sql(X.LOCAL_BINS) + RUNS + f""", lon AS (SELECT star_id, koi, max(length) AS length FROM runs GROUP BY ALL),
fig AS (SELECT star_id, koi, any_value(duration_us) AS duration_us, median(flux) FILTER (abs(c2n) < {X.LOCAL_BINS} * duration_us AND c2n > 0) - median(flux) FILTER (abs(c2n) < {X.LOCAL_BINS} * duration_us AND c2n < 0) AS asymmetry,
  CAST(sum(n_points) AS BIGINT) AS n_local_points, count(*) AS n_local_bins, count_if(n_points > 0) AS n_local_bins_filled, median(n_points) AS local_points_per_bin_median FROM bins GROUP BY ALL)
SELECT star_id, koi, round(baseline, 6) AS baseline, round(baseline - floor, 6) AS depth, round((length - 1) * 4 * duration_us / {X.LOCAL_BINS} / 3600000000, 6) AS width, round(asymmetry, 6) AS asymmetry,
  round((baseline - floor) / noise, 6) AS snr, n_local_points, n_local_bins, n_local_bins_filled, local_points_per_bin_median
FROM fig JOIN dep USING (star_id, koi) LEFT JOIN noise USING (star_id, koi) LEFT JOIN lon USING (star_id, koi)"""
)
def local_shape(spark, d):
    """Depth, width, asymmetry, snr and occupancy at once, at the bins of the local view."""
    out = X.shape(T.local_bins(folded(spark, d), X.LOCAL_BINS), X.LOCAL_BINS)
    return out.withColumns({c: F.round(c, 6) for c in ("baseline", "depth", "width", "asymmetry", "snr")})


#: The window scan has masks of its own, in which siblings play no part, and measures the detrended curve at the bins of the local view.
FLAT_BINS = ", flatc AS (SELECT * REPLACE (flat AS flux) FROM flat)" + local_bins_sql(X.LOCAL_BINS, "flatc")


@query(
    WITH + flat_sql(siblings=False) + FLAT_BINS + """, x AS (""" + SCAN.replace(f"< {2 * N} *", f"< {2 * X.LOCAL_BINS} *")
    + """) SELECT x.star_id, x.koi, fraction, depth, CASE WHEN depth IS NULL THEN 0 ELSE n_in END AS n_in FROM x"""
)
def window_scan_measured(spark, d):
    """The scan as it is made: an own chain of masks, detrended, 201 bins; nothing counted where one side has no data."""
    return X.scanned(curve(spark, d), candidates(spark, d)).withColumn("depth", F.round("depth", 6))


ROW_BINS = X.LOCAL_BINS
SECONDARY_COLUMNS = ", ".join(
    f"CASE WHEN s.g = '' THEN round(coalesce({a}, 0), 6) END AS secondary_depth_{v}, CASE WHEN s.g = '' THEN round({b}, 6) END AS secondary_phase_fraction_{v}"
    for v, a, b in (("longest", "da", "pa"), ("deepest", "db", "pb"), ("deepest_min2", "dc", "pc"))
)
ROW_SQL = (
    "WITH " + ROWS_SQL + local_bins_sql(ROW_BINS) + depth_sql(ROW_BINS) + noise_sql(ROW_BINS) + RUNS + f""", lon AS (SELECT star_id, koi, max(length) AS length FROM runs GROUP BY ALL),
fig AS (SELECT star_id, koi, median(flux) FILTER (abs(c2n) < {ROW_BINS} * duration_us AND c2n > 0) - median(flux) FILTER (abs(c2n) < {ROW_BINS} * duration_us AND c2n < 0) AS asymmetry,
  CAST(sum(n_points) AS BIGINT) AS n_local_points, count(*) AS n_local_bins, count_if(n_points > 0) AS n_local_bins_filled, median(n_points) AS local_points_per_bin_median FROM bins GROUP BY ALL),
near AS (SELECT *, ((cycle % 2) + 2) % 2 AS parity FROM masked WHERE in_primary)""" + local_bins_sql(N, "near", ", parity", "pb") + f""",
par AS (SELECT star_id, koi, parity, median(flux) FILTER (NOT 4 * abs(c2n) < {2 * N} * duration_us) - median(flux) FILTER (4 * abs(c2n) < {2 * N} * duration_us) AS depth FROM pb GROUP BY ALL),
oe AS (SELECT star_id, koi, abs(max(depth) FILTER (parity = 0) - max(depth) FILTER (parity = 1)) AS odd_even_diff FROM par GROUP BY ALL)""" + SECONDARY_SQL + f""",
op AS (SELECT star_id, koi, count_if(NOT (in_secondary OR in_sibling)) / count(*) AS a, count_if(NOT in_secondary) / count(*) AS b, count_if(NOT in_primary) / count(*) AS c, avg(CAST(in_sibling AS INT)) AS hid FROM masked GROUP BY ALL),
ru2 AS (SELECT *, CASE WHEN a >= .25 THEN '' WHEN b >= .25 THEN 'secondary_only' WHEN c >= .25 THEN 'primary_only' ELSE 'none' END AS rung, 1 - CASE WHEN a >= .25 THEN a WHEN b >= .25 THEN b WHEN c >= .25 THEN c ELSE 0 END AS share FROM op),
al AS (SELECT w.*, i.* EXCLUDE (star_id), p.* EXCLUDE (star_id), greatest(CAST(floor(3 * w.duration_us / 60e6 / cadence_minutes) AS INTEGER), 5) AS win,
  CASE WHEN reason IS NOT NULL THEN reason WHEN op.star_id IS NOT NULL THEN '' WHEN p.star_id IS NULL THEN 'NoDataError: no products for star ' || w.star_id
    WHEN n_products_used = 0 THEN 'NoDataError: no 1800s products for star ' || w.star_id || '; available: ' || cadences_seen
    ELSE 'NoDataError: only ' || coalesce(n_raw_points, 0) || ' points left after cleaning star ' || w.star_id || ' (floor is 50)' END AS error
  FROM why w LEFT JOIN info i USING (star_id) LEFT JOIN pin p USING (star_id) LEFT JOIN op ON w.star_id = op.star_id AND w.koi = op.koi)
SELECT al.star_id AS kepid, CAST(al.koi AS VARCHAR) AS kepoi_name, disposition, CAST(koi_depth_ppm AS DOUBLE) AS koi_depth_ppm, al.duration_us / 3600000000 AS koi_duration_hours, al.period_us / 86400000000 AS koi_period_days, koi_num_transits,
  round(dep.baseline - dep.floor, 6) AS depth, round((length - 1) * 4 * al.duration_us / {ROW_BINS} / 3600000000, 6) AS width, round(asymmetry, 6) AS asymmetry, round((dep.baseline - dep.floor) / noise.noise, 6) AS snr,
  round(odd_even_diff, 6) AS odd_even_diff, CASE WHEN s.g = '' THEN round(coalesce(dc, 0), 6) END AS secondary_depth,
  CASE WHEN error = '' THEN n_products_all END AS n_products_all, CASE WHEN error = '' THEN n_products_used END AS n_products_used, CASE WHEN error = '' THEN cadences_seen ELSE '' END AS cadences_seen,
  CASE WHEN error = '' THEN flux_origin ELSE '' END AS flux_origin, CASE WHEN error = '' THEN n_raw_points END AS n_raw_points, CASE WHEN error = '' THEN n_duplicate_times END AS n_duplicate_times,
  CASE WHEN error = '' THEN round(cadence_minutes, 6) END AS cadence_minutes, CASE WHEN error = '' AND rung <> 'none' THEN CASE WHEN win % 2 = 0 THEN win + 1 ELSE win END END AS flatten_window_points,
  CASE WHEN error = '' THEN round(al.duration_us / al.period_us, 6) END AS duration_over_period, CASE WHEN error = '' THEN n_koi_for_star END AS n_koi_for_star, round(share, 6) AS detrend_masked_fraction,
  coalesce(rung, '') AS detrend_fallback, CASE WHEN error = '' THEN n_koi_for_star - 1 END AS n_siblings, round(hid, 6) AS sibling_masked_fraction, n_local_points, n_local_bins, n_local_bins_filled, local_points_per_bin_median,
  CASE WHEN s.g = '' THEN round(s.noise, 6) END AS secondary_noise, {SECONDARY_COLUMNS}, round(s.excluded, 6) AS secondary_exclusion_fraction, coalesce(s.g, '') AS secondary_guard,
  error, CASE WHEN reason IS NOT NULL THEN 'precheck' WHEN error <> '' THEN 'nodata' ELSE '' END AS error_kind
FROM al LEFT JOIN dep USING (star_id, koi) LEFT JOIN noise USING (star_id, koi) LEFT JOIN lon USING (star_id, koi) LEFT JOIN fig USING (star_id, koi) LEFT JOIN oe USING (star_id, koi)
  LEFT JOIN re s USING (star_id, koi) LEFT JOIN ru2 USING (star_id, koi)"""
)


def rounded(out):
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double" and not c.startswith("koi_")})


@query(ROW_SQL)
def assembled_row(spark, d):
    """Whole rows, errors included, of curves as they are: every column but the trend itself has its SQL."""
    points = light_curve(spark, d)
    return rounded(X.assembled(points, products(spark, d), catalogue(spark, d), ROW_BINS, detrending=False))


def flat_rows_sql() -> str:
    """The SQL of whole rows with the detrended curve in place of the curve: the masks stay those of the curve as it is."""
    head, tail = ROW_SQL.split(FOLDED_SQL.replace("FROM koi s WHERE", "FROM cat s WHERE"), 1)
    own = FOLDED_SQL.replace("FROM koi s WHERE", "FROM cat s WHERE").replace("folded AS (", "folded0 AS (").replace("FROM folded f", "FROM folded0 f").replace("masked AS (", "masked0 AS (")
    return head + own + flat_sql("masked0") + ", masked AS (SELECT * REPLACE (flat AS flux) FROM flat), folded AS (SELECT * FROM masked)" + tail


@query(flat_rows_sql())
def assembled_features(spark, d):
    """Whole rows of detrended curves, at the bins of the local view."""
    return rounded(X.assembled(light_curve(spark, d), products(spark, d), catalogue(spark, d)))


def _extent(g: pa.Table) -> pa.Table:
    """A kernel that fails for some stars, each in a way that a batch meets."""
    star, n = g.column("star_id")[0].as_py(), g.num_rows
    if star % 13 == 5:
        raise TimeoutError("read timed out")
    if star % 13 == 6:
        raise OSError(28, "No space left on device")
    if star % 13 == 7:
        raise ValueError(f"{n} points of star {star} make no sense")
    if star % 3 == 1:
        raise batch.NoDataError(f"only {n} points left")
    return pa.table({"star_id": [star], "n_points": [n], "extent": [max(g.column("flux").to_pylist()) - min(g.column("flux").to_pylist())]})


@query(
    WITH + """, g AS (SELECT star_id, count(*) AS n, max(flux) - min(flux) AS extent FROM lc GROUP BY ALL),
e AS (SELECT *, CASE WHEN star_id % 13 = 5 THEN 'TimeoutError: read timed out' WHEN star_id % 13 = 6 THEN 'OSError: [Errno 28] No space left on device'
  WHEN star_id % 13 = 7 THEN 'ValueError: ' || n || ' points of star ' || star_id || ' make no sense' WHEN star_id % 3 = 1 THEN 'NoDataError: only ' || n || ' points left' ELSE '' END AS error FROM g)
SELECT star_id, CASE WHEN error = '' THEN n END AS n_points, CASE WHEN error = '' THEN extent END AS extent, error,
  CASE WHEN error = '' THEN '' WHEN error LIKE 'Timeout%' THEN 'transient' WHEN error LIKE 'OS%' THEN 'diskfull' WHEN error LIKE 'No%' THEN 'nodata' ELSE 'unknown' END AS error_kind FROM e"""
)
def failures_as_rows(spark, d):
    """A kernel over each star's curve whose failures are rows of their stars."""
    return batch.attempted(curve(spark, d), ["star_id"], _extent, "star_id long, n_points long, extent long")
