"""Reports over a checkpoint-like table derived from ``lineitem`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from dipfold.operators import batch, reports
from dipfold.plans.registry import query
from dipfold.plans.tables import table

ATTEMPTS_SQL = """raw AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS attempt_seq, 'K' || CAST(l_orderkey * 4 + l_linenumber % 4 AS VARCHAR) AS kepoi_name, o_custkey AS kepid,
  CASE WHEN l_returnflag = 'N' THEN 'CONFIRMED' ELSE 'FALSE POSITIVE' END AS disposition, CASE WHEN l_quantity <= 2 THEN 'precheck' WHEN l_quantity = 3 THEN 'transient' ELSE '' END AS error_kind,
  CASE WHEN l_quantity <= 3 THEN 'covers ' || CAST(l_linenumber AS VARCHAR) || '.5 of it' END AS error, l_extendedprice / 1e5 AS depth, l_extendedprice * (8 + l_discount * 40) AS koi_depth_ppm,
  CASE WHEN l_linenumber % 2 = 0 THEN '60|1800' ELSE '1800' END AS cadences_seen, l_linestatus AS flux_origin, nullif(l_quantity, 50) AS local_points_per_bin_median,
  l_discount AS secondary_depth_longest, nullif(l_tax, 0.05) AS secondary_depth_deepest, CASE WHEN l_linenumber > 2 THEN l_discount * l_tax END AS secondary_depth_deepest_min2,
  l_discount * 5 AS secondary_phase_fraction_longest, l_tax * -6 AS secondary_phase_fraction_deepest, l_discount * 4.9 AS secondary_phase_fraction_deepest_min2,
  CASE WHEN l_linenumber = 1 THEN 'blanking covers 0.' || CAST(l_suppkey AS VARCHAR) || ' of the orbit' ELSE '' END AS secondary_guard, l_linenumber AS n_koi_for_star,
  l_tax AS detrend_masked_fraction, l_returnflag AS detrend_fallback, l_quantity / 100 AS duration_over_period, l_suppkey % 20 / 16.0 AS koi_impact, 48 + l_linenumber * 20 AS n_local_bins
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
last AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY kepoi_name ORDER BY attempt_seq DESC) AS n FROM raw) WHERE n = 1),
ok AS (SELECT * FROM last WHERE error_kind = ''),
err AS (SELECT *, (depth * 1e6 - koi_depth_ppm) / koi_depth_ppm AS e FROM ok WHERE koi_depth_ppm > 0)"""


def attempts(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return li.selectExpr(
        "(l_orderkey * 10 + l_linenumber) * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS attempt_seq", "'K' || CAST(l_orderkey * 4 + l_linenumber % 4 AS STRING) AS kepoi_name", "o_custkey AS kepid",
        "CASE WHEN l_returnflag = 'N' THEN 'CONFIRMED' ELSE 'FALSE POSITIVE' END AS disposition", "CASE WHEN l_quantity <= 2 THEN 'precheck' WHEN l_quantity = 3 THEN 'transient' ELSE '' END AS error_kind",
        "CASE WHEN l_quantity <= 3 THEN 'covers ' || CAST(l_linenumber AS STRING) || '.5 of it' END AS error", "l_extendedprice / 1e5D AS depth", "l_extendedprice * (8 + l_discount * 40) AS koi_depth_ppm",
        "CASE WHEN l_linenumber % 2 = 0 THEN '60|1800' ELSE '1800' END AS cadences_seen", "l_linestatus AS flux_origin", "nullif(l_quantity, 50) AS local_points_per_bin_median",
        "l_discount AS secondary_depth_longest", "nullif(l_tax, 0.05D) AS secondary_depth_deepest", "CASE WHEN l_linenumber > 2 THEN l_discount * l_tax END AS secondary_depth_deepest_min2",
        "l_discount * 5 AS secondary_phase_fraction_longest", "l_tax * -6 AS secondary_phase_fraction_deepest", "l_discount * 4.9D AS secondary_phase_fraction_deepest_min2",
        "CASE WHEN l_linenumber = 1 THEN 'blanking covers 0.' || CAST(l_suppkey AS STRING) || ' of the orbit' ELSE '' END AS secondary_guard", "l_linenumber AS n_koi_for_star",
        "l_tax AS detrend_masked_fraction", "l_returnflag AS detrend_fallback", "l_quantity / 100 AS duration_over_period",
        "l_suppkey % 20 / 16D AS koi_impact", "48 + l_linenumber * 20 AS n_local_bins",
    )


def ok(spark, d, *columns):
    """The latest attempts that succeeded; with ``columns`` only these are carried along."""
    a = attempts(spark, d)
    return reports.successes(reports.latest(a.select("kepoi_name", "attempt_seq", "error_kind", *columns) if columns else a))


ERROR = ("depth", "koi_depth_ppm")
OCCUPANCY = (*ERROR, "local_points_per_bin_median")


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})  # no negative zero


W = "WITH " + ATTEMPTS_SQL


@query(W + " SELECT *, printf('%d/%d (%.1f%%)', n_success, n_rows, 100.0 * n_success / n_rows) AS success FROM (SELECT count(*) AS n_rows, count(DISTINCT kepid) AS n_stars, count_if(error_kind = '') AS n_success FROM last)")
def report_run_summary(spark, d):
    return reports.run_summary(reports.latest(attempts(spark, d)))


@query(W + " SELECT disposition, count(*) AS n FROM ok GROUP BY ALL")
def report_class_balance(spark, d):
    return reports.class_balance(reports.latest(attempts(spark, d)))


@query(W + " SELECT CASE WHEN error_kind = '' THEN '(success)' ELSE error_kind END AS error_kind, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM last GROUP BY 1")
def report_error_histogram(spark, d):
    return reports.error_histogram(reports.latest(attempts(spark, d)))


@query(W + " SELECT left(coalesce(error, ''), 60) AS message, count(*) AS n FROM last WHERE error_kind <> '' GROUP BY ALL")
def report_failure_messages(spark, d):
    return reports.failure_messages(reports.latest(attempts(spark, d)))


@query(W + " SELECT coalesce(cadences_seen, '') AS cadences_seen, count(*) AS n FROM ok GROUP BY ALL")
def report_cadence_sets(spark, d):
    return reports.cadence_sets(ok(spark, d))


@query(W + " SELECT count(*) AS n, count_if(lower(coalesce(flux_origin, '')) <> 'o') AS n_wrong FROM ok")
def report_wrong_origins(spark, d):
    return reports.wrong_origins(ok(spark, d), "o")


@query(W + " SELECT flux_origin, count(*) AS n, count_if(contains(cadences_seen, '|')) AS mixed FROM ok GROUP BY ALL")
def report_cadence_mixing(spark, d):
    return reports.cadence_mixing(ok(spark, d))


@query(
    W + """ SELECT count(*) AS n, round(median(e), 6) AS median_signed, round(avg(e), 6) AS mean_signed, round(median(abs(e)), 6) AS median_abs, count_if(abs(e) <= .15) AS within_15,
  count_if(abs(e) <= .25) AS within_25, count_if(depth < 0) AS negative, max(depth) AS deepest FROM err"""
)
def report_depth_agreement(spark, d):
    return rounded(reports.depth_agreement(ok(spark, d, *ERROR)), "median_signed", "mean_signed", "median_abs")


@query(W + " SELECT kepoi_name, depth, koi_depth_ppm, abs(depth - koi_depth_ppm / 1e6) / depth < .5 AS catalogue_agrees FROM ok WHERE depth > .9")
def report_impossible_depths(spark, d):
    return reports.impossible_depths(ok(spark, d))


def band_sql(value: str, edges: list[float]) -> str:
    cases = " ".join(f"WHEN {value} > {a} AND {value} <= {b} THEN {k}" for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    return W + f""", b AS (SELECT CASE {cases} END AS band, e FROM err)
SELECT band, count(*) AS n, round(median(e), 6) + 0.0 AS median, round(quantile_cont(abs(e), .9), 6) AS p90_abs FROM b WHERE band IS NOT NULL GROUP BY ALL"""


@query(band_sql("koi_depth_ppm", reports.DEPTH_BANDS))
def report_depth_bands(spark, d):
    return rounded(reports.error_by_band(ok(spark, d, *ERROR), F.col("koi_depth_ppm"), reports.DEPTH_BANDS), "median", "p90_abs")


@query(band_sql("duration_over_period", reports.RATIO_BANDS))
def report_ratio_bands(spark, d):
    return rounded(reports.error_by_band(ok(spark, d, *ERROR, "duration_over_period"), F.col("duration_over_period"), reports.RATIO_BANDS), "median", "p90_abs")


@query(band_sql("local_points_per_bin_median", reports.OCCUPANCY_BANDS))
def report_occupancy_bias(spark, d):
    return rounded(reports.occupancy_bias(ok(spark, d, *OCCUPANCY)), "median", "p90_abs")


@query(
    W + " SELECT " + ", ".join(f"quantile_cont(local_points_per_bin_median, {p / 100}) AS p{p}" for p in (1, 5, 25, 50, 75, 95))
    + ", quantile_cont(local_points_per_bin_median, .75) - quantile_cont(local_points_per_bin_median, .25) AS iqr FROM ok WHERE local_points_per_bin_median IS NOT NULL"
)
def report_occupancy_percentiles(spark, d):
    return reports.occupancy_percentiles(ok(spark, d))


VARIANT_SQL = " UNION ALL ".join(
    f"""SELECT '{v}' AS variant, count(d) AS measured, count_if(d > 0) AS found, count_if(d = 0) AS zero, median(d) FILTER (d > 0) AS median_found, count_if(d > 0 AND abs(p) > .45) AS near_half
FROM (SELECT secondary_depth_{v} AS d, secondary_phase_fraction_{v} AS p FROM ok)""" for v in reports.VARIANTS
)


@query(W + " " + VARIANT_SQL)
def report_secondary_variants(spark, d):
    return reports.secondary_variants(ok(spark, d))


@query(W + " SELECT regexp_replace(secondary_guard, '[0-9]+(\\.[0-9]+)?', 'N', 'g') AS cause, count(*) AS n FROM ok WHERE secondary_guard <> '' GROUP BY ALL")
def report_guard_causes(spark, d):
    return reports.guard_causes(ok(spark, d))


EDGES = reports.PHASE_EDGES
PHASES = " ".join(f"WHEN x >= {a} AND x {'<=' if k == len(EDGES) - 2 else '<'} {b} THEN {k}" for k, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False)))


@query(W + f", h AS (SELECT abs(secondary_phase_fraction_deepest_min2) AS x FROM ok WHERE secondary_depth_deepest_min2 > 0), b AS (SELECT CASE {PHASES} END AS bin FROM h) SELECT bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY ALL")
def report_secondary_phases(spark, d):
    return reports.secondary_phases(ok(spark, d))


def groups_sql(group: str, name: str) -> str:
    return W + " " + " UNION ALL ".join(
        f"SELECT {name}, 'secondary_depth_{v}' AS \"column\", count_if(d > 0) AS found, count(d) AS total, median(d) FILTER (d > 0) AS median_found, count_if(d > 0) / nullif(count(d), 0) AS share FROM (SELECT {group} AS {name}, secondary_depth_{v} AS d FROM ok) GROUP BY {name}"
        for v in reports.VARIANTS
    )


@query(groups_sql("disposition", "disposition"))
def report_variants_by_disposition(spark, d):
    return reports.variants_by_disposition(ok(spark, d))


@query(groups_sql("CASE WHEN n_koi_for_star > 1 THEN 'multi' ELSE 'single' END", "kind"))
def report_multi_against_single(spark, d):
    return reports.multi_against_single(ok(spark, d))


@query(W + " SELECT detrend_fallback, count(*) AS n, median(detrend_masked_fraction) AS median, max(detrend_masked_fraction) AS largest FROM ok GROUP BY ALL")
def report_masked_fraction(spark, d):
    return reports.masked_fraction(ok(spark, d))


@query(
    W + """, r AS (SELECT rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2 AS a, rank() OVER (ORDER BY local_points_per_bin_median) + (count(*) OVER (PARTITION BY local_points_per_bin_median) - 1) / 2 AS b
  FROM err WHERE local_points_per_bin_median IS NOT NULL) SELECT round(corr(a, b), 5) AS rho, count(*) AS n FROM r"""
)
def report_occupancy_correlation(spark, d):
    return reports.error_rank_correlation(ok(spark, d, *OCCUPANCY), "local_points_per_bin_median").withColumn("rho", F.round("rho", 5))


@query(
    W + """, p AS (SELECT *, CASE WHEN depth < .2 THEN 'period' END AS why FROM last), s AS (SELECT kepid, count(*) AS n FROM p GROUP BY ALL)
SELECT 'rows' AS item, count(*) AS n FROM p UNION ALL SELECT 'stars', count(*) FROM s UNION ALL SELECT 'multi', count_if(n > 1) FROM s
UNION ALL SELECT 'label ' || disposition, count(*) FROM p GROUP BY ALL UNION ALL SELECT 'precheck ' || why, count(*) FROM p WHERE why IS NOT NULL GROUP BY ALL"""
)
def report_batch(spark, d):
    return batch.described(reports.latest(attempts(spark, d)), "kepid", "disposition", F.when(F.col("depth") < 0.2, "period"))


def spread_sql(value: str, edges: list[float]) -> str:
    cases = " ".join(f"WHEN {value} > {a} AND {value} <= {b} THEN {k}" for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    return W + f""", b AS (SELECT CASE {cases} END AS band, e FROM err WHERE depth > 0)
SELECT band, count(*) AS n, round(median(e), 6) + 0.0 AS median, round(median(abs(e)), 6) AS median_abs, round(quantile_cont(abs(e), .9), 6) AS p90_abs,
  round(quantile_cont(e, .75) - quantile_cont(e, .25), 6) AS iqr FROM b WHERE band IS NOT NULL GROUP BY ALL"""


SPREAD = ("median", "median_abs", "p90_abs", "iqr")


@query(spread_sql("koi_impact", reports.IMPACT_BANDS))
def report_impact_bias(spark, d):
    return rounded(reports.impact_bias(ok(spark, d, *ERROR, "koi_impact")), *SPREAD)


@query(spread_sql("local_points_per_bin_median", reports.BIAS_BANDS))
def report_sparse_bias(spark, d):
    return rounded(reports.sparse_bias(ok(spark, d, *OCCUPANCY)), *SPREAD)


@query(spread_sql("local_points_per_bin_median", reports.BUCKETS))
def report_occupancy_buckets(spark, d):
    return rounded(reports.occupancy_buckets(ok(spark, d, *OCCUPANCY)), *SPREAD)


@query(
    W + ", e AS (SELECT local_points_per_bin_median AS v, abs(e) AS a FROM err WHERE depth > 0 AND local_points_per_bin_median IS NOT NULL) "
    + " UNION ALL ".join(
        f"SELECT CAST({t} AS DOUBLE) AS \"limit\", count_if(v < {t}) AS n_below, count_if(v >= {t}) AS n_rest, round(median(a) FILTER (v < {t}), 6) AS median_below, round(median(a) FILTER (v >= {t}), 6) AS median_rest, "
        f"round(median(a) FILTER (v < {t}) - median(a) FILTER (v >= {t}), 6) AS delta FROM e HAVING count_if(v < {t}) > 0" for t in reports.SPARSE
    )
)
def report_sparse_against_rest(spark, d):
    return rounded(reports.sparse_against_rest(ok(spark, d, *OCCUPANCY)), "median_below", "median_rest", "delta")


@query(
    W + """ SELECT count(*) AS n, count_if(local_points_per_bin_median < 4.5) AS below_4_5, count_if(local_points_per_bin_median < 1) AS below_1, count_if(local_points_per_bin_median = 0) AS empty,
  min(n_local_bins) AS fewest_bins, max(n_local_bins) AS most_bins FROM ok WHERE local_points_per_bin_median IS NOT NULL"""
)
def report_sparse_counts(spark, d):
    return reports.sparse_counts(ok(spark, d))


def rank_sql(value: str, where: str) -> str:
    return W + f""", r AS (SELECT rank() OVER (ORDER BY abs(e)) + (count(*) OVER (PARTITION BY abs(e)) - 1) / 2 AS a, rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2 AS b
  FROM err WHERE depth > 0 AND {value} IS NOT NULL AND {where}) SELECT round(corr(a, b), 5) AS rho, count(*) AS n FROM r"""


@query(rank_sql("local_points_per_bin_median", "local_points_per_bin_median > 1"))
def report_correlation_without_sparse(spark, d):
    """Rank correlation of the absolute error with the occupancy, without the rows at one point a bin or fewer."""
    out = reports.error_rank_correlation(ok(spark, d, *OCCUPANCY), "local_points_per_bin_median", absolute=True, positive=True, above=1.0)
    return out.withColumn("rho", F.round("rho", 5))


@query(rank_sql("koi_impact", "true"))
def report_impact_correlation(spark, d):
    out = reports.error_rank_correlation(ok(spark, d, *ERROR, "koi_impact"), "koi_impact", absolute=True, positive=True)
    return out.withColumn("rho", F.round("rho", 5))


SCAN_COLUMNS = ", ".join(f"nullif(depth * (1 - 1.0 / {f}), 0) AS d{f}, CAST(l + {f} AS INT) AS n{f}" for f in (4, 6, 8, 12))
SCAN_SQL = W + f", scan AS (SELECT koi_depth_ppm, local_points_per_bin_median AS ppb, {SCAN_COLUMNS} FROM (SELECT *, n_koi_for_star AS l FROM ok))"


def scan_sql(where: str) -> str:
    one = lambda f: f"SELECT {f} AS fraction, d{f} AS depth, n{f} AS used, (d{f} * 1e6 - koi_depth_ppm) / koi_depth_ppm AS e FROM scan WHERE {where} AND d{f} IS NOT NULL AND koi_depth_ppm > 0"
    return SCAN_SQL + ", l AS (" + " UNION ALL ".join(map(one, (4, 6, 8, 12))) + """) SELECT fraction, count(*) AS n, round(median(e), 6) AS median, round(median(abs(e)), 6) AS median_abs,
  round(quantile_cont(e, .75) - quantile_cont(e, .25), 6) AS iqr, median(used) AS median_used FROM l GROUP BY ALL"""


def scan_rows(spark, d):
    columns = [c for f in (4, 6, 8, 12) for c in (f"nullif(depth * (1 - 1D / {f}), 0D) AS d{f}", f"CAST(n_koi_for_star + {f} AS INT) AS n{f}")]
    return ok(spark, d).selectExpr("koi_depth_ppm", "local_points_per_bin_median AS ppb", *columns)


@query(scan_sql("true"))
def report_window_scan(spark, d):
    return rounded(reports.window_scan_summary(scan_rows(spark, d)), "median", "median_abs", "iqr")


@query(scan_sql("ppb < 4.5"))
def report_window_scan_sparse(spark, d):
    """The cost of a narrow window on the sparsest rows."""
    return rounded(reports.window_scan_summary(scan_rows(spark, d), 4.5), "median", "median_abs", "iqr")
