"""Light curves and candidates derived from the driver's ``events``: whole numbers only, the same in every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipfold.functions.expressions import DAY_US, HOUR_US


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def light_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``star_id, t_us, flux`` (hundredths, as a whole number)."""
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("star_id"), t.alias("t_us"), F.round(F.col("value") * 100).cast("long").alias("flux"), F.col("event_type").alias("product_id")
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate for each star, two for every fourth."""
    s, k = F.col("star_id"), F.col("koi")
    stars = table(spark, sf_dir, "events").select(F.col("user_id").alias("star_id")).distinct()
    d = stars.withColumn("koi", F.explode(F.when(s % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).withColumn("koi", k.cast("long"))
    return d.select("star_id", "koi", ((2 + (s + k) % 5) * DAY_US).alias("period_us"), ((7 * s + k) % 24 * HOUR_US).alias("epoch_us"), ((6 + (s + k) % 4) * HOUR_US).alias("duration_us"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with what a catalogue says of them; some cannot be measured: without a period, or without an event."""
    s, k = F.col("star_id"), F.col("koi")
    return candidates(spark, sf_dir).select(
        "star_id", "koi", F.element_at(F.array(*map(F.lit, ("CONFIRMED", "FALSE POSITIVE", "CANDIDATE"))), ((s + k) % 3 + 1).cast("int")).alias("disposition"),
        F.when(s % 29 != 3, F.col("period_us")).alias("period_us"), "epoch_us", "duration_us", (1000.0 + (37 * s + k) % 5000).alias("koi_depth_ppm"),
        F.when(s % 17 != 5, ((s + k) % 13).cast("double")).alias("koi_num_transits"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product for each star and type of event; one type is of another cadence, and every eleventh star has no other."""
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("star_id"), F.col("event_type").alias("product_id")).distinct()
    short = (F.col("product_id") == "signup") | (F.col("star_id") % 11 == 4)
    return p.select("star_id", "product_id", F.when(short, 60.0).otherwise(1800.0).alias("exptime_s"), F.when(F.col("product_id") == "click", "sap_flux").otherwise("pdcsap_flux").alias("flux_origin"))


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score from their length: inputs for the metrics."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    score = (F.col("n_chars") % 1000) / 1000.0
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "source", F.col("quality").alias("label"), score.alias("score"))


#: The same for DuckDB.
BASE_SQL = """
lc AS (
  SELECT user_id AS star_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS t_us,
         CAST(round(value * 100) AS BIGINT) AS flux, event_type AS product_id FROM events
), koi AS (
  SELECT star_id, k AS koi, (2 + (star_id + k) % 5) * 86400000000 AS period_us, (7 * star_id + k) % 24 * 3600000000 AS epoch_us,
         (6 + (star_id + k) % 4) * 3600000000 AS duration_us
  FROM (SELECT DISTINCT user_id AS star_id FROM events) s CROSS JOIN (VALUES (1::BIGINT), (2::BIGINT)) v(k) WHERE k = 1 OR star_id % 4 = 0
)"""

FOLDED_SQL = """folded AS (
  SELECT koi.*, t_us, flux, ((t_us - epoch_us + period_us // 2) % period_us + period_us) % period_us - period_us // 2 AS ph_us,
         CAST(round_even((t_us - epoch_us) / period_us, 0) AS BIGINT) AS cycle
  FROM koi JOIN lc USING (star_id)
), masked AS (
  SELECT *, 2 * abs(ph_us) < 3 * duration_us AS in_primary,
         2 * abs(ph_us) < 3 * duration_us OR abs(2 * abs(ph_us) - period_us) < 3 * duration_us AS in_secondary,
         EXISTS (SELECT 1 FROM koi s WHERE s.star_id = f.star_id AND s.koi <> f.koi AND
           2 * abs(((f.t_us - s.epoch_us + s.period_us // 2) % s.period_us + s.period_us) % s.period_us - s.period_us // 2) < 3 * s.duration_us) AS in_sibling
  FROM folded f
)"""

CURVE_SQL = BASE_SQL + ", " + FOLDED_SQL

#: Stars and candidates for whole rows: products, cleaned curves, and the candidates that pass their precheck (siblings are all).
ROWS_SQL = BASE_SQL.replace("lc AS (", "lc0 AS (").replace("), koi AS (", "), koi0 AS (") + """, prod AS (
  SELECT DISTINCT user_id AS star_id, event_type AS product_id, CASE WHEN event_type = 'signup' OR user_id % 11 = 4 THEN 60 ELSE 1800 END AS exptime_s,
    CASE WHEN event_type = 'click' THEN 'sap_flux' ELSE 'pdcsap_flux' END AS flux_origin FROM events
), pin AS (
  SELECT star_id, count(*) AS n_products_all, count_if(exptime_s = 1800) AS n_products_used, array_to_string(list_sort(list(DISTINCT exptime_s)), '|') AS cadences_seen,
    arg_min(flux_origin, product_id) FILTER (exptime_s = 1800) AS flux_origin FROM prod GROUP BY ALL
), st AS (
  SELECT star_id, product_id, t_us, flux / nullif(median(flux) OVER (PARTITION BY star_id, product_id), 0) AS flux FROM lc0 SEMI JOIN (SELECT * FROM prod WHERE exptime_s = 1800) USING (star_id, product_id)
), dd AS (SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY star_id) AS n_all, row_number() OVER (PARTITION BY star_id, t_us ORDER BY product_id, flux) AS n FROM st) WHERE n = 1
), c0 AS (SELECT *, n_all - count(*) OVER (PARTITION BY star_id) AS again FROM dd), """ + "".join(
    f"c{k + 1} AS (SELECT * FROM c{k} WINDOW w AS (PARTITION BY star_id) QUALIFY flux IS NULL OR (flux <= median(flux) OVER w + 5 * stddev_pop(flux) OVER w AND flux >= median(flux) OVER w - 20 * stddev_pop(flux) OVER w)), "
    for k in range(5)
) + """gp AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY star_id ORDER BY t_us) AS gap FROM c5
), info AS (SELECT star_id, count(*) AS n_raw_points, max(again) AS n_duplicate_times, median(gap) / 60e6 AS cadence_minutes FROM gp GROUP BY ALL
), lc AS (SELECT star_id, t_us, flux FROM c5 QUALIFY count(*) OVER (PARTITION BY star_id) >= 50
), cat AS (
  SELECT star_id, koi, ['CONFIRMED', 'FALSE POSITIVE', 'CANDIDATE'][(star_id + koi) % 3 + 1] AS disposition, CASE WHEN star_id % 29 <> 3 THEN period_us END AS period_us, epoch_us, duration_us,
    1000.0 + (37 * star_id + koi) % 5000 AS koi_depth_ppm, CASE WHEN star_id % 17 <> 5 THEN CAST((star_id + koi) % 13 AS DOUBLE) END AS koi_num_transits, count(*) OVER (PARTITION BY star_id) AS n_koi_for_star FROM koi0
), why AS (SELECT *, CASE WHEN period_us IS NULL THEN 'koi_period missing or non-positive' WHEN koi_num_transits < 1 THEN 'koi_num_transits is 0' END AS reason FROM cat
), koi AS (SELECT star_id, koi, period_us, epoch_us, duration_us FROM why WHERE reason IS NULL
), """ + FOLDED_SQL.replace("FROM koi s WHERE", "FROM cat s WHERE")


def local_bins_sql(n_bins: int, source: str = "folded", by: str = "", name: str = "bins") -> str:
    key = "star_id, koi" + by
    return f""", {name}_slice AS (
  SELECT *, min(ph_us) OVER (PARTITION BY {key}) AS min_ph FROM {source} WHERE abs(ph_us) < 2 * duration_us
), {name}_full AS (
  SELECT {key}, duration_us, min_ph, (ph_us - min_ph) * {n_bins} // (4 * duration_us) AS idx, sum(flux) AS s, count(*) AS n, count(flux) AS m
  FROM {name}_slice GROUP BY ALL
), {name}_grid AS (
  SELECT {key}, duration_us, min_ph, unnest(generate_series(0, max(idx))) AS idx FROM {name}_full GROUP BY {key}, duration_us, min_ph
), {name} AS (
  SELECT {", ".join("g." + c.strip() for c in key.split(","))}, g.duration_us, g.min_ph, g.idx, s / nullif(m, 0) AS flux, coalesce(n, 0) AS n_points,
         2 * {n_bins} * g.min_ph + (2 * g.idx + 1) * 4 * g.duration_us AS c2n
  FROM {name}_grid g LEFT JOIN {name}_full f ON {" AND ".join(f"g.{c.strip()} = f.{c.strip()}" for c in key.split(","))} AND g.idx = f.idx
)"""


def flat_sql(source: str = "masked", name: str = "flat", siblings: bool = True) -> str:
    """The curve of ``source`` with ``flat`` and ``status``: every window's quadratic by sums over its own points."""
    key = "star_id, koi"
    full = "in_secondary OR in_sibling" if siblings else "in_secondary"
    share = lambda c: f"avg(CASE WHEN {c} THEN 0 ELSE 1 END) OVER k"
    seen = lambda what: f"last_value(CASE WHEN seen THEN {what} END IGNORE NULLS) OVER"
    back, ahead = "b", "a"
    n = name
    return f""", {n}_g AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY {key} ORDER BY t_us) AS gap FROM {source}
), {n}_c AS (SELECT *, median(gap) OVER k AS cad, CASE WHEN {share(full)} >= .25 THEN {full} WHEN {share("in_secondary")} >= .25 THEN in_secondary WHEN {share("in_primary")} >= .25 THEN in_primary END AS mask
  FROM {n}_g WINDOW k AS (PARTITION BY {key})
), {n}_w AS (SELECT *, CASE WHEN cad > 0 THEN greatest(CAST(floor(3 * duration_us / cad) AS BIGINT), 5) END AS w0, flux IS NOT NULL AND NOT coalesce(mask, false) AS seen,
    sum(CASE WHEN gap > 5 * cad THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY t_us) AS seg FROM {n}_c
), {n}_i AS (SELECT *, w0 + (w0 + 1) % 2 AS w, (w0 + (w0 + 1) % 2) // 2 AS h, row_number() OVER {back} - 1 AS i, count(*) OVER (PARTITION BY {key}, seg) AS n,
    {seen("t_us")} {back} AS tb, {seen("flux")} {back} AS vb, {seen("t_us")} {ahead} AS ta, {seen("flux")} {ahead} AS va
  FROM {n}_w WINDOW {back} AS (PARTITION BY {key}, seg ORDER BY t_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {ahead} AS (PARTITION BY {key}, seg ORDER BY t_us DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), {n}_y AS (SELECT *, CAST(CASE WHEN seen THEN flux WHEN tb IS NULL THEN va WHEN ta IS NULL THEN vb ELSE vb + (va - vb) * (t_us - tb) / (ta - tb) END AS DOUBLE) AS y FROM {n}_i
), {n}_l AS (SELECT *, median(y) OVER (PARTITION BY {key}, seg) AS level, greatest(h, least(i, n - 1 - h)) AS c FROM {n}_y
), {n}_m AS (SELECT a.star_id, a.koi, a.seg, a.i, sum(b.y) AS m0, sum((b.i - a.c) * b.y) AS m1, sum((b.i - a.c) * (b.i - a.c) * b.y) AS m2
  FROM {n}_l a JOIN {n}_y b ON a.star_id = b.star_id AND a.koi = b.koi AND a.seg = b.seg AND b.i BETWEEN a.c - a.h AND a.c + a.h WHERE a.n >= a.w GROUP BY ALL
), {n}_q AS (SELECT l.*, m0, m1, m2, h * (h + 1) * w / 3.0::DOUBLE AS s2, h * (h + 1) * w * (3 * h * h + 3 * h - 1) / 15.0::DOUBLE AS s4 FROM {n}_l l LEFT JOIN {n}_m m ON l.star_id = m.star_id AND l.koi = m.koi AND l.seg = m.seg AND l.i = m.i
), {n}_t AS (SELECT *, CASE WHEN n < w THEN level ELSE (m0 - (w * m2 - s2 * m0) / (w * s4 - s2 * s2) * s2) / w + (i - c) * m1 / s2 + (i - c) * (i - c) * ((w * m2 - s2 * m0) / (w * s4 - s2 * s2)) END AS trend FROM {n}_q
), {n}_f AS (SELECT *, CASE WHEN mask IS NULL THEN flux WHEN w IS NOT NULL THEN flux / nullif(trend, 0) END AS flat FROM {n}_t
), {n} AS (SELECT *, CASE WHEN mask IS NULL THEN 'none' WHEN count(flat) OVER (PARTITION BY {key}) > 0 THEN '' ELSE 'nodata' END AS status FROM {n}_f)"""


LABELS_SQL = "scored AS (SELECT l.doc_id, source, quality AS label, (n_chars % 1000) / 1000.0 AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
