"""Schemas, scans and sinks of the catalogue, light curves, checkpoints and the review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dipfold.functions import expressions as X
from dipfold.operators import relational
from dipfold.sources.versions import Versions

CATALOGUE = T.StructType([
    T.StructField("kepid", T.LongType()), T.StructField("kepoi_name", T.StringType()), T.StructField("koi_disposition", T.StringType()),
    T.StructField("koi_period", T.DoubleType()), T.StructField("koi_time0bk", T.DoubleType()), T.StructField("koi_duration", T.DoubleType()),
    T.StructField("koi_depth", T.DoubleType()), T.StructField("koi_num_transits", T.DoubleType()), T.StructField("koi_impact", T.DoubleType()),
    T.StructField("koi_prad", T.DoubleType()), T.StructField("koi_ror", T.DoubleType()),
])
LIGHT_CURVE = "star_id long, product_id string, t_bkjd double, flux double"
PRODUCT = "star_id long, product_id string, quarter int, exptime_s double, flux_origin string"

IDENTITY = ("kepid long", "kepoi_name string", "disposition string")
REFERENCE = ("koi_depth_ppm double", "koi_duration_hours double", "koi_period_days double", "koi_num_transits double")
MEASURED = ("depth double", "width double", "asymmetry double", "snr double", "odd_even_diff double", "secondary_depth double")
DIAGNOSTIC = (
    "n_products_all long", "n_products_used long", "cadences_seen string", "flux_origin string", "n_raw_points long", "n_duplicate_times long",
    "cadence_minutes double", "flatten_window_points int", "duration_over_period double", "n_koi_for_star long", "detrend_masked_fraction double",
    "detrend_fallback string", "n_siblings long", "sibling_masked_fraction double", "n_local_points long", "n_local_bins long", "n_local_bins_filled long",
    "local_points_per_bin_median double", "secondary_noise double", "secondary_depth_longest double", "secondary_phase_fraction_longest double",
    "secondary_depth_deepest double", "secondary_phase_fraction_deepest double", "secondary_depth_deepest_min2 double",
    "secondary_phase_fraction_deepest_min2 double", "secondary_exclusion_fraction double", "secondary_guard string",
)
ERRORS = ("error string", "error_kind string")
#: Kinds of error.
KINDS = ("precheck", "nodata", "transient", "diskfull", "corruptcache", "unknown")
FEATURES = ", ".join((*IDENTITY, *REFERENCE, *MEASURED, *DIAGNOSTIC, *ERRORS))
CANDIDATES = "kepoi_name string, kepid long, depth double, width double, asymmetry double, snr double, odd_even_diff double, secondary_depth double, score double"
VERDICTS = "id long, kepoi_name string, verdict string, remarks string, reviewer string, created_at timestamp"


def names(columns: tuple[str, ...]) -> list[str]:
    return [c.split()[0] for c in columns]


def cleaned(d: DataFrame) -> DataFrame:
    """NaN to NULL in all floating columns, once, where data comes in."""
    return d.withColumns({c: X.null_if_nan(F.col(c)) for c, t in d.dtypes if t in ("double", "float")})


def read_catalogue(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The catalogue from CSV with a fixed schema; of ``columns`` alone, only those are parsed."""
    d = cleaned(spark.read.schema(CATALOGUE).option("header", True).option("enforceSchema", False).csv(path))
    return d.select(*columns) if columns else d


def ephemerides(catalogue: DataFrame) -> DataFrame:
    """Candidates in whole microseconds from a catalogue in days and hours."""
    return catalogue.select(
        F.col("kepid").alias("star_id"), F.col("kepoi_name").alias("koi"), F.col("koi_disposition").alias("disposition"), X.days_to_us(F.col("koi_period")).alias("period_us"),
        X.days_to_us(F.col("koi_time0bk")).alias("epoch_us"), X.days_to_us(F.col("koi_duration") / 24).alias("duration_us"),
    )


def read_light_curves(spark: SparkSession, path: str) -> DataFrame:
    d = cleaned(spark.read.schema(LIGHT_CURVE).parquet(path))
    return d.select("star_id", "product_id", X.days_to_us(F.col("t_bkjd")).alias("t_us"), "flux")


def pinned_products(products: DataFrame, exptime_s: float = 1800.0) -> DataFrame:
    """Products of the wanted cadence, with what cadences the star has at all."""
    seen = F.array_join(F.sort_array(F.collect_set(F.rint("exptime_s").cast("int"))), "|")
    per = products.groupBy("star_id").agg(seen.alias("cadences_seen"), F.count("*").alias("n_products_all"))
    return products.where(X.close_to(F.col("exptime_s"), exptime_s)).join(per, "star_id")


def write_light_curves(d: DataFrame, table: str, buckets: int) -> None:
    """As a table bucketed and sorted by star, so that joins and windows by star need no shuffle."""
    d.write.bucketBy(buckets, "star_id").sortBy("star_id", "t_us").mode("overwrite").saveAsTable(table)


def write_candidates(d: DataFrame, table: str, buckets: int) -> None:
    """Candidates in the same way; with as many buckets as the curves have, the two meet where they lie."""
    d.write.bucketBy(buckets, "star_id").sortBy("star_id").mode("overwrite").saveAsTable(table)


def append_attempts(d: DataFrame, path: str) -> None:
    """Add a batch to the append-only checkpoint; rows carry ``attempt_seq``."""
    d.write.mode("append").parquet(path)


def append_observed(d: DataFrame, path: str) -> dict[str, int]:
    """As :func:`append_attempts`; returns the figures of the batch, observed in the pass that writes it: no second scan.

    ``rows``, ``success``, ``stars`` (approximate from some thousands on, as a sketch) and a count for each kind of error in KINDS.
    """
    figures = Observation()
    kind = F.coalesce("error_kind", F.lit(""))
    counts = [F.count(F.lit(1)).alias("rows"), F.count(F.when(kind == "", 1)).alias("success"), F.approx_count_distinct("kepid", 0.01).alias("stars")]
    append_attempts(d.observe(figures, *counts, *(F.count(F.when(kind == k, 1)).alias(k) for k in KINDS)), path)
    return figures.get


def seed_checkpoint(spark: SparkSession, path: str, *earlier: str) -> None:
    """Begin a combined checkpoint with the rows of earlier ones, in their order: later ones count as later attempts."""
    schema = FEATURES + ", attempt_seq long"
    base = 0
    for source in earlier:
        d = spark.read.schema(schema).parquet(source)
        append_attempts(d.withColumn("attempt_seq", F.col("attempt_seq") + base), path)
        base += (d.agg(F.max("attempt_seq")).first()[0] or 0) + 1


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The latest attempt of each candidate."""
    d = spark.read.schema(FEATURES + ", attempt_seq long").parquet(path)
    d = d.withColumns({c: F.coalesce(c, F.lit("")) for c in ("error_kind", "cadences_seen", "flux_origin", "secondary_guard", "detrend_fallback")})
    return relational.keep_last(d, ["kepoi_name"], "attempt_seq")


def write_queue(d: DataFrame, path: str) -> None:
    """The ranked queue as CSV."""
    relational.ranked(d, "score", "kepoi_name").write.mode("overwrite").option("header", True).csv(path)


class ConstraintError(ValueError):
    """Rows that break a constraint of the review tables were refused; nothing was written."""


def _refuse(broken: DataFrame, table: str) -> None:
    first = broken.limit(5).collect()
    if first:
        raise ConstraintError(f"{table}: " + "; ".join(f"{r.broken} {r.asDict()}" for r in first))


def invalid_candidates(candidates: DataFrame) -> DataFrame:
    """Rows without a key, a star or a score, with the constraint's name. Several rows of one key are no fault: the last one counts."""
    why = F.coalesce(F.when(F.col("kepoi_name").isNull(), "primary key"), F.when(F.col("kepid").isNull() | F.col("score").isNull(), "not null"))
    return candidates.withColumn("broken", why).where("broken IS NOT NULL")


def upsert_candidates(spark: SparkSession, path: str, incoming: DataFrame) -> DataFrame:
    """Put ``incoming`` (with ``seq``) in or over the candidates at ``path``; returns what is then current.

    Bad rows are refused, all or nothing. The new state is a version of its own (:mod:`versions`): a write that dies leaves the table as it was, and
    two writers come one after the other.
    """
    _refuse(invalid_candidates(incoming), "candidates")
    return Versions(spark, path, CANDIDATES).commit(lambda old: relational.upserted(old, cleaned(incoming), ["kepoi_name"]))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return Versions(spark, path, CANDIDATES).read()


def add_verdicts(spark: SparkSession, path: str, candidates: str, incoming: DataFrame) -> DataFrame:
    """Append ``incoming`` (``kepoi_name, verdict, remarks, reviewer``) to the verdicts at ``path``; returns what is then current.

    Each row gets the next ``id`` and the time of the write. Rows about an unknown candidate (of the table at ``candidates``), with another verdict than the two, or
    without a reviewer are refused, all or nothing, before anything is written.
    """
    known = read_candidates(spark, candidates)

    def with_new(old: DataFrame) -> DataFrame:
        first = (old.agg(F.max("id")).first()[0] or 0) + 1
        # reviews are written by hand: a batch of them is small
        number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("kepoi_name", "reviewer", "verdict", "remarks"))
        new = X.stamped(incoming.select("kepoi_name", "verdict", "remarks", "reviewer")).withColumn("id", (number + (first - 1)).cast("long"))
        _refuse(invalid_verdicts(new, known), "verdicts")
        return old.unionByName(new)

    return Versions(spark, path, VERDICTS).commit(with_new)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return Versions(spark, path, VERDICTS).read()


def invalid_verdicts(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows that break a constraint of the review tables, with the constraint's name."""
    known = candidates.select(F.col("kepoi_name").alias("_k")).distinct()
    d = verdicts.join(known, F.col("kepoi_name") == F.col("_k"), "left")
    twice = F.count("*").over(Window.partitionBy("id"))
    d = d.withColumn("_n", twice)
    why = F.coalesce(
        F.when(F.col("id").isNull() | (F.col("_n") > 1), "primary key"), F.when(F.col("_k").isNull(), "foreign key"),
        F.when(~F.coalesce(F.col("verdict").isin("CONFIRMED", "FALSE POSITIVE"), F.lit(False)), "check"), F.when(F.col("reviewer").isNull(), "not null"),
    )
    return d.withColumn("broken", why).where("broken IS NOT NULL").drop("_k", "_n")


def write_jdbc(d: DataFrame, url: str, table: str, properties: dict | None = None) -> None:
    """Append to a database table through any JDBC driver on the class path."""
    d.write.jdbc(url, table, mode="append", properties=properties or {})
