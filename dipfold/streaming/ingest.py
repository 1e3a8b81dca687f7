"""Streaming ingestion of new light-curve points: an extension, since the batch operators have no streaming counterpart to match.

New points are appended to the curve table batch by batch; only stars that a batch touched are measured again, exactly as a batch over all points
would (duplicates out, clipped, detrended, at the bins of the local view), and their new rows go to the append-only checkpoint, where the latest attempt
counts. So the latest rows do not depend on the order in which points arrive.

:func:`live_figures` keeps what a watcher wants to know of each star in the state of the stream: which time stamps were seen, how many points and
repeats there are, and the curve's extent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from dipfold.operators import features
from dipfold.operators import timeseries as T

POINTS = "star_id long, t_us long, flux double"
#: Folders by which the curve table is laid out; a batch reads those of the stars it touched.
BUCKETS = 256
#: Needed for the state of single time stamps.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def bucket() -> Column:
    return F.pmod(F.hash("star_id"), F.lit(BUCKETS))


def measured_all(curve: DataFrame, koi: DataFrame, everything: DataFrame, n_bins: int = features.LOCAL_BINS) -> DataFrame:
    """Features of all candidates from all points of their stars: repeats out, clipped, stars with too few points left out, detrended."""
    clean = T.enough_points(T.clipped(T.deduplicated(curve)))
    return features.measured(clean, koi, everything, n_bins)


def measured_again(spark: SparkSession, curves: str, koi: DataFrame, touched: DataFrame, n_bins: int) -> DataFrame:
    """Features of the touched stars, from the folders of the curve table that hold them."""
    stars = touched.select("star_id").distinct()
    folders = [r[0] for r in stars.select(bucket()).distinct().collect()]  # at most BUCKETS numbers
    curve = spark.read.schema(POINTS + ", batch long, bucket int").parquet(curves).where(F.col("bucket").isin(folders))
    curve = curve.select("star_id", "t_us", "flux").join(stars, "star_id", "left_semi")
    return measured_all(curve, koi.join(stars, "star_id", "left_semi"), koi, n_bins)


def ingest(points: DataFrame, koi: DataFrame, curves: str, results: str, checkpoint: str, n_bins: int = features.LOCAL_BINS, trigger: dict | None = None) -> StreamingQuery:
    """Start a query over a stream of ``star_id, t_us, flux``; repeated batches overwrite what they wrote before."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.select("star_id", "t_us", "flux", bucket().alias("bucket")).write.partitionBy("bucket").mode("overwrite").parquet(f"{curves}/batch={number}")
        out = measured_again(spark, curves, koi, rows, n_bins).withColumn("attempt_seq", F.lit(number).cast("long"))
        out.write.mode("overwrite").parquet(f"{results}/batch={number}")

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class _Star(StatefulProcessor):
    """The time stamps that a star has been seen at, and figures of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "t_us long", "n long")
        self.figures = handle.getValueState("figures", "n_points long, n_repeats long, first_us long, last_us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, repeats, first, last = self.figures.get() if self.figures.exists() else (0, 0, None, None)
        for frame in rows:
            for t, times in frame["t_us"].value_counts(sort=False).items():
                t, times = int(t), int(times)
                before = self.seen.getValue((t,))[0] if self.seen.containsKey((t,)) else 0
                self.seen.updateValue((t,), (before + times,))
                n, repeats = n + times, repeats + times - (before == 0)
                first, last = t if first is None else min(first, t), t if last is None else max(last, t)
        self.figures.update((n, repeats, first, last))
        yield pd.DataFrame({"star_id": [key[0]], "n_points": [n], "n_duplicate_times": [repeats], "first_us": [first], "last_us": [last]})

    def close(self) -> None:
        pass


def live_figures(points: DataFrame) -> DataFrame:
    """``star_id, n_points, n_duplicate_times, first_us, last_us`` of each star that a batch touched, over all batches so far.

    The same as :func:`timeseries.duplicate_times` over all points, in whatever order they come. State is kept by star and time stamp, in
    RocksDB, so a star's time stamps need not fit into memory; the session's state store must be STATE_STORE.
    """
    out = "star_id long, n_points long, n_duplicate_times long, first_us long, last_us long"
    return points.where("star_id IS NOT NULL AND t_us IS NOT NULL").groupBy("star_id").transformWithStateInPandas(_Star(), out, "Update", "None")


def windowed_counts(points: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Points and mean flux of each star in tumbling windows of a stream with an event time ``ts``; late rows are dropped."""
    return points.withWatermark("ts", late).groupBy(F.window("ts", width), "star_id").agg(F.count("*").alias("n_points"), F.avg("flux").alias("mean_flux"))
