from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from dipfold.functions import expressions as X
from dipfold.sources import archive, tables
from dipfold.sources.archive import LightCurveArchive
from dipfold.sources.versions import Versions
from dipfold.streaming import ingest


def test_catalogue(spark, tmp_path):
    head = ",".join(tables.CATALOGUE.fieldNames())
    (tmp_path / "c.csv").write_text(f"{head}\n1,K1.01,CONFIRMED,2.5,130.25,3.0,100,4,0.5,1,0.1\n1,K1.02,CANDIDATE,NaN,,2,,,,,\n")
    d = tables.read_catalogue(spark, str(tmp_path / "c.csv"))
    assert d.count() == 2 and d.where("koi_period IS NULL").count() == 1
    e = tables.ephemerides(d.where("kepoi_name = 'K1.01'")).first()
    assert (e.period_us, e.duration_us) == (216_000_000_000, 10_800_000_000)
    assert tables.read_catalogue(spark, str(tmp_path / "c.csv"), ["kepid"]).columns == ["kepid"]


def test_checkpoint_round_trip(spark, tmp_path):
    row = {"kepid": 1, "kepoi_name": "K1.01", "error_kind": "transient", "attempt_seq": 1}
    schema = tables.FEATURES + ", attempt_seq long"
    assert len(spark.createDataFrame([], tables.FEATURES).columns) == 42
    for k, kind in ((1, "transient"), (2, None)):
        d = spark.createDataFrame([row], "kepid long, kepoi_name string, error_kind string, attempt_seq long")
        full = spark.createDataFrame([], schema).unionByName(d.withColumns({"attempt_seq": F.lit(k).cast("long"), "error_kind": F.lit(kind).cast("string")}), allowMissingColumns=True)
        tables.append_attempts(full, str(tmp_path / "cp"))
    got = tables.read_checkpoint(spark, str(tmp_path / "cp")).collect()
    assert [(r.attempt_seq, r.error_kind, r.depth) for r in got] == [(2, "", None)]


def test_a_batch_is_observed_while_it_is_written(spark, tmp_path):
    """Figures without a second scan: the batch is read once."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(k // 3, f"K{k}", ("", None, "transient", "nodata", "nodata")[k % 5], k) for k in range(30)]
    d = spark.createDataFrame(rows, "kepid long, kepoi_name string, error_kind string, attempt_seq long")
    d = spark.createDataFrame([], tables.FEATURES + ", attempt_seq long").unionByName(d.mapInArrow(count, d.schema), allowMissingColumns=True)
    got = tables.append_observed(d, str(tmp_path / "c"))
    assert got == {"rows": 30, "success": 12, "stars": 10, "transient": 6, "nodata": 12} | dict.fromkeys(("precheck", "diskfull", "corruptcache", "unknown"), 0)
    assert read.value == 30 and tables.read_checkpoint(spark, str(tmp_path / "c")).count() == 30


def test_stored_by_star_nothing_moves_for_the_join(spark):
    """Candidates and curves in tables bucketed by star: no exchange between the scans and the fold."""
    from dipfold.operators import timeseries

    curve = spark.range(4000).select((F.col("id") % 40).alias("star_id"), F.lit("p").alias("product_id"), (F.col("id") * 10**9).alias("t_us"), F.rand(1).alias("flux"))
    koi = spark.range(40).select(F.col("id").alias("star_id"), F.lit(1).cast("long").alias("koi"), F.lit(10**11).alias("period_us"), F.lit(0).cast("long").alias("epoch_us"), F.lit(10**10).alias("duration_us"))
    tables.write_light_curves(curve, "stored_curves", 4)
    tables.write_candidates(koi, "stored_candidates", 4)
    try:
        d = timeseries.folded(spark.table("stored_curves"), spark.table("stored_candidates").hint("merge"))
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert d.count() == 4000
        masked = timeseries.masked(spark.table("stored_curves"), spark.table("stored_candidates").hint("merge"))
        assert "hashpartitioning(star_id" not in masked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("DROP TABLE stored_curves")
        spark.sql("DROP TABLE stored_candidates")


def test_products(spark):
    p = spark.createDataFrame([(1, "a", 1, 1800.0, "x"), (1, "b", 1, 60.0, "x"), (1, "c", 2, 1800.01, "x"), (2, "d", 1, 60.0, "x")], tables.PRODUCT)
    got = sorted((r.product_id, r.cadences_seen, r.n_products_all) for r in tables.pinned_products(p).collect())
    assert got == [("a", "60|1800", 3), ("c", "60|1800", 3)]


def test_candidates_are_upserted(spark, tmp_path):
    def rows(score, seq):
        return spark.createDataFrame([("K1", 1, None, None, None, None, None, None, score, seq)], tables.CANDIDATES + ", seq long")

    path = str(tmp_path / "candidates")
    tables.upsert_candidates(spark, path, rows(0.5, 1))
    assert [r.score for r in tables.upsert_candidates(spark, path, rows(0.7, 2)).collect()] == [0.7]


def scored(spark, *rows):
    """Candidates ``(name, star, score, seq)``."""
    return spark.createDataFrame([(k, star, None, None, None, None, None, None, score, seq) for k, star, score, seq in rows], tables.CANDIDATES + ", seq long")


def test_a_write_that_died_loses_nothing(spark, tmp_path):
    path = tmp_path / "candidates"
    tables.upsert_candidates(spark, str(path), scored(spark, ("K1", 1, 0.1, 1), ("K2", 2, 0.2, 1), ("K3", 3, 0.3, 1)))
    half = path / "rows" / "died" / "_temporary"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_text("half")
    (path / "aside" / "marker").write_text('{"rows"')
    assert tables.read_candidates(spark, str(path)).count() == 3
    now = tables.upsert_candidates(spark, str(path), scored(spark, ("K4", 4, 0.4, 1), ("K1", 1, 0.9, 1), ("K1", 1, 0.8, 2)))
    assert {(r.kepoi_name, r.score) for r in now.collect()} == {("K1", 0.8), ("K2", 0.2), ("K3", 0.3), ("K4", 0.4)}
    assert Versions(spark, str(path), tables.CANDIDATES).read(0).count() == 3


def test_two_writers_come_one_after_the_other(spark, tmp_path):
    """The second one takes its turn between the first one's reading and its marker: the first works again on what the second left."""
    v, calls = Versions(spark, str(tmp_path / "t"), "k string"), []

    def first(old):
        calls.append(old.count())
        if len(calls) == 1:
            Versions(spark, str(tmp_path / "t"), "k string").commit(lambda o: o.union(spark.createDataFrame([("second",)], "k string")))
        return old.union(spark.createDataFrame([("first",)], "k string"))

    assert {r.k for r in v.commit(first).collect()} == {"first", "second"} and calls == [0, 1] and v.last() == 1
    assert not v._publish(1, "rows/none") and len(list((tmp_path / "t" / "rows").iterdir())) == 2


def test_bad_rows_are_refused_at_the_write(spark, tmp_path):
    c, v = str(tmp_path / "c"), str(tmp_path / "v")
    for bad in (("K1", None, 0.5, 1), ("K1", 1, None, 1), (None, 1, 0.5, 1)):
        with pytest.raises(tables.ConstraintError):
            tables.upsert_candidates(spark, c, scored(spark, ("K9", 9, 0.9, 1), bad))
    assert tables.read_candidates(spark, c).count() == 0
    tables.upsert_candidates(spark, c, scored(spark, ("K1", 1, 0.5, 1)))
    review = lambda *rows: spark.createDataFrame(rows, "kepoi_name string, verdict string, remarks string, reviewer string")
    tables.add_verdicts(spark, v, c, review(("K1", "CONFIRMED", None, "me"), ("K1", "FALSE POSITIVE", "no", "you")))
    for bad, name in ((("K2", "CONFIRMED", None, "me"), "foreign key"), (("K1", "maybe", None, "me"), "check"), (("K1", "CONFIRMED", None, None), "not null")):
        with pytest.raises(tables.ConstraintError, match=name):
            tables.add_verdicts(spark, v, c, review(("K1", "CONFIRMED", None, "me"), bad))
    now = tables.add_verdicts(spark, v, c, review(("K1", "CONFIRMED", "again", "me"))).collect()
    assert sorted(r.id for r in now) == [1, 2, 3] and all(r.created_at is not None for r in now)


def test_verdict_constraints(spark):
    now = datetime.datetime(2024, 1, 1)
    c = spark.createDataFrame([("K1",)], "kepoi_name string")
    v = spark.createDataFrame(
        [(1, "K1", "CONFIRMED", None, "me", now), (2, "K2", "CONFIRMED", None, "me", now), (3, "K1", "maybe", None, "me", now), (4, "K1", "CONFIRMED", None, None, now), (5, "K1", "CONFIRMED", "", "me", now), (5, "K1", "CONFIRMED", "", "me", now)],
        tables.VERDICTS,
    )
    got = sorted((r.id, r.broken) for r in tables.invalid_verdicts(v, c).collect())
    assert got == [(2, "foreign key"), (3, "check"), (4, "not null"), (5, "primary key"), (5, "primary key")]


def test_archive(spark, tmp_path):
    (tmp_path / "7_q1.csv").write_text("1.5,0.9\n2.5,\n")
    (tmp_path / "8_q1.csv").write_text("bad,line\n")
    spark.dataSource.register(LightCurveArchive)
    source = archive.opened(spark, str(tmp_path), gap_s="0", tasks="3")
    for d in (source, archive.read_archive(spark, str(tmp_path))):
        got = sorted((r.star_id, r.product_id, r.t_bkjd, r.flux, (r.error or "")[:10]) for r in d.collect() if r.star_id == 7 or r.error)
        assert got[0] == (7, "q1", 1.5, 0.9, "") and got[1] == (7, "q1", 2.5, None, "") and got[2][4] in ("ValueError", "CorruptFil")
    (tmp_path / "77_q1.csv").write_text("1,1\n")
    assert archive.evict_star(spark, str(tmp_path), 7) == 1 and archive.evict_star(spark, str(tmp_path), 5) == 0
    assert {r.star_id for r in archive.read_archive(spark, str(tmp_path)).collect()} == {8, 77}


def test_archive_is_asked_again_and_not_too_fast(tmp_path, monkeypatch):
    (tmp_path / "7_q1.csv").write_text("1.5,0.9\n")
    reader = LightCurveArchive({"path": str(tmp_path), "pause_s": "5", "gap_s": "1.5", "tasks": "1"}).reader(None)
    asked, slept, clock = [], [], [100.0]
    monkeypatch.setattr(archive.time, "sleep", lambda s: (slept.append(s), clock.__setitem__(0, clock[0] + s)))
    monkeypatch.setattr(archive.time, "monotonic", lambda: clock[0])
    fail = 2

    def opened(f, **k):
        asked.append(clock[0])
        if len(asked) <= fail:
            raise ConnectionResetError("reset")
        return (tmp_path / "7_q1.csv").open(**k)

    monkeypatch.setattr(archive, "open", opened, raising=False)
    (part,) = reader.partitions()
    assert list(reader.read(part)) == [(7, "q1", None, 1.5, 0.9, None)]
    assert [b - a for a, b in zip(asked, asked[1:], strict=False)] == [5.0, 10.0]
    list(reader.read(part))
    assert asked[-1] - asked[-2] == 1.5
    fail, asked[:] = 9, []
    assert list(reader.read(part)) == [(7, "q1", None, None, None, "ConnectionResetError: reset")] and len(asked) == archive.ATTEMPTS


def test_only_asked_stars_are_opened(spark, tmp_path):
    """Files of other stars and cadences cannot be parsed: whoever opens them sees an error."""
    for star in range(60):
        for s in (60, 1800):
            (tmp_path / f"{star:03d}_q1@{s}.csv").write_text(f"{star},0.5\n" if star in (7, 31) and s == 1800 else "bad")
    d = archive.download(spark, str(tmp_path), [7, 31, 99], gap_s="0")
    assert {tuple(r) for r in d.collect()} == {(7, "q1", 1800.0, 7.0, 0.5, None), (31, "q1", 1800.0, 31.0, 0.5, None)}
    assert d.rdd.getNumPartitions() == 1
    every = archive.opened(spark, str(tmp_path), gap_s="0", tasks="7")
    assert every.where("error IS NOT NULL").count() == 118 and every.where("flux > 0.1").count() == 2
    assert every.where("star_id = 7 AND star_id = 31").count() == 0
    assert archive.read_archive(spark, str(tmp_path)).where("exptime_s = 1800 AND error IS NULL").count() == 2


def test_tasks_share_one_rate(spark, tmp_path):
    """Four tasks ask at once: the times at which they were let go keep the gap."""
    import time

    folder, gap = str(tmp_path / "lease"), 0.2

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            at = []
            for _ in range(batch.num_rows):
                archive.Lease(folder, gap).wait()
                at.append(time.time())
            yield pa.RecordBatch.from_arrays([pa.array(at)], ["at"])

    at = sorted(r.at for r in spark.range(0, 12, 1, 4).mapInArrow(ask, "at double").collect())
    assert len({int(t / gap) for t in at}) == 12 and min(b - a for a, b in zip(at, at[1:], strict=False)) > gap / 2
    assert at[-1] - at[0] >= 11 * gap - gap / 2


def test_corrupt_copies_are_evicted_and_fetched_again(spark, tmp_path):
    source, cache = tmp_path / "archive", tmp_path / "cache"
    source.mkdir()
    cache.mkdir()
    (source / "1_q1@1800.csv").write_text("1,0.1\n")
    (cache / "1_q1@1800.csv").write_text("half a li")
    (source / "2_q1@1800.csv").write_text("broken at the source\n")
    (source / "3_q1@1800.csv").write_text("3,0.3\n")
    (cache / "3_q1@1800.csv").write_text("3,0.4\n")
    d = archive.download(spark, str(source), [1, 2, 3], gap_s="0", pause_s="0", cache=str(cache))
    got = {r.star_id: r for r in d.collect()}
    assert (got[1].flux, got[1].error) == (0.1, None) and got[3].flux == 0.4  # a good copy is not fetched again
    assert got[2].error.startswith("CorruptFileError: error in reading data product") and (cache / "1_q1@1800.csv").read_text() == "1,0.1\n"


def test_checkpoints_are_put_together(spark, tmp_path):
    schema = tables.FEATURES + ", attempt_seq long"
    for name, kind, seq in (("a", "transient", 5), ("b", "", 1)):
        d = spark.createDataFrame([("K1", kind, seq)], "kepoi_name string, error_kind string, attempt_seq long")
        tables.append_attempts(spark.createDataFrame([], schema).unionByName(d, allowMissingColumns=True), str(tmp_path / name))
    tables.seed_checkpoint(spark, str(tmp_path / "all"), str(tmp_path / "a"), str(tmp_path / "b"))
    assert [r.error_kind for r in tables.read_checkpoint(spark, str(tmp_path / "all")).collect()] == [""]


def test_queue_is_written_in_order(spark, tmp_path):
    d = spark.createDataFrame([("K1", 0.2), ("K3", 0.9), ("K2", 0.9)], "kepoi_name string, score double")
    tables.write_queue(d, str(tmp_path / "q"))
    tables.write_queue(d.limit(2), str(tmp_path / "q"))  # overwrites
    assert spark.read.option("header", True).csv(str(tmp_path / "q")).count() == 2
    stamped = X.stamped(d)
    assert stamped.where("created_at IS NULL").count() == 0


def test_streaming_measures_touched_stars(spark, tmp_path):
    day = 86_400_000_000
    koi = spark.createDataFrame([(s, 1, 3 * day, day, day // 6) for s in (1, 2)], "star_id long, koi long, period_us long, epoch_us long, duration_us long")
    points = lambda s, a, b: spark.createDataFrame([(s, i * day // 48, 1.0 - 0.01 * (abs((i * day // 48 - day + 3 * day // 2) % (3 * day) - 3 * day // 2) < day // 12)) for i in range(a, b)], ingest.POINTS)
    source = str(tmp_path / "in")
    args = (koi, str(tmp_path / "curves"), str(tmp_path / "out"), str(tmp_path / "cp"))
    for s, a, b in ((1, 0, 800), (2, 0, 800), (1, 800, 1600)):
        points(s, a, b).write.mode("append").parquet(source)
        ingest.ingest(spark.readStream.schema(ingest.POINTS).parquet(source), *args).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).select("star_id", "attempt_seq", "depth", "n_local_points")
    got = sorted((r.attempt_seq, r.star_id, round(r.depth, 3)) for r in out.collect())
    assert got == [(0, 1, 0.01), (1, 2, 0.01), (2, 1, 0.01)]
    n = {r.attempt_seq: r.n_local_points for r in out.collect()}
    assert n[2] > n[0]


def test_arrival_order_does_not_matter(spark, tmp_path):
    """Points in two orders, batch by batch, repeats and spikes among them: the latest rows are those of one batch over all points."""
    import random

    day, rng = 86_400_000_000, random.Random(3)
    koi = spark.createDataFrame([(s, k, 3 * day, day + k, day // 6) for s in (1, 2) for k in (1, 2)], "star_id long, koi long, period_us long, epoch_us long, duration_us long")
    points = [(s, i * day // 48, 1.0 + rng.gauss(0, 1e-4) - 0.01 * (abs((i * day // 48 - day + 3 * day // 2) % (3 * day) - 3 * day // 2) < day // 12) + (0.5 if i == 77 else 0)) for s in (1, 2) for i in range(500)]
    points += [(s, t, f + 0.001) for s, t, f in rng.sample(points, 20)]
    want = {(r.star_id, r.koi): r for r in ingest.measured_all(spark.createDataFrame(points, ingest.POINTS), koi, koi, 51).collect()}
    assert len(want) == 4 and all(r.detrend_fallback == "" for r in want.values())
    for turn in range(2):
        rng.shuffle(points)
        at = tmp_path / str(turn)
        for k in range(2):
            spark.createDataFrame(points[k::2], ingest.POINTS).write.mode("append").parquet(str(at / "in"))
            ingest.ingest(spark.readStream.schema(ingest.POINTS).parquet(str(at / "in")), koi, str(at / "curves"), str(at / "out"), str(at / "cp"), 51).awaitTermination()
        out = spark.read.parquet(str(at / "out"))
        assert out.count() == 8
        for r in out.where("attempt_seq = 1").collect():
            w = want[r.star_id, r.koi]
            assert all(r[c] == (pytest.approx(w[c], rel=1e-9, abs=1e-12) if isinstance(w[c], float) else w[c]) for c in w.asDict()), (r, w)


def test_live_figures_in_the_state_of_the_stream(spark, tmp_path):
    import random

    from dipfold.operators import timeseries

    rng = random.Random(2)
    points = [(rng.randrange(6), rng.randrange(40) * 1000, 1.0) for _ in range(200)]
    spark.conf.set(*ingest.STATE_STORE)
    try:
        for k in range(3):
            spark.createDataFrame(points[k::3], ingest.POINTS).write.mode("append").parquet(str(tmp_path / "in"))
            stream = ingest.live_figures(spark.readStream.schema(ingest.POINTS).parquet(str(tmp_path / "in")))
            query = stream.writeStream.foreachBatch(lambda d, n: d.write.mode("overwrite").parquet(str(tmp_path / f"out{n}")))
            query.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(ingest.STATE_STORE[0])
    latest = {}
    for k in range(3):
        latest |= {r.star_id: tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / f"out{k}")).collect()}
    every = timeseries.duplicate_times(spark.createDataFrame(points, ingest.POINTS)).collect()
    times = {s: [t for q, t, _ in points if q == s] for s in latest}
    assert latest == {r.star_id: (r.n_points, r.n_duplicate_times, min(times[r.star_id]), max(times[r.star_id])) for r in every}


def test_light_curves_are_bucketed(spark):
    d = spark.createDataFrame([(1, 5, 1.0), (2, 6, 1.0)], ingest.POINTS)
    tables.write_light_curves(d, "curves_test", 4)
    try:
        plan = spark.table("curves_test").groupBy("star_id").count()._jdf.queryExecution().toString()
        assert "Exchange hashpartitioning" not in plan
    finally:
        spark.sql("DROP TABLE curves_test")


@pytest.mark.parametrize("c", ["depth", "secondary_guard"])
def test_schema_names(c):
    assert f"{c} " in tables.FEATURES
