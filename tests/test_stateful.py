"""Stateful streams, one file a trigger, against what the rows give when read in order."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.streaming import streams

T0 = dt.datetime(2024, 5, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """A stream of the given batches."""

    def make(name, schema, *batches):
        folder = str(tmp_path / name)
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return make


def _run(spark, stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_guard_marks_times_that_go_back(spark, feed):
    schema = "session long, t double"
    got = _run(spark, streams.guard_monotonic(feed("in", schema, [(1, 2.0), (2, 1.0)], [(1, 1.5)], [(1, 3.0), (2, 0.5)]), schema), "guard")
    assert sorted(got) == [(1, 1.5, False), (1, 2.0, True), (1, 3.0, True), (2, 0.5, False), (2, 1.0, True)]


def test_a_time_that_goes_back_begins_a_run(spark, feed):
    schema = "session long, t double"
    got = _run(spark, streams.drop_or_reset(feed("in", schema, [(1, 1.0)], [(1, 2.0)], [(1, 0.5)], [(1, 0.7)]), schema), "runs")
    assert sorted(got) == [(1, 0.5, 1), (1, 0.7, 1), (1, 1.0, 0), (1, 2.0, 0)]


def test_imu_means_come_once_and_from_the_first_samples(spark, feed):
    rows = [(s, float(t), *[float(t * c + s) for c in range(6)]) for t in range(9) for s in (1, 2)]
    schema = "session long, t double, wx double, wy double, wz double, ax double, ay double, az double"
    got = _run(spark, streams.imu_init_stream(feed("in", schema, rows[:6], rows[6:12], rows[12:]), n=4), "imu")
    assert sorted(got) == [(s, *[1.5 * c + s for c in range(6)], 4) for s in (1, 2)]


def test_voxel_planes_are_refitted_until_full(spark, feed):
    points = np.random.default_rng(3).uniform(0.01, 0.49, (15, 3))
    rows = [[tuple(map(float, p)) for p in points[k : k + 5]] for k in (0, 5, 10)]
    far = [(100.0, 0.0, 0.0)] * 5
    got = _run(spark, streams.voxel_map_stream(feed("in", "x double, y double, z double", rows[0] + far, rows[1], rows[2]), most=10), "voxels")
    assert [r[:4] for r in sorted(got)] == [(0, 0, 0, 5), (0, 0, 0, 10)]
    for *_, n, cx, cy, cz, low in got:
        assert np.allclose((cx, cy, cz), points[:n].mean(0)) and np.isclose(low, np.linalg.eigvalsh(np.cov(points[:n].T, bias=True))[0])


def test_images_wait_for_scans_and_late_ones_go(spark, feed):
    batches = [(1, 0.0, "scan"), (1, 0.1, "scan")], [(1, 0.15, "image")], [(1, 0.12, "image"), (1, 0.2, "scan")], [(1, 0.3, "image")]
    assert sorted(_run(spark, streams.align_images(feed("in", "session long, t double, kind string", *batches)), "images")) == [(1, 0.15, 2), (1, 0.3, 1)]


def test_samples_meet_their_scan(spark, feed):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    scans = feed("scans", "session long, scan_id long, begin timestamp, end timestamp", [(1, 0, at(0), at(1))], [(1, 1, at(1), at(2)), (2, 0, at(0), at(2))])
    imu = feed("imu", "session long, ts timestamp", [(1, at(0)), (1, at(1)), (2, at(2))], [(1, at(1.5)), (3, at(1))])
    got = _run(spark, streams.sync_stream(scans, imu), "sync")
    assert sorted(got) == [(1, 0, at(1), at(1)), (1, 1, at(2), at(1.5)), (2, 0, at(2), at(2))]


def test_fixes_are_told_once_and_sessions_end_at_gaps(spark, feed):
    fix = lambda s, lat: (1, T0 + dt.timedelta(seconds=s), lat, 8.0)
    schema = "session long, ts timestamp, lat double, lon double"
    batches = [fix(0, 1.0), fix(5, 1.0)], [fix(0, 1.0), fix(5, 2.0)], [fix(40, 1.0)]
    assert len(_run(spark, streams.dedupe_stream(feed("a", schema, *batches)), "fixes")) == 4
    got = _run(spark, streams.fix_sessions(feed("b", schema, *batches)).select("session", F.col("session_window.start").alias("at"), "n"), "breaks", "complete")
    assert sorted(got) == [(1, T0, 4), (1, T0 + dt.timedelta(seconds=40), 1)]


def test_chunks_overlap(spark, feed):
    rows = [(1, T0 + dt.timedelta(seconds=20 * k)) for k in range(60)]
    stream = feed("in", "session long, ts timestamp", rows[:20], rows[20:40], rows[40:])
    got = _run(spark, streams.chunk_windows(stream).select("session", F.col("window.start").alias("at"), "n"), "chunks", "complete")
    want = spark.createDataFrame(rows, "session long, ts timestamp").groupBy("session", F.window("ts", "300 seconds", "270 seconds").alias("w")).agg(F.count("*").alias("n"))
    assert sorted(got) == sorted(tuple(r) for r in want.select("session", "w.start", "n").collect()) and sum(r[2] for r in got) > 60
