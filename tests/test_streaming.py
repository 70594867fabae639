"""Streams over files, one a trigger, against their batch forms."""

import pytest
from pyspark.sql import functions as F

from scanloom.streaming import streams


@pytest.fixture
def source(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 3).alias("session"), (F.col("id") * 0.5).alias("t"), F.timestamp_seconds(F.col("id") * 0.5).alias("ts"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    for k in range(3):
        rows.where(F.col("t").between(k * 50, k * 50 + 49.9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), rows


def _run(spark, stream, mode="append"):
    name = f"t{abs(hash(str(stream.schema)))}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_windows_match_batch(spark, source):
    stream, rows = source
    got = {(r["session"], r["window"]["start"]): r["n"] for r in _run(spark, streams.submap_windows(stream, 10), "complete").collect()}
    want = {(r["session"], r["w"]["start"]): r["n"] for r in rows.groupBy("session", F.window("ts", "10 seconds").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_throttle_keeps_the_interval(spark, source):
    stream, _ = source
    kept = _run(spark, streams.throttle_stream(stream.select("session", "t"), 0.2, "session long, t double"))
    for s in range(3):
        times = sorted(r["t"] for r in kept.where(f"session = {s}").collect())
        assert len(times) == 25 and all(b - a >= 5 - 1e-9 for a, b in zip(times, times[1:], strict=False))
