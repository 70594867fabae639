"""Structured Streaming forms of the online operators. Batch twins are in operators.tracks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _stateful(stream: DataFrame, keys: list[str], function, output: str, state: str) -> DataFrame:
    return stream.groupBy(*keys).applyInPandasWithState(function, output, state, "append", GroupStateTimeout.NoTimeout)


def shift_clock(stream: DataFrame, offset: float, time: str = "t", whole: bool = False) -> DataFrame:
    """Times moved by an offset in seconds, rounded to whole seconds on demand."""
    return stream.withColumn(time, F.col(time) - (round(offset) if whole else offset))


def submap_windows(points: DataFrame, seconds: int = 10, delay: str = "30 seconds") -> DataFrame:
    """Points and centroid of each tumbling window."""
    return points.withWatermark("ts", delay).groupBy("session", F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))


def chunk_windows(messages: DataFrame, length: int = 300, overlap: int = 30, delay: str = "60 seconds") -> DataFrame:
    """Messages of each overlapping window; half-open, unlike the batch form, whose chunks hold both ends."""
    return messages.withWatermark("ts", delay).groupBy("session", F.window("ts", f"{length} seconds", f"{length - overlap} seconds")).agg(F.count("*").alias("n"))


def fix_sessions(gps: DataFrame, gap: int = 10, delay: str = "60 seconds") -> DataFrame:
    """Fixes of each session without a gap of more than so many seconds."""
    return gps.withWatermark("ts", delay).groupBy("session", F.session_window("ts", f"{gap} seconds")).agg(F.count("*").alias("n"))


def dedupe_stream(gps: DataFrame, delay: str = "60 seconds") -> DataFrame:
    """The first of equal fixes within the watermark."""
    return gps.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "ts", "lat", "lon"])


def sync_stream(scans: DataFrame, imu: DataFrame, delay: str = "60 seconds") -> DataFrame:
    """Samples with the scan in whose interval (begin, end] they lie: a join of two streams with watermarks on both.

    scans: session, scan_id, begin, end; imu: session, ts.
    """
    a = scans.withWatermark("end", delay).alias("s")
    b = imu.withWatermark("ts", delay).alias("i")
    on = (F.col("s.session") == F.col("i.session")) & (F.col("i.ts") > F.col("s.begin")) & (F.col("i.ts") <= F.col("s.end")) & (F.col("i.ts") >= F.col("s.end") - F.expr("interval 1 hour"))
    return a.join(b, on).select("s.session", "s.scan_id", "s.end", "i.ts")


def _walk(rows: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    parts = list(rows)
    return pd.concat(parts).sort_values(order, kind="stable") if parts else pd.DataFrame()


def throttle_stream(stream: DataFrame, fps: float, schema: str, key: str = "session", time: str = "t") -> DataFrame:
    """Rows at least 1 / fps seconds after the last kept one of their key; state: that time."""

    def step(k, rows, state: GroupState):
        (last,) = state.get if state.exists else (float("-inf"),)
        held, kept = _walk(rows, time), []
        for at in held[time]:
            ok = at - last >= 1 / fps - 1e-9
            last = at if ok else last
            kept.append(ok)
        state.update((last,))
        yield held[kept]

    return _stateful(stream, [key], step, schema, "last double")


def guard_monotonic(stream: DataFrame, schema: str, key: str = "session", time: str = "t") -> DataFrame:
    """Rows with ok: whether their time is later than all before it of their key; rows that aren't go to a quarantine by it."""

    def step(k, rows, state: GroupState):
        (last,) = state.get if state.exists else (float("-inf"),)
        held, said = pd.concat(list(rows)), []
        for at in held[time]:
            said.append(bool(at > last))
            last = max(last, at)
        state.update((last,))
        yield held.assign(ok=said)

    return _stateful(stream, [key], step, f"{schema}, ok boolean", "last double")


def drop_or_reset(stream: DataFrame, schema: str, key: str = "session", time: str = "t") -> DataFrame:
    """Rows with the number of their run: a time that goes back begins a new one (a lidar's buffer is cleared)."""

    def step(k, rows, state: GroupState):
        last, run = state.get if state.exists else (float("-inf"), 0)
        held, said = pd.concat(list(rows)), []
        for at in held[time]:
            run += int(at < last)
            last = at
            said.append(run)
        state.update((last, run))
        yield held.assign(run=said)

    return _stateful(stream, [key], step, f"{schema}, run long", "last double, run long")


def imu_init_stream(imu: DataFrame, n: int = 20, key: str = "session") -> DataFrame:
    """One row a key once n samples have come: mean gyro and accelerometer values."""
    names = ("wx", "wy", "wz", "ax", "ay", "az")

    def step(k, rows, state: GroupState):
        count, *sums = state.get if state.exists else (0, *[0.0] * 6)
        for row in _walk(rows, "t")[list(names)].itertuples(index=False) if count < n else ():
            if count < n:
                count, sums = count + 1, [a + b for a, b in zip(sums, row, strict=True)]
                if count == n:
                    yield pd.DataFrame([(*k, *[s / n for s in sums], n)], columns=[key, *names, "n"])
        state.update((count, *sums))

    return _stateful(imu, [key], step, f"{key} long, " + ", ".join(f"{c} double" for c in names) + ", n long", "count long, " + ", ".join(f"s{k} double" for k in range(6)))


def voxel_map_stream(points: DataFrame, size: float = 0.5, every: int = 5, most: int = 50, reach: float = 70.0) -> DataFrame:
    """A refit of a voxel's plane each so many new points, until the voxel is full; far points are dropped. State: nine sums."""
    import numpy as np

    keyed = points.where(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") <= reach * reach).withColumns({f"k{c}": F.floor(F.col(c) / size).cast("long") for c in "xyz"})

    def step(k, rows, state: GroupState):
        count, new, *sums = state.get if state.exists else (0, 0, *[0.0] * 9)
        out = []
        for x, y, z in pd.concat(list(rows))[["x", "y", "z"]].to_numpy():
            if count >= most:
                break
            count, new = count + 1, new + 1
            sums = [a + b for a, b in zip(sums, (x, y, z, x * x, x * y, x * z, y * y, y * z, z * z), strict=True)]
            if new >= every:
                new, m = 0, np.array(sums[:3]) / count
                xx, xy, xz, yy, yz, zz = (v / count for v in sums[3:])
                low = np.linalg.eigvalsh(np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]) - np.outer(m, m))[0]
                out.append((*k, count, *m, max(float(low), 0.0)))
        state.update((count, new, *sums))
        yield pd.DataFrame(out, columns=["kx", "ky", "kz", "n", "cx", "cy", "cz", "l0"])

    return _stateful(keyed, ["kx", "ky", "kz"], step, "kx long, ky long, kz long, n long, cx double, cy double, cz double, l0 double", "count long, fresh long, " + ", ".join(f"s{k} double" for k in range(9)))


def sliding_map(voxels: DataFrame, center: tuple[float, float, float], half: float, size: float) -> DataFrame:
    """Voxels within half the map's width of the pose; what lies beyond is evicted. Run in foreachBatch as the pose moves."""
    out = voxels
    for c, at in zip("xyz", center, strict=True):
        out = out.where(F.col(f"k{c}").between(int((at - half) // size), int((at + half) // size)))
    return out


def align_images(both: DataFrame, key: str = "session") -> DataFrame:
    """Of a merged stream (session, t, kind 'scan' or 'image'): images later than the last scan-or-image update, with the scans since then.

    An image from before the last update is discarded; a scan is cut off at the next image's time.
    """

    def step(k, rows, state: GroupState):
        last, waiting = state.get if state.exists else (float("-inf"), 0)
        out = []
        for at, kind in _walk(rows, "t")[["t", "kind"]].itertuples(index=False):
            if kind == "scan":
                waiting += 1
            elif at > last:
                out.append((*k, at, waiting))
                last, waiting = at, 0
        state.update((last, waiting))
        yield pd.DataFrame(out, columns=[key, "t", "scans"])

    return _stateful(both, [key], step, f"{key} long, t double, scans long", "last double, waiting long")
