"""Stateful streams by event time: scans held until the inertial samples pass them, scans cut at images, a map that slides.

Rows of a batch come in no order, so nothing is settled before the watermark has passed it: a result is the same however rows are
dealt to batches, as long as they come within the delay. Timers settle what waits when no further row of its key comes,
and drop what nothing can use any more: state holds what lies between the watermark and the last settled time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(stream: DataFrame, keys: list[str], function, output: str, state: str) -> DataFrame:
    return stream.groupBy(*keys).applyInPandasWithState(function, output, state, "append", GroupStateTimeout.EventTimeTimeout)


def _wake(state: GroupState, seconds: float) -> None:
    state.setTimeoutTimestamp(max(int(seconds * 1000) + 1, state.getCurrentWatermarkMs() + 1))


def _read(rows: Iterator[pd.DataFrame], state: GroupState, empty: tuple) -> tuple[tuple, pd.DataFrame | None, float]:
    held = tuple(state.get) if state.exists else empty
    parts = [] if state.hasTimedOut else list(rows)
    return held, (pd.concat(parts) if parts else None), state.getCurrentWatermarkMs() / 1000


def hold_scans(merged: DataFrame, patience: float = 10.0, delay: str = "2 seconds", key: str = "session") -> DataFrame:
    """Each scan once the inertial samples have passed its end, with the samples since the scan before it.

    merged: key, ts (timestamp, the watermark's), t (the same in seconds; a scan's is its end), kind ('scan' or 'imu') and id (a
    scan's). Returns key, id, t, imu (times, ascending) and complete: false where no sample passed the end within
    patience seconds of event time; then the scan goes with those it has. Samples that no scan has asked for in
    that time are dropped.
    """

    def step(k, rows, state: GroupState):
        (ids, ends, imu, newest), new, now = _read(rows, state, ([], [], [], -1e300))
        scans, imu = list(zip(ends, ids, strict=True)), list(imu)
        if new is not None:
            scans += [(float(t), int(i)) for t, i in new.loc[new["kind"] == "scan", ["t", "id"]].itertuples(index=False)]
            imu += new.loc[new["kind"] == "imu", "t"].tolist()
            newest = max([newest, *imu])
        scans, imu, out = sorted(scans), sorted(imu), []
        while scans and scans[0][0] < now:
            end, name = scans[0]
            complete = newest >= end
            if not complete and now < end + patience:
                break
            cut = int(np.searchsorted(imu, end, "right"))
            out.append((*k, name, end, imu[:cut], complete))
            imu, scans = imu[cut:], scans[1:]
        if not scans:
            imu = [t for t in imu if t >= now - patience]
        if scans or imu or newest >= now - patience:
            state.update(([i for _, i in scans], [t for t, _ in scans], imu, newest))
            _wake(state, (scans[0][0] if scans[0][0] >= now else scans[0][0] + patience) if scans else (imu[0] if imu else newest) + patience)
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[key, "id", "t", "imu", "complete"])

    return _timed(merged.withWatermark("ts", delay), [key], step, f"{key} long, id long, t double, imu array<double>, complete boolean", "ids array<long>, ends array<double>, imu array<double>, newest double")


def cut_at_images(merged: DataFrame, patience: float = 10.0, delay: str = "2 seconds", key: str = "session") -> DataFrame:
    """Each image with the points before it that no image has had, and the inertial samples since the last one: scans are cut at it.

    merged: key, ts, t, kind ('point', 'imu' or 'image') and id. An image waits until points and samples have passed it; it
    is refused (kept false, nothing attached) where it is no later than 10 microseconds after the last one that was kept, or where
    they don't pass it within patience seconds of event time. Points at an image's time and later wait for the next one. Points
    and samples that wait longer than that behind the watermark without an image go.
    """

    def step(k, rows, state: GroupState):
        (ids, times, imu, images, names, last, lidar, inertial), new, now = _read(rows, state, ([], [], [], [], [], -1e300, -1e300, -1e300))
        points, waiting, imu = list(zip(times, ids, strict=True)), list(zip(images, names, strict=True)), list(imu)
        if new is not None:
            for kind, into in (("point", points), ("image", waiting)):
                into += [(float(t), int(i)) for t, i in new.loc[new["kind"] == kind, ["t", "id"]].itertuples(index=False)]
            imu += new.loc[new["kind"] == "imu", "t"].tolist()
            lidar, inertial = max([lidar, *[t for t, _ in points]]), max([inertial, *imu])
        points, waiting, imu, out = sorted(points), sorted(waiting), sorted(imu), []
        while waiting and waiting[0][0] < now:
            at, name = waiting[0]
            passed = lidar >= at and inertial >= at
            if at < last + 1e-5 or (not passed and now >= at + patience):
                out.append((*k, name, at, [], [], False))
            elif not passed:
                break
            else:
                cut, past = int(np.searchsorted([t for t, _ in points], at, "left")), int(np.searchsorted(imu, at, "right"))
                out.append((*k, name, at, [i for _, i in points[:cut]], [t for t in imu[:past] if t > last], True))
                points, imu, last = points[cut:], imu[past:], at
            waiting = waiting[1:]
        if not waiting:
            points, imu = [x for x in points if x[0] >= now - patience], [t for t in imu if t >= now - patience]
        if waiting or points or imu or max(last, lidar, inertial) >= now - patience:
            state.update(([i for _, i in points], [t for t, _ in points], imu, [t for t, _ in waiting], [i for _, i in waiting], last, lidar, inertial))
            first = min([*[t for t, _ in points[:1]], *imu[:1]], default=max(last, lidar, inertial))
            _wake(state, (waiting[0][0] if waiting[0][0] >= now else waiting[0][0] + patience) if waiting else first + patience)
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[key, "id", "t", "points", "imu", "kept"])

    names = "ids array<long>, times array<double>, imu array<double>, images array<double>, names array<long>, last double, lidar double, inertial double"
    return _timed(merged.withWatermark("ts", delay), [key], step, f"{key} long, id long, t double, points array<long>, imu array<double>, kept boolean", names)


def slide_map(merged: DataFrame, size: float = 0.5, tile: int = 16, half: int = 100, stride: int = 32, idle: float = 600.0, delay: str = "2 seconds", key: str = "session") -> DataFrame:
    """Voxels that leave the map as it slides: key, t (of the slide), kx, ky, kz and n, the points it held.

    merged: key, ts, t, kind ('point' or 'slide') and x, y, z. At a slide (a pose, thinned to those that move the map), voxels more
    than half voxels from it on any axis go. State is a tile of voxels a key: a slide is sent only to tiles that reach
    beyond the box, and no more than stride voxels beyond it, the most that a slide may move; a tile that hears nothing for idle
    seconds of event time goes as a whole (t null). A slide takes what came before it in event time; rows of a tile are
    settled when the watermark has passed them.
    """
    at = [F.floor(F.col(c) / size).cast("long") for c in "xyz"]
    rows = merged.withWatermark("ts", delay).select(key, "ts", "t", "kind", *[v.alias(f"k{c}") for v, c in zip(at, "xyz", strict=True)])
    spans = [F.sequence(F.floor((F.col(f"k{c}") - half - stride) / tile), F.floor((F.col(f"k{c}") + half + stride) / tile)) for c in "xyz"]
    own = F.struct(*[F.floor(F.col(f"k{c}") / tile).alias(f"t{c}") for c in "xyz"])
    grid = F.flatten(F.flatten(F.transform(spans[0], lambda a: F.transform(spans[1], lambda b: F.transform(spans[2], lambda c: F.struct(a.alias("tx"), b.alias("ty"), c.alias("tz")))))))
    inside = lambda s: (s["tx"] * tile >= F.col("kx") - half) & (s["tx"] * tile + tile - 1 <= F.col("kx") + half) & (s["ty"] * tile >= F.col("ky") - half) & (s["ty"] * tile + tile - 1 <= F.col("ky") + half) & (s["tz"] * tile >= F.col("kz") - half) & (s["tz"] * tile + tile - 1 <= F.col("kz") + half)
    rows = rows.withColumn("_t", F.explode(F.when(F.col("kind") == "slide", F.filter(grid, lambda s: ~inside(s))).otherwise(F.array(own)))).select(key, "_t.*", "ts", "t", "kind", "kx", "ky", "kz")

    def step(k, rows, state: GroupState):
        (cells, counts, waiting, heard), new, now = _read(rows, state, ([], [], [], -1e300))
        pending = np.array(waiting, float).reshape(-1, 5)
        if new is not None:
            more = np.column_stack([new["t"], new["kind"] == "slide", new[["kx", "ky", "kz"]]]).astype(float)
            pending = np.concatenate([pending, more])
            heard = max([heard, *more[:, 0]])
        pending = pending[np.lexsort((pending[:, 1], pending[:, 0]))]
        settled = int(np.searchsorted(pending[:, 0], now, "left"))
        held, out = {tuple(c): n for c, n in zip(np.array(cells, np.int64).reshape(-1, 3).tolist(), counts, strict=True)}, []
        for t, slide, *cell in pending[:settled].tolist():
            if slide:
                gone = [c for c in held if max(abs(a - b) for a, b in zip(c, cell, strict=True)) > half]
                out += [(k[0], t, *c, held.pop(c)) for c in gone]
            else:
                cell = tuple(map(int, cell))
                held[cell] = held.get(cell, 0) + 1
        rest = pending[settled:]
        if len(held) and now > heard + idle:
            out += [(k[0], None, *c, n) for c, n in held.items()]
            held = {}
        if held or len(rest):  # slides too: points from before them may still come
            state.update(([int(v) for c in held for v in c], [int(n) for n in held.values()], rest.ravel().tolist(), float(heard)))
            _wake(state, rest[0, 0] if len(rest) else heard + idle)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[key, "t", "kx", "ky", "kz", "n"]).astype({"t": "float64"})

    return _timed(rows, [key, "tx", "ty", "tz"], step, f"{key} long, t double, kx long, ky long, kz long, n long", "cells array<long>, counts array<long>, waiting array<double>, heard double")
