"""Streams settled by the watermark, dealt to batches out of order, against walks in order."""

import datetime as dt

import numpy as np

from scanloom.streaming import stateful
from tests.test_stateful import T0, _run, feed  # noqa: F401

SECONDS = T0.replace(tzinfo=dt.timezone.utc).timestamp()


def _dealt(r, rows, jitter):
    """rows of (session, t, ...) with ts, in batches by times that are off by up to jitter."""
    order = np.argsort([x[1] + r.uniform(0, jitter) for x in rows], kind="stable")
    rows = [(rows[k][0], T0 + dt.timedelta(seconds=rows[k][1]), SECONDS + rows[k][1], *rows[k][2:]) for k in order]
    return [rows[k : k + len(rows) // 6 + 1] for k in range(0, len(rows), len(rows) // 6 + 1)]


def _end(rows, kind, *more):
    """A row of another session that moves the watermark past all others."""
    return [*rows, (99, 500.0, kind, *more)]


def test_scans_wait_for_the_samples_that_pass_them(spark, feed):  # noqa: F811
    r = np.random.default_rng(1)
    rows = [(s, 0.1 * k + 0.003 * s, "imu", -1) for s in (1, 2) for k in range(300) if not (s == 2 and k > 200)]
    rows += [(s, 1.0 * k + 0.55, "scan", k) for s in (1, 2) for k in range(28)]
    schema = "session long, ts timestamp, t double, kind string, id long"
    got = _run(spark, stateful.hold_scans(feed("in", schema, *_dealt(r, rows, 1.5), *_dealt(r, _end([], "imu", -1), 0)), delay="3 seconds"), "hold")
    want = []
    for s in (1, 2):
        imu, since = sorted(t for x, t, kind, _ in rows if x == s and kind == "imu"), -1.0
        for end, k in sorted((t, i) for x, t, kind, i in rows if x == s and kind == "scan"):
            want.append((s, k, round(end, 6), [round(t, 6) for t in imu if since < t <= end], imu[-1] >= end))
            since = end
    assert sorted((s, k, round(t - SECONDS, 5), [round(x - SECONDS, 5) for x in imu], ok) for s, k, t, imu, ok in got) == sorted((s, k, round(t, 5), [round(x, 5) for x in imu], ok) for s, k, t, imu, ok in want)
    assert {x[4] for x in want} == {True, False}


def test_scans_are_cut_at_images(spark, feed):  # noqa: F811
    r = np.random.default_rng(2)
    rows = [(1, 0.05 * k, "point", k) for k in range(500)] + [(1, 0.02 * k + 0.001, "imu", -1) for k in range(1200)]
    rows += [(1, 0.73 * k + 0.2, "image", k) for k in range(33)] + [(1, 0.73 * 4 + 0.2, "image", 1000)]
    schema = "session long, ts timestamp, t double, kind string, id long"
    got = _run(spark, stateful.cut_at_images(feed("in", schema, *_dealt(r, rows, 1.5), *_dealt(r, _end([], "imu", -1), 0)), delay="3 seconds"), "cut")
    want, last = {}, -1.0
    for at, k in sorted((t, i) for _, t, kind, i in rows if kind == "image"):
        if at < last + 1e-5 or at > 0.05 * 499 or at > 0.02 * 1199 + 0.001:
            want[k] = ([], 0, False)
            continue
        want[k] = ([i for _, t, kind, i in rows if kind == "point" and last <= t < at], sum(kind == "imu" and last < t <= at for _, t, kind, _ in rows), True)
        last = at
    assert {k: (points, len(imu), kept) for _, k, _, points, imu, kept in got} == want
    assert not want[1000][2] and sum(x[2] for x in want.values()) > 30


def test_voxels_leave_as_the_map_slides(spark, feed):  # noqa: F811
    r = np.random.default_rng(3)
    path = [(1, 1.0 * k, "slide", 4.0 * k, 0.0, 0.0) for k in range(12)]
    rows = path + [(1, float(t), "point", float(4 * t + x), float(y), float(z)) for t, x, y, z in zip(r.uniform(0, 11, 400), *r.uniform(-9, 9, (3, 400)), strict=True)]
    schema = "session long, ts timestamp, t double, kind string, x double, y double, z double"
    stream = feed("in", schema, *_dealt(r, rows, 1.5), *_dealt(r, _end([], "point", 0.0, 0.0, 0.0), 0))
    got = _run(spark, stateful.slide_map(stream, 1.0, 4, 10, 6, 300.0, "3 seconds"), "slide")
    held, want = {}, []
    for _, t, kind, *p in sorted(rows, key=lambda x: (x[1], x[2] == "slide")):
        cell = tuple(int(np.floor(c)) for c in p)
        if kind == "point":
            held[cell] = held.get(cell, 0) + 1
            continue
        for c in [c for c in held if max(abs(a - b) for a, b in zip(c, cell, strict=True)) > 10]:
            want.append((1, t, *c, held.pop(c)))
    want += [(1, None, *c, n) for c, n in held.items()]  # idle when the watermark has moved on
    text = lambda rows: sorted(map(str, rows))
    assert text((s, t if t is None or np.isnan(t) else round(t - SECONDS, 3), *c) for s, t, *c in got if t is not None and not np.isnan(t)) == text(x for x in want if x[1] is not None)
    assert sorted(x[2:] for x in got if x[1] is None or np.isnan(x[1])) == sorted(x[2:] for x in want if x[1] is None)
    assert len(want) > 100
