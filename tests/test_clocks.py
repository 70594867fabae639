"""Clock offsets from coarse to fine: planted offsets are found to a tenth of the coarse step, equal peaks are rejected."""

import numpy as np

from scanloom.operators import registration


def _signal(seed):
    r = np.random.default_rng(seed)
    waves = [(r.uniform(0.05, 0.4), r.uniform(0, 6), r.uniform(0.5, 1)) for _ in range(9)]
    return lambda t: sum(a * np.sin(2 * np.pi * f * t + p) for f, p, a in waves)


def test_offset_of_a_shared_signal(spark):
    rows = {"a": [], "b": []}
    for s, offset, f in (("x", 3.37, _signal(1)), ("y", -6.21, _signal(2)), ("twice", 1.0, lambda t: np.sin(2 * np.pi * t / 5))):
        own = np.arange(0, 40, 0.07)
        rows["a"] += [(s, float(t), float(f(t))) for t in own]
        rows["b"] += [(s, float(t + offset), float(f(t))) for t in np.arange(4, 38, 0.06)]
    noise = np.random.default_rng(5)
    rows["a"] += [("noise", float(t), float(noise.normal())) for t in range(40)]
    rows["b"] += [("noise", float(t), float(noise.normal())) for t in range(40)] + [("short", 0.0, 1.0)]
    rows["a"] += [("short", 0.0, 1.0), ("short", 1.0, 2.0)]
    a, b = (spark.createDataFrame(rows[k], "session string, t double, w double").repartition(2) for k in "ab")
    got = {g["session"]: g for g in registration.sync_clocks(a, b, 15.0, (2, 20)).collect()}
    for s, offset in (("x", 3.37), ("y", -6.21)):
        assert got[s]["accepted"] and abs(got[s]["offset"] - offset) <= 0.05 and got[s]["score"] > 0.95
    assert got["twice"]["reason"] == "ambiguous_peak" and got["twice"]["offset"] is None
    assert not got["noise"]["accepted"]
    assert "short" not in got or not got["short"]["accepted"]


def test_offset_by_the_fit_to_a_trajectory(spark):
    r = np.random.default_rng(7)
    t = np.arange(0.0, 60.0, 0.5)
    paths = {"x": np.cumsum(r.normal(size=(len(t), 3)), 0), "line": np.c_[t, t * 0, t * 0] + 0.0}
    poses = [(s, float(a), *map(float, p), 0.0, 0.0, 0.0, 1.0) for s, path in paths.items() for a, p in zip(t, path, strict=True)]
    views = []
    for s, path in paths.items():
        for at in np.arange(10.0, 45.0, 0.8):
            centre = np.array([np.interp(at, t, path[:, c]) for c in range(3)])
            views.append((s, float(at - 2.3), *map(float, (centre - 4) / 2)))
    names = "px double, py double, pz double, qx double, qy double, qz double, qw double"
    got = {g["session"]: g for g in registration.refine_offset(spark.createDataFrame(views, "session string, t double, cx double, cy double, cz double"), spark.createDataFrame(poses, f"session string, t double, {names}"), -6.0, 6.0, 1.0).collect()}
    assert got["x"]["unique"] and abs(got["x"]["dt"] - 2.3) < 0.051 and abs(got["x"]["s"] - 2) < 0.05
    assert not got["line"]["unique"]  # along a line, every offset fits
