"""Iterative fits with planted answers: sparse systems, graph steps, point-to-plane registration; and sinks at their limits."""

import glob

import numpy as np
import pytest

from pyspark.sql import functions as F

from scanloom.operators import registration, solve, spatial
from scanloom.sources import pointfiles


@pytest.mark.parametrize("held", [1_000_000, 0])
def test_conjugate_gradient_equals_a_dense_solve(spark, held):
    r = np.random.default_rng(0)
    m = np.zeros((6, 6))
    for _ in range(12):
        i, j, w = *r.choice(6, 2, False), r.uniform(0.2, 3)
        m[[i, j], [i, j]] += w
        m[[i, j], [j, i]] -= w
    m += np.diag(r.uniform(0.1, 1, 6))
    b = r.normal(size=6)
    b[3] = 0.0
    entries = spark.createDataFrame([(f"n{i}", f"n{j}", float(m[i, j])) for i in range(6) for j in range(6) if m[i, j]], "i string, j string, a double")
    right = spark.createDataFrame([(f"n{i}", float(b[i])) for i in range(6) if b[i]], "i string, b double")
    got = {g["i"]: g["x"] for g in solve.conjugate_gradient(entries, right, held=held).collect()}
    want = np.linalg.solve(m, b)
    assert all(abs(got[f"n{i}"] - want[i]) < 1e-6 for i in range(6))


def test_graph_step_equals_dense_least_squares(spark):
    r = np.random.default_rng(1)
    nodes, edges, rows = [], [], []
    for s, n in (("a", 7), ("b", 4)):
        place = r.normal(size=(n, 3))
        nodes += [(s, k + 10, *map(float, place[k])) for k in range(n)]
        for i, j, kind in [(k, k + 1, "odometry") for k in range(n - 1)] + [(0, n - 1, "loop"), (0, 2, "loop")]:
            v = place[j] - place[i] + r.normal(0, 0.3, 3)
            edges.append((s, i + 10, j + 10, kind, *map(float, v)))
            rows.append((s, i, j, 1 / 0.02**2 if kind == "loop" else 1 / 0.10**2, place[j] - place[i] - v))
    names = "px double, py double, pz double"
    got = registration.gauss_newton_step(spark.createDataFrame(nodes, f"session string, node long, {names}"), spark.createDataFrame(edges, f"session string, i long, j long, kind string, {names}")).collect()
    have = {(g["session"], g["node"]): (g["dx"], g["dy"], g["dz"]) for g in got}
    assert len(have) == 11
    for s, n in (("a", 7), ("b", 4)):
        own = [x for x in rows if x[0] == s]
        design, y = np.zeros((len(own), n)), np.zeros((len(own), 3))
        for k, (_, i, j, w, miss) in enumerate(own):
            design[k, i], design[k, j], y[k] = -np.sqrt(w), np.sqrt(w), -np.sqrt(w) * miss
        want = np.zeros((n, 3))
        want[1:] = np.linalg.solve(design[:, 1:].T @ design[:, 1:] + 1e-6 * np.eye(n - 1), design[:, 1:].T @ y)
        assert all(np.allclose(have[s, k + 10], want[k], atol=1e-5) for k in range(n))


def _frame(spark, xyz):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "point_id long, x double, y double, z double").repartition(3)


def test_a_known_motion_is_recovered(spark):
    r = np.random.default_rng(2)
    side = r.uniform(0, 4, (3, 260, 2))
    room = np.concatenate([np.c_[side[0], np.zeros(260)], np.c_[side[1][:, :1], np.zeros(260), side[1][:, 1:]], np.c_[np.zeros(260), side[2]]]) + r.normal(0, 0.002, (780, 3))
    turn, shift = registration._turn(np.array([0.01, -0.02, 0.015])), np.array([0.05, -0.04, 0.03])
    moved = (room[::2] - shift) @ turn  # turn @ moved + shift = room
    got = registration.plane_icp(_frame(spark, moved), _frame(spark, room), gates=(0.6,), rounds=4, k=12, radius=0.5)
    assert np.allclose(got["rotation"], turn, atol=2e-3) and np.allclose(got["shift"], shift, atol=6e-3)
    assert got["fitness"] > 0.95 and got["plane_rms"] < 0.01


def test_one_plane_is_rejected(spark):
    r = np.random.default_rng(3)
    floor = np.c_[r.uniform(0, 4, (300, 2)), r.normal(0, 0.002, 300)]
    with pytest.raises(ValueError, match="degenerate"):
        registration.scene_normals(_frame(spark, floor), 10, 0.5)
    with pytest.raises(ValueError, match="planar"):
        registration.scene_normals(_frame(spark, r.normal(size=(120, 3))), 10, 0.5)


def test_planes_must_hold_every_motion(spark):
    r = np.random.default_rng(4)
    rows = [(*map(float, p), *map(float, p + [0, 0, 0.1]), 0.0, 0.0, 1.0) for p in r.uniform(0, 4, (50, 3))]
    pairs = spark.createDataFrame(rows, "x double, y double, z double, tx double, ty double, tz double, nx double, ny double, nz double")
    with pytest.raises(ValueError, match="open"):
        registration.plane_step(pairs)


@pytest.mark.parametrize("kind", ["pcd", "ply", "las"])
def test_clouds_with_empty_ranges(spark, tmp_path, kind):
    rows = spark.createDataFrame([(7, float(k), 1.0, 2.0, 0.5, 0.5, 0.5) for k in range(10)], "point_id long, x double, y double, z double, r double, g double, b double")
    done = pointfiles.write_cloud(rows, str(tmp_path / "c"), kind, rows=3).collect()
    assert sum(d["n"] for d in done) == 10 and len(glob.glob(f"{tmp_path}/c/*.{kind}")) == len(done)


def test_seed_with_empty_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pointfiles, "PART_ROWS", 2)
    rows = spark.createDataFrame([(k, float(k), 1.0, 2.0, 0.5, 0.5, 0.5) for k in range(5)], "point_id long, x double, y double, z double, r double, g double, b double")
    assert sum(d["n"] for d in pointfiles.write_seed_bin(rows, str(tmp_path / "s")).collect()) == 5


def test_las_that_is_too_wide(spark, tmp_path):
    far = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.5, 0.5, 0.5), (1, 5e6, 7e6, 0.0, 0.5, 0.5, 0.5)], "point_id long, x double, y double, z double, r double, g double, b double")
    with pytest.raises(Exception, match="32 bits"):
        pointfiles.write_cloud(far, str(tmp_path / "one"), "las")
    done = pointfiles.write_cloud(far, str(tmp_path / "two"), "las", rows=1)
    assert done.count() == 2
    back = pointfiles.read_points(spark, f"{tmp_path}/two/*.las").orderBy("x").collect()
    assert [(round(b["x"], 3), round(b["y"], 3)) for b in back] == [(0.0, 0.0), (5e6, 7e6)]


def test_mergeable_moments_equal_numpy(spark):
    xyz = np.random.default_rng(6).normal(size=(90, 3))
    s = _frame(spark, xyz).agg(*spatial.cov_sums("x", "y", "z")).first()
    assert s["n"] == 90 and np.allclose([s["sx"], s["sy"], s["sz"]], xyz.sum(0))
    assert np.allclose([s["sxx"], s["sxy"], s["sxz"], s["syy"], s["syz"], s["szz"]], (xyz.T @ xyz)[np.triu_indices(3)])


def test_planes_at_map_coordinates(spark):
    r = np.random.default_rng(7)
    flat = np.c_[r.uniform(0, 3, (200, 2)), r.normal(0, 1e-3, 200)] + [4.5e5, 5.2e6, 300]
    fit = spatial.plane_fit(_frame(spark, flat).withColumn("k", F.lit(1)), ("k",)).first()
    assert fit["l0"] == pytest.approx(np.linalg.eigvalsh(np.cov(flat.T, bias=True))[0], rel=1e-3) and fit["nz"] > 0.999
