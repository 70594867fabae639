"""Consensus poses, patches and synthesised poses against plain numpy."""

import numpy as np

from scanloom.operators import registration as reg, spatial


def test_consensus_of_poses(spark):
    r = np.random.default_rng(6)
    rows = []
    for s in ("a", "b"):
        n, wild = 60, 9 if s == "a" else 25
        p, q = r.normal(0, 0.02, (n, 3)) + [1, 2, 3], np.c_[r.normal(0, 0.004, (n, 3)) + [0.1, 0.2, -0.1], np.full(n, 0.96)]
        p[:wild] += r.uniform(3, 9, (wild, 3))
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        rows += [(s, *map(float, x)) for x in np.c_[p, q * r.choice([-1, 1], (n, 1))]]
    names = ("px", "py", "pz", "qx", "qy", "qz", "qw")
    got = {g["session"]: g for g in reg.pose_consensus(spark.createDataFrame(rows, "session string, " + ", ".join(f"{c} double" for c in names)).repartition(3), ("session",)).collect()}
    for s in ("a", "b"):
        x = np.array([v[1:] for v in rows if v[0] == s])
        mean = np.linalg.eigh(x[:, 3:].T @ x[:, 3:])[1][:, -1]
        off = np.linalg.norm(x[:, :3] - np.median(x[:, :3], 0), axis=1), np.degrees(2 * np.arccos(np.minimum(1, np.abs(x[:, 3:] @ mean))))
        gates = [np.clip(np.median(o) + 3 * 1.4826 * np.median(np.abs(o - np.median(o))), *b) for o, b in zip(off, ((0.05, 1.0), (0.5, 10.0)), strict=True)]
        inside = int(((off[0] <= gates[0]) & (off[1] <= gates[1])).sum())
        assert got[s]["n"] == 60 and got[s]["inliers"] == inside and got[s]["accepted"] == (inside >= 42)
        assert np.isclose(got[s]["gate_m"], gates[0]) and np.isclose(got[s]["gate_deg"], gates[1], rtol=1e-5) and np.isclose(got[s]["p90_m"], np.percentile(off[0], 90))
    assert got["a"]["accepted"] and not got["b"]["accepted"]


def test_patches_are_flat_apart_and_scored_on_held_out_points(spark):
    r = np.random.default_rng(8)
    flat = np.c_[r.uniform(0, 6, (900, 2)), r.normal(0, 0.004, 900)]
    rough = r.uniform(0, 3, (500, 3)) + [10, 0, 0]
    xyz = np.concatenate([flat, rough])
    frame = lambda keep: spark.createDataFrame([(int(k), *map(float, xyz[k])) for k in keep], "point_id long, x double, y double, z double").repartition(3)
    centres = spatial.select_patches(frame(range(len(xyz))), 0.8, least=20)
    picked = sorted(c["point_id"] for c in centres.collect())
    assert len(picked) >= 3 and max(picked) < 900
    gap = np.linalg.norm(xyz[picked][:, None] - xyz[picked][None], axis=2)
    assert gap[~np.eye(len(picked), dtype=bool)].min() >= 1.6
    got = {g["patch"]: g for g in spatial.score_patches(frame(range(0, 1400, 2)), frame(range(1, 1400, 2)), centres, 0.8, 8).collect()}
    assert sorted(got) == picked
    for k in picked:
        near = [j for j in range(1400) if np.linalg.norm(xyz[j] - xyz[k]) <= 0.8]
        train, test = xyz[[j for j in near if j % 2 == 0]], xyz[[j for j in near if j % 2]]
        normal = np.linalg.eigh(np.cov(train.T))[1][:, 0]
        off = np.abs((test - train.mean(0)) @ normal) * 1000
        assert (got[k]["n_train"], got[k]["n_test"]) == (len(train), len(test)) and np.isclose(got[k]["rmse_mm"], np.sqrt((off**2).mean())) and np.isclose(got[k]["p90_mm"], np.percentile(off, 90))


def test_poses_of_a_mounted_camera(spark):
    half = float(np.sqrt(0.5))
    path = [(1, float(t), 2.0 * t, -1.0 * t, 0.5, 0.0, 0.0, half, half) for t in range(5)]  # a quarter turn about z
    frames = [(1, 0.25, "a"), (1, 3.5, "b"), (1, 9.0, "late"), (1, None, "none")]
    names = ", ".join(f"{c} double" for c in ("t", "px", "py", "pz", "qx", "qy", "qz", "qw"))
    got = {g["name"]: g for g in reg.synthesize_poses(spark.createDataFrame(frames, "session long, t double, name string"), spark.createDataFrame(path, f"session long, {names}"), (0, 0, half, half), (0.1, 0.3, 0.2)).collect()}
    assert sorted(got) == ["a", "b"]
    for name, t in (("a", 0.25), ("b", 3.5)):
        g = got[name]
        assert np.allclose((g["cx"], g["cy"], g["cz"]), (2 * t - 0.3, -t + 0.1, 0.7)) and np.allclose(np.abs((g["x"], g["y"], g["z"], g["w"])), (0, 0, 1, 0), atol=1e-9)


def test_paired_patches_by_orientation(spark):
    kind = "patch long, rmse_mm double, p90_mm double, nx double, ny double, nz double"
    up, side, lean = (0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (0.0, 0.8, 0.6)
    before = [(k, 10.0 + k, 15.0 + k, *n) for k, n in enumerate([up] * 4 + [side] * 3 + [lean] * 2)]
    after = [(k, (10.0 + k) * (0.5 if k != 1 else 1.5), (15.0 + k) * 0.5, *(up if k == 8 else tuple(-c for c in n) if k == 0 else n)) for k, (_, _, _, *n) in enumerate(before) if k != 5]
    got = {g["orientation"]: g for g in spatial.summarize_pairs(spark.createDataFrame(before, kind), spark.createDataFrame(after, kind)).collect()}
    a, b = ({x[0]: x for x in rows} for rows in (before, after))
    for name, keys in (("horizontal", range(4)), ("vertical", range(4, 7)), ("oblique", range(7, 9)), (None, range(9))):
        met = [k for k in keys if k in b]
        ra, rb = (np.sqrt(np.mean([x[k][1] ** 2 for k in met])) for x in (a, b))
        same = np.mean([abs(np.dot(a[k][3:], b[k][3:])) >= np.cos(np.radians(15)) for k in met])
        wins = np.mean([b[k][1] < a[k][1] for k in met])
        g = got[name]
        assert g["patches"] == len(keys) and np.isclose(g["coverage"], len(met) / len(keys)) and np.isclose(g["rmse_before"], ra) and np.isclose(g["rmse_after"], rb)
        assert np.isclose(g["p90_before"], np.percentile([a[k][2] for k in met], 90)) and np.isclose(g["wins"], wins) and np.isclose(g["consistent"], same)
        assert g["improved"] == bool(len(met) / len(keys) >= 0.9 and rb < ra and wins > 0.5 and same >= 0.9)
    assert got["horizontal"]["improved"] and not got["vertical"]["improved"] and not got["oblique"]["improved"]
