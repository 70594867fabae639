"""Pose graph steps: derivatives against differences, steps against dense systems, planted poses recovered."""

import numpy as np

from scanloom.operators import posegraph as pg
from scanloom.operators.registration import _turn


def _quaternion(v):
    angle = np.linalg.norm(v)
    return np.r_[np.asarray(v) * (np.sin(angle / 2) / angle if angle else 0.5), np.cos(angle / 2)]


def _between(a, b):
    ra, rb = (_turn(p[1]) for p in (a, b))
    return np.r_[ra.T @ (b[0] - a[0]), _quaternion(pg._vectors((ra.T @ rb)[None])[0])]


def _poses(r, n):
    return [(np.array([2.0 * k, np.sin(k), 0.1 * k]), r.normal(0, 0.4, 3)) for k in range(n)]


def test_derivatives_match_differences():
    r = np.random.default_rng(1)
    a, b, m = (np.concatenate([r.normal(size=(20, 3)), r.normal(size=(20, 4))], 1) for _ in range(3))
    m[:3, 3:] = np.stack([_quaternion(pg._vectors((pg._matrices(x[None, 3:])[0].T @ pg._matrices(y[None, 3:])[0])[None])[0]) for x, y in zip(a[:3], b[:3], strict=True)])  # no turn left
    sigmas = np.tile([0.1, 0.02], (20, 1))
    base, ja, jb = pg.edge_blocks(a, b, m, sigmas)
    for side, jac in ((0, ja), (1, jb)):
        for k in range(6):
            ends = []
            for h in (1e-6, -1e-6):
                both = [a.copy(), b.copy()]
                turned = pg._matrices(both[side][:, 3:])
                w, u = (np.eye(3)[k] * h, np.zeros(3)) if k < 3 else (np.zeros(3), np.eye(3)[k - 3] * h)
                both[side][:, :3] += turned @ u
                both[side][:, 3:] = np.stack([_quaternion(v) for v in pg._vectors(turned @ _turn(w))])
                ends.append(pg.edge_blocks(*both, m, sigmas)[0])
            assert np.allclose((ends[0] - ends[1]) / 2e-6, jac[:, :, k], atol=2e-4, rtol=2e-4)


_NAMES = "px double, py double, pz double, qx double, qy double, qz double, qw double"


def _tables(spark, poses, truth, loops, session="s"):
    nodes = [(session, k, *map(float, p), *map(float, _quaternion(v))) for k, (p, v) in enumerate(poses)]
    pairs = [(k, k + 1, "odometry") for k in range(len(poses) - 1)] + [(i, j, "loop") for i, j in loops]
    edges = [(session, i, j, kind, *map(float, _between(truth[i], truth[j]))) for i, j, kind in pairs]
    return nodes, edges


def _cloud(r, truth, poses):
    """Points of three walls, as they lie in the world when nodes are misplaced; a point belongs to two nodes in turn."""
    rows = []
    for patch, axis in enumerate(range(3)):
        for _ in range(60):
            p = r.uniform(-0.4, 0.4, 3) + patch
            p[axis] = patch
            lo = int(r.integers(0, len(truth) - 1))
            u = float(r.choice([0.0, 0.25, 1.0]))
            seen = np.zeros(3)
            for k, w in ((lo, 1 - u), (lo + 1, u)):
                local = _turn(truth[k][1]).T @ (p - truth[k][0])
                seen += w * (_turn(poses[k][1]) @ local + poses[k][0])
            rows.append(("s", patch, *map(float, seen), lo, lo + 1, u))
    return rows


def test_a_step_with_planes_equals_the_projected_dense_system(spark):
    r = np.random.default_rng(3)
    truth = _poses(r, 5)
    poses = [(p + r.normal(0, 0.01, 3) * (k > 0), v + r.normal(0, 0.005, 3) * (k > 0)) for k, (p, v) in enumerate(truth)]
    nodes, edges = _tables(spark, poses, truth, [(0, 4)])
    points = _cloud(r, truth, poses)
    sigmas = np.array([pg.SIGMAS[e[3]] for e in edges])
    at = np.array([n[2:] for n in nodes])
    res, ja, jb = pg.edge_blocks(at[[e[1] for e in edges]], at[[e[2] for e in edges]], np.array([e[4:] for e in edges]), sigmas)
    rows, left = [], []
    for k, e in enumerate(edges):
        block = np.zeros((6, 30))
        block[:, 6 * e[1] : 6 * e[1] + 6] += ja[k]
        block[:, 6 * e[2] : 6 * e[2] + 6] += jb[k]
        rows.append(block)
        left.append(res[k])
    for patch in range(3):
        own = [p for p in points if p[1] == patch]
        xyz = np.array([p[2:5] for p in own])
        c = xyz.mean(0)
        _, vectors = np.linalg.eigh(np.cov((xyz - c).T))
        n, side = vectors[:, 0], vectors[:, 1:]
        block = np.zeros((len(own), 30))
        for k, (_, _, *p, lo, hi, u) in enumerate(own):
            for node, w in ((lo, 1 - u), (hi, u)):
                turn = _turn(poses[node][1])
                block[k, 6 * node : 6 * node + 6] += w * np.r_[turn.T @ np.cross(np.array(p) - poses[node][0], n), turn.T @ n]
        basis, _ = np.linalg.qr(np.c_[np.ones(len(own)), (xyz - c) @ side])
        off = (xyz - c) @ n
        scale = 0.02 * np.sqrt(len(own))
        rows.append((block - basis @ (basis.T @ block)) / scale)
        left.append((off - basis @ (basis.T @ off)) / scale)
    jac, e = np.concatenate(rows)[:, 6:], np.concatenate(left)
    want = np.linalg.solve(jac.T @ jac, -jac.T @ e).reshape(4, 6)
    tables = spark.createDataFrame(nodes, f"session string, node long, {_NAMES}"), spark.createDataFrame(edges, f"session string, i long, j long, kind string, {_NAMES}"), spark.createDataFrame(points, "session string, patch long, x double, y double, z double, lo long, hi long, u double").repartition(3)
    got = {g["node"]: list(g)[2:] for g in pg.graph_step(*tables).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert np.allclose([got[k] for k in (1, 2, 3, 4)], want, atol=1e-6)


def test_planted_poses_are_recovered_and_far_ones_rejected(spark):
    r = np.random.default_rng(5)
    truth = _poses(r, 6)
    drift = [(p + 0.15 * k * np.array([0.3, 1.0, -0.5]), v + 0.01 * k) for k, (p, v) in enumerate(truth)]
    far = [(p + 9.0 * (k == 3), v) for k, (p, v) in enumerate(truth)]
    nodes, edges = _tables(spark, drift, truth, [(0, 5), (1, 4)], "near")
    more = _tables(spark, far, truth, [(0, 5)], "far")
    frame = spark.createDataFrame(nodes + more[0], f"session string, node long, {_NAMES}"), spark.createDataFrame(edges + more[1], f"session string, i long, j long, kind string, {_NAMES}")
    out, report = pg.refine_graph(*frame, rounds=6)
    rows = {(x["session"], x["node"]): list(x)[2:] for x in out.collect()}
    said = {x["session"]: x for x in report.collect()}
    assert said["near"]["accepted"] and said["near"]["cost_after"] < 1e-6 * said["near"]["cost_before"]
    for k, (p, v) in enumerate(truth):
        assert np.allclose(rows["near", k][:3], p, atol=1e-4) and np.allclose(pg._matrices(np.array([rows["near", k][3:]]))[0], _turn(v), atol=1e-4)
        assert np.allclose(rows["far", k][:3], far[k][0])
    assert not said["far"]["accepted"] and said["far"]["shift_m"] > 8
