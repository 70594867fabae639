"""Queries over every point, against brute force."""

import numpy as np
import pytest

from scanloom.plans import catalog
from scanloom.sources import adapters


def _rows(spark, sf, name):
    return catalog.queries()[name](spark, sf).collect()


@pytest.fixture(scope="module")
def cloud(spark, sf):
    def of(name):
        rows = sorted(adapters.table(spark, sf, name).select("point_id", "x", "y", "z").collect())
        return np.array([r[0] for r in rows]), np.array([r[1:] for r in rows], float)

    return {name: of(name) for name in ("points", "points_b")}


def _distances(a, b):
    for low in range(0, len(a), 400):
        d = a[low : low + 400, None] - b
        yield low, np.sqrt((d * d).sum(2))


def test_radius_pairs_of_all_points(spark, sf, cloud):
    ids, xyz = cloud["points"]
    want = {}
    for low, d in _distances(xyz, xyz):
        for k, row in enumerate(d):
            near = row <= 1.5
            want[ids[low + k]] = (near.sum(), ids[near].min(), row[near].sum())
    got = {r["point_id"]: r for r in _rows(spark, sf, "j5_radius_join")}
    assert got.keys() == want.keys() and len(got) == len(ids)
    assert all((got[k]["n"], got[k]["first"]) == (n, first) and got[k]["total"] == pytest.approx(total, abs=2e-5) for k, (n, first, total) in want.items())


def test_nearest_and_overlap_of_two_whole_clouds(spark, sf, cloud):
    (a, p), (b, q) = cloud["points"], cloud["points_b"]
    ahead = np.concatenate([d.min(1) for _, d in _distances(p, q)])
    back = np.concatenate([d.min(1) for _, d in _distances(q, p)])
    got = {r["point_id"]: r["d"] for r in _rows(spark, sf, "j6_nn_join")}
    assert got == {k: pytest.approx(d, abs=2e-6) for k, d in zip(a.tolist(), ahead.tolist(), strict=True) if d <= 2.0}
    for r in _rows(spark, sf, "a25_overlap_metrics"):
        d = ahead if r["direction"] == "forward" else back
        assert r["n"] == len(d) and r["overlap"] == pytest.approx((d <= 1).mean(), abs=2e-6)
        assert r["capped_rms"] == pytest.approx(np.sqrt((np.minimum(d, 1) ** 2).mean()), abs=2e-6)


def test_neighbours_and_normals_of_all_points(spark, sf, cloud):
    ids, xyz = cloud["points"]
    nearest = np.concatenate([np.sort(d, 1)[:, 1:6] for _, d in _distances(xyz, xyz)])
    got = {}
    for r in _rows(spark, sf, "j7_knn_join"):
        got.setdefault(r["point_id"], {})[r["rank"]] = r["d"]
    assert got == {k: {i + 1: pytest.approx(d, abs=2e-6) for i, d in enumerate(row) if d <= 16} for k, row in zip(ids.tolist(), nearest.tolist(), strict=True) if row[0] <= 16}
    rows = {r["point_id"]: r for r in _rows(spark, sf, "a7_normals")}
    assert rows.keys() == set(ids.tolist())
    for k in range(0, len(ids), 97):
        d = np.sqrt(((xyz - xyz[k]) ** 2).sum(1))
        near = np.lexsort((ids, d))
        near = near[(near != k) & (d[near] <= 24)][:10]
        around = xyz[[k, *near]]
        assert rows[ids[k]]["n"] == len(around)
        assert rows[ids[k]]["l0"] == pytest.approx(max(0, np.linalg.eigvalsh(np.cov(around.T, bias=True))[0]) if len(around) > 1 else 0, abs=2e-5)


def test_planes_of_all_points(spark, sf, cloud):
    ids, xyz = cloud["points"]
    cells = {}
    for k, cell in enumerate(map(tuple, np.floor(xyz / 5).astype(int))):
        cells.setdefault(cell, []).append(k)
    planes = {}
    for cell, own in cells.items():
        if len(own) >= 8:
            l, v = np.linalg.eigh(np.cov(xyz[own].T, bias=True))
            planes[cell] = (xyz[own].mean(0), v[:, 0], np.sqrt(l[2]), max(l[0], 0) + 1e-4)

    def best(x, at):
        out = []
        for cell in at:
            if cell in planes:
                c, n, radius, variance = planes[cell]
                d = n @ (x - c)
                if np.sqrt(max((x - c) @ (x - c) - d * d, 0)) <= 3 * radius and abs(d) < 3 * np.sqrt(variance):
                    out.append((np.exp(-d * d / (2 * variance)) / np.sqrt(variance), abs(d)))
        return max(out, default=None)

    want = {}
    for cell, own in cells.items():
        beside = [tuple(c + s * (k == axis) for k, c in enumerate(cell)) for axis in range(3) for s in (-1, 1)]
        for k in own:
            if found := best(xyz[k], [cell]) or best(xyz[k], beside):
                want[ids[k]] = found
    got = {r["point_id"]: (r["prob"], r["dist"]) for r in _rows(spark, sf, "j19_point_to_plane")}
    assert got.keys() == want.keys() and len(got) > len(ids) / 2
    assert all(got[k] == pytest.approx(v, abs=1e-5) for k, v in want.items())


def test_holes_of_all_cells(spark, sf, cloud):
    _, xyz = cloud["points"]
    top = {}
    for x, y, z in xyz:
        at = (int(np.floor(y)), int(np.floor(x)))
        top[at] = max(top.get(at, -np.inf), z)
    want = dict(top)
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if 1 <= i * i + j * j <= 4]
    for a, b in {(a + i, b + j) for a, b in top for i, j in steps} - top.keys():
        want[a, b] = top[min((i * i + j * j, a - i, b - j) for i, j in steps if (a - i, b - j) in top)[1:]]
    assert {(r["row"], r["col"]): r["z"] for r in _rows(spark, sf, "a16_fill_holes")} == want


def test_views_of_all_points(spark, sf, cloud):
    ids, xyz = cloud["points"]
    pairs, seen, score = {}, set(), {}
    for view in adapters.table(spark, sf, "views").collect():
        d = xyz - np.array([view["cx"], view["cy"] * 3, view["cz"]], float)
        c, s = np.cos(view["yaw"]), np.sin(view["yaw"])
        right, down, front = c * d[:, 0] + s * d[:, 1], -d[:, 2], -s * d[:, 0] + c * d[:, 1]
        depth = np.sqrt((d * d).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = (np.arctan2(right, front) / (2 * np.pi) + 0.5) * 2048, (np.arcsin(down / depth) / np.pi + 0.5) * 1024
        own = np.flatnonzero((depth <= 6) & (front > 0.05) & (u >= 0) & (u <= 2047) & (v >= 0) & (v <= 1023))
        near: dict = {}
        cell = {k: (int(u[k] * 32 // 2048), int(v[k] * 16 // 1024)) for k in own}
        for k in own:
            pairs[view["image_id"], ids[k]] = depth[k]
            score.setdefault(ids[k], []).append((-1 / max(depth[k], 0.5) ** 1.5, view["name"], view["image_id"]))
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    at = (cell[k][0] + i, cell[k][1] + j)
                    near[at] = min(near.get(at, 1 << 40), int(depth[k] * 1000))
        seen |= {(view["image_id"], ids[k]) for k in own if depth[k] <= (near[cell[k]] / 1000) + max(0.03, near[cell[k]] / 1e5)}
    got = {(r["image_id"], r["point_id"]): r["depth"] for r in _rows(spark, sf, "j8_project_views")}
    assert got.keys() == pairs.keys() and any(k % 3 for _, k in got) and all(got[k] == pytest.approx(v, abs=1e-4) for k, v in pairs.items())
    assert {(r["image_id"], r["point_id"]) for r in _rows(spark, sf, "a12_visible")} == seen
    assert {(r["point_id"], r["k"]): r["image_id"] for r in _rows(spark, sf, "o3_top3")} == {(p, k + 1): x[2] for p, found in score.items() for k, x in enumerate(sorted(found)[:3])}
    assert {r["point_id"] for r in _rows(spark, sf, "a13_consensus")} == set(score)
    row = _rows(spark, sf, "a14_coverage")[0]
    assert row["n"] == len(ids) and row["coverage"] == pytest.approx(100 * len(score) / len(ids), abs=2e-6)


def test_chroma_is_fitted_from_sums(spark, sf):
    from scanloom.operators import vision

    obs = adapters.table(spark, sf, "observations")
    rows = vision.loo_targets(obs).where("target_r is not null").select("frame_id", "weight", *"rgb", *[f"target_{c}" for c in "rgb"]).toPandas()
    fit = vision.fit_chroma(obs)
    assert "FlatMapGroupsInPandas" not in fit._jdf.queryExecution().executedPlan().toString()
    got = {r["frame_id"]: r for r in fit.collect()}
    assert got.keys() == set(rows["frame_id"])
    for frame, own in rows.groupby("frame_id"):
        c, t = own[list("rgb")].to_numpy(float), own[[f"target_{k}" for k in "rgb"]].to_numpy(float)
        (u, v), (p, q) = ((x / np.maximum(x.sum(1, keepdims=True), 1e-6)).T[:2] for x in (c, t))
        one, no = np.ones_like(u), np.zeros_like(u)
        a = np.concatenate([np.stack([u, v, one, no, no, no, -u * p, -v * p], 1), np.stack([no, no, no, u, v, one, -u * q, -v * q], 1)])
        y, h, w = np.concatenate([p, q]), np.eye(3).ravel()[:8], np.tile(own["weight"].to_numpy(float), 2)
        start = h
        for _ in range(3):
            k = (w * np.minimum(1, 0.02 / np.maximum(np.abs(a @ h - y), 1e-9)))[:, None]
            h = np.linalg.solve((a * k).T @ a + 0.1 * np.eye(8), ((a * k).T @ y) + 0.1 * start)
        assert got[frame]["n"] == len(own) and np.allclose(got[frame]["h"], h, atol=1e-6)


def test_capped_pairs_are_those_of_the_ordered_walk(spark):
    from scanloom.operators import spatial

    r = np.random.default_rng(8)
    rows = sorted({(int(s), int(min(a, b)), int(max(a, b))) for s, a, b in r.integers(0, (2, 25, 25), (300, 3)) if a != b})
    rows = [(*x, float(r.integers(1, 12)), float(r.integers(25, 40))) for x in rows]
    got = spatial.greedy_cap(spark.createDataFrame(rows, "session long, i long, j long, distance double, dt double"), 2)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    degree, want = {}, set()
    for s, i, j, d, dt in sorted(rows, key=lambda x: (x[3], -x[4], x[1], x[2])):
        if max(degree.get((s, i), 0), degree.get((s, j), 0)) < 2:
            want.add((s, i, j))
            for k in (i, j):
                degree[s, k] = degree.get((s, k), 0) + 1
    found = got.collect()
    assert len(found) == len(rows) and {(x["session"], x["i"], x["j"]) for x in found if x["accepted"]} == want
