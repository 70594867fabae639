"""Neighbour joins against all pairs, on crowded, sparse and odd clouds."""

import numpy as np
import pytest

from scanloom.operators import neighbours, spatial


def _cloud(seed, n=400):
    """A crowd in a millimetre, a surface, a line, single far points, and points that share a place."""
    r = np.random.default_rng(seed)
    parts = [r.normal(0, 1e-4, (n, 3)) + 3, np.c_[r.uniform(-20, 20, (n // 2, 2)), np.zeros(n // 2)], np.c_[r.uniform(0, 900, n // 8), np.ones(n // 8), np.ones(n // 8)], r.uniform(-1e5, 1e5, (9, 3)), [[7.0, 7.0, 7.0]] * 90, [[1e7, 0.0, 0.0]]]
    return np.concatenate(parts)


def _frame(spark, xyz, first=0, extra=()):
    rows = [(first + k, *map(float, p), f"n{k % 5}") for k, p in enumerate(xyz)] + list(extra)
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double, name string").repartition(3)


def _distances(a, b):
    g = a[:, None, :] - b[None, :, :]
    g = g * g
    return np.sqrt(g[:, :, 0] + g[:, :, 1] + g[:, :, 2])


@pytest.mark.parametrize("k,radius", [(1, 0.01), (5, 2.0), (12, 500.0)])
def test_knn_equals_all_pairs(spark, k, radius):
    xyz = _cloud(1)
    got = spatial.knn_join(_frame(spark, xyz, extra=[(9000, None, 1.0, 1.0, "a"), (9001, float("nan"), 1.0, 1.0, "a")]), k, radius).collect()
    d = _distances(xyz, xyz)
    want = set()
    for i in range(len(xyz)):
        order = [j for j in np.lexsort((np.arange(len(xyz)), d[i])) if j != i][:k]
        want |= {(i, int(j), float(d[i, j]), r + 1) for r, j in enumerate(order)}
    assert {tuple(g) for g in got} == want and len(got) == len(want)


def test_knn_of_few_rows(spark):
    few = _frame(spark, [[0.0, 0, 0], [500.0, 0, 0], [-500.0, 3, 3]])
    assert sorted((g["point_id"], g["point_id_b"]) for g in spatial.knn_join(few, 9, 0.5).collect()) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    assert spatial.knn_join(few.limit(1), 3, 1.0).count() == 0 and spatial.knn_join(few.limit(0), 3, 1.0).count() == 0


@pytest.mark.parametrize("gate", [1e-5, 0.5, 40.0, 3e7])
def test_nearest_within_gate(spark, gate):
    a, b = _cloud(2, 200), _cloud(3, 300)
    got = {g["point_id"]: g for g in spatial.nn_join(_frame(spark, a), _frame(spark, b, 100), gate).collect()}
    d = _distances(a, b)
    best = d.argmin(1)
    assert set(got) == set(np.flatnonzero(d.min(1) <= gate).tolist())
    for i, g in got.items():
        assert (g["d"], g["point_id_b"], g["x_b"], g["name_b"], g["name"]) == (d[i, best[i]], 100 + best[i], b[best[i], 0], f"n{best[i] % 5}", f"n{i % 5}")


def test_nearest_by_key(spark):
    a = spark.createDataFrame([(1, "u", 0.0, 0.0, 0.0), (2, "v", 0.0, 0.0, 0.0), (3, "w", 0.0, 0.0, 0.0)], "point_id long, s string, x double, y double, z double")
    b = spark.createDataFrame([(7, "u", 1.0, 0.0, 0.0), (8, "v", 0.5, 0.0, 0.0), (9, "v", 0.5, 0.0, 0.0)], "point_id long, s string, x double, y double, z double")
    got = spatial.nn_join(a, b, 2.0, keys=("s",)).collect()
    assert sorted((g["point_id"], g["s"], g["point_id_b"], g["d"]) for g in got) == [(1, "u", 7, 1.0), (2, "v", 8, 0.5)]


def test_crowded_cell_forms_no_pairs(spark, monkeypatch):
    """8,000 points within one gate: the distances that are computed are a small part of the 64 million pairs."""
    xyz = np.random.default_rng(4).uniform(0, 0.9, (8000, 3))
    counted = spark.sparkContext.accumulator(0)
    plain = neighbours._Best.look

    def counting(self, other, *rest):
        counted.add(len(self.places) * len(other))
        plain(self, other, *rest)

    class Counting(neighbours._Best):
        look = counting

    monkeypatch.setattr(neighbours, "_Best", Counting)
    got = spatial.nn_join(_frame(spark, xyz), _frame(spark, xyz + 1e-3, 50000), 1.0).collect()
    assert len(got) == 8000 and counted.value < 300 * 8000
    some = {g["point_id"]: g["point_id_b"] - 50000 for g in got if g["point_id"] % 20 == 0}
    assert some == dict(zip(range(0, 8000, 20), _distances(xyz[::20], xyz + 1e-3).argmin(1).tolist(), strict=True))


@pytest.mark.parametrize("crowd", [512, 7])
def test_radius_join_with_dealt_cells(spark, crowd):
    xyz = np.concatenate([np.random.default_rng(5).uniform(0, 3, (150, 3)), np.random.default_rng(6).uniform(0.1, 0.3, (60, 3)), [[0.2, 0.2, 0.2]] * 5])
    rows = _frame(spark, xyz)
    got = sorted((g["point_id"], g["point_id_b"], g["name_b"]) for g in spatial.radius_join(rows, rows, 0.7, crowd=crowd).collect())
    d = _distances(xyz, xyz)
    assert got == sorted((int(i), int(j), f"n{j % 5}") for i, j in zip(*np.nonzero(d * d <= 0.7 * 0.7), strict=True))
