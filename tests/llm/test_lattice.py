"""Near-duplicate vectors against all pairs, lattice points against their definition, recall at the threshold."""

import itertools
import math

import numpy as np
import pytest

from scanloom.llm import lattice


def _plain(rows, least=0.93):
    """n_links and component of each row from the cosines of all pairs."""
    good = []
    for _, e, label in rows:
        ok = e is not None and label is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e) and any(e)
        good.append(np.array(e, np.float32).astype(float) if ok else None)
    near = {i: set() for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = good[i], good[j]
        if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
            near[i].add(j)
            near[j].add(i)
    out = []
    for i in near:
        seen, edge = {i}, [i]
        while edge:
            edge = [k for j in edge for k in near[j] if k not in seen and not seen.add(k)]
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids, default=None)))
    return sorted(out, key=str)


def _planted(seed, spread, count=700, groups=30, dim=24):
    """Groups of near vectors of several spreads, large and small, among vectors of their own, with copies."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    rows = []
    for k in range(count):
        g = 0 if k % 3 == 0 else int(r.integers(groups))
        v = centres[g] + spread * r.normal(size=dim) * np.linalg.norm(centres[g]) / np.sqrt(dim) if k % 2 or g == 0 else r.normal(size=dim)
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(g % 3)))
    return rows


@pytest.mark.parametrize("seed,spread", [(1, 0.02), (2, 0.12), (3, 0.2)])
def test_links_equal_all_pairs(spark, seed, spread):
    rows = _planted(seed, spread)
    rows += [(900 + k, rows[3 * k][1], rows[3 * k][2]) for k in range(40)] + [(1, rows[9][1], rows[9][2]), (5, rows[5][1], rows[5][2]), (970, rows[2][1], None), (971, rows[0][1], 2)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<float>, label int, n_links int, name int").repartition(3)
    got = sorted(((g["vec_id"], g["n_links"], g["component_id"]) for g in lattice.near_vectors(docs, tables=16).collect()), key=str)
    assert got == _plain(rows)


def test_odd_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 3.0], 1), (5, [1.0, float("nan"), 3.0], 1), (6, [float("inf"), 0.0, 0.0], 1), (7, one, None), (8, one, 1),
        (9, [2.0, 4.0, 6.0], 1), (10, [1e-30, 2e-30, 3e-30], 1), (11, [1e30, 2e30, 3e30], 1), (12, [1.0, 2.0], 1), (13, [-1.0, -2.0, -3.0], 1), (14, one, 2), (None, one, 1), (8, one, 1), (8, [-1.0, -2.0, -3.1], 1), (15, [-0.0, 1.0, 0.0], 3), (16, [0.0, 1.0, 0.0], 3),
    ]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = lattice.near_vectors(docs).collect()
    have = sorted(((g["vec_id"], g["n_links"], g["component_id"]) for g in got), key=str)
    assert have == _plain(rows)
    assert all(g["kept"] == (g["vec_id"] is None or g["vec_id"] == g["component_id"]) or g["vec_id"] is None for g in got)
    assert lattice.near_vectors(docs.limit(0)).count() == 0
    wide = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, label string")
    assert [g["n_links"] for g in lattice.near_vectors(wide).collect()] == [0, 0, 0]


def test_nearest_lattice_points():
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 8)) * 3
    near = lattice.nearest_e8(x)
    assert len(np.unique(lattice.NEIGHBOURS, axis=0)) == 240 and ((lattice.NEIGHBOURS**2).sum(1) == 2).all()
    assert (near.sum(1) % 2 == 0).all() and (np.ptp((2 * near) % 2, axis=1) == 0).all()
    gap = ((x - near) ** 2).sum(1)
    assert gap.max() <= 1 + 1e-9  # the covering radius
    others = ((x[:, None, :] - near[:, None, :] - lattice.NEIGHBOURS[None]) ** 2).sum(2)
    assert (others >= gap[:, None] - 1e-9).all()


@pytest.mark.parametrize("cosine,recall", [(0.93, 0.995), (0.95, 0.999)])
def test_recall_of_the_tables(cosine, recall):
    r = np.random.default_rng(8)
    a = r.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = cosine * a + math.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    salt, met = np.ones(4000, np.uint64), np.zeros(4000, bool)
    for table in range(lattice.TABLES):
        x, y = (lattice.cells(v, salt, table, lattice.WIDTH, lattice.POINTS, lattice.PROBES) for v in (a, b))
        met |= (x == y[:, :1]).any(1) | (y == x[:, :1]).any(1)
    assert met.mean() >= recall
