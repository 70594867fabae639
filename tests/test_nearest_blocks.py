"""Nearest rows of clouds of many blocks: what is shuffled, and the result against all pairs."""

import numpy as np

from scanloom.operators import spatial


def test_places_are_shuffled_a_few_times_at_most(spark):
    """12,000 points, each at a place of its own: pairs of leaves with both their places were 90 MB."""
    r = np.random.default_rng(8)
    xyz = np.concatenate([r.uniform(0, 9, (8000, 3)), r.uniform(2, 3, (4000, 3))])
    rows = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "point_id long, x double, y double, z double")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = written()
    got = {}
    for g in spatial.knn_join(rows, 5, 1.0).collect():
        got.setdefault(g["point_id"], {})[g["rank"]] = (g["d"], g["point_id_b"])
    mb = (written() - before) / 1e6
    assert mb < 16
    for i in range(0, len(xyz), 37):
        gap = xyz - xyz[i]
        d = np.sqrt(gap[:, 0] ** 2 + gap[:, 1] ** 2 + gap[:, 2] ** 2)
        order = [int(j) for j in np.lexsort((np.arange(len(xyz)), d)) if j != i][:5]
        assert got[i] == {k + 1: (d[j], j) for k, j in enumerate(order)}
    assert len(got) == len(xyz)
