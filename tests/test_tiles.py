"""Sums over neighbours by tiles: against all pairs, on parts and chunks, and what is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import spatial


def _wanted(a, b, ids_a, ids_b, radius):
    out = {}
    for i, p in zip(ids_a.tolist(), a, strict=True):
        gap = p - b
        gap = gap * gap
        d2 = gap[:, 0] + gap[:, 1] + gap[:, 2]
        near = d2 <= radius * radius
        if near.any():
            out[i] = (int(near.sum()), int(ids_b[near].min()), float(np.sqrt(d2[near]).sum()))
    return out


def _same(got, want):
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-9 * max(1.0, want[k][2]) for k in want)


def test_dense_cloud_is_shuffled_a_few_times(spark):
    """8,000 points at places of their own, some thousand of them about each: places sent to all parts of 27 cells were 10.9 MB."""
    xyz = np.random.default_rng(11).uniform(0, 3, (8000, 3))
    rows = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "point_id long, x double, y double, z double")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = written()
    got = {g["point_id"]: (g["n"], g["first"], g["total"]) for g in spatial.radius_sums(rows, rows, 1.5).collect()}
    assert (written() - before) / 1e6 < 6
    ids = np.arange(len(xyz))
    some = ids[::50]
    _same({k: got[k] for k in some.tolist()}, _wanted(xyz[some], xyz, some, ids, 1.5))
    assert len(got) == len(xyz)


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(12)
    parts = [r.uniform(-8, 9, (800, 3)).round(1), r.normal(2, 0.2, (400, 3)), [[1e6, 0, 0], [1e6, 0, 1]], np.repeat(r.uniform(-2, 2, (4, 3)), 50, 0), r.uniform(-1e4, 1e4, (40, 3))]
    xyz = np.concatenate(parts)
    ids = np.arange(len(xyz)) * 7919 % 100003
    odd = [(200001, None, 1.0, 1.0), (200002, float("nan"), 1.0, 1.0), (200003, float("inf"), 1.0, 1.0)]
    rows = spark.createDataFrame([(k, *map(float, p)) for k, p in zip(ids.tolist(), xyz, strict=True)] + odd, "point_id long, x double, y double, z double").repartition(5)
    return xyz, ids, rows


@pytest.mark.parametrize("most,radius", [(None, 1.5), (40, 1.0), (7, 0.5)])
def test_sums_equal_all_pairs(cloud, most, radius):
    """Tiles of several levels; with few rows a tile, crowded cells are dealt into parts."""
    xyz, ids, rows = cloud
    got = {g["point_id"]: (g["n"], g["first"], g["total"]) for g in spatial.radius_sums(rows, rows, radius, most=most).collect()}
    _same(got, _wanted(xyz, xyz, ids, ids, radius))


def test_sums_over_another_table(cloud):
    xyz, ids, rows = cloud
    a = rows.where("point_id % 3 = 1").withColumn("name", F.lit("q"))
    b = rows.where("point_id % 3 = 0").withColumn("x", F.col("x") + 0.3)
    found = spatial.radius_sums(a, b, 0.7, most=40)
    assert found.columns == ["point_id", "x", "y", "z", "name", "n", "first", "total"]
    got = {g["point_id"]: (g["n"], g["first"], g["total"]) for g in found.collect()}
    _same(got, _wanted(xyz[ids % 3 == 1], xyz[ids % 3 == 0] + [0.3, 0, 0], ids[ids % 3 == 1], ids[ids % 3 == 0], 0.7))


def test_sums_by_chunks(cloud):
    """Neighbours that come in several chunks add up, and so do batches that end within a tile."""
    import pyarrow as pa

    from scanloom.operators import tiles

    xyz, ids, _ = cloud
    was, tiles.CHUNK = tiles.CHUNK, 100
    try:
        rows = pa.RecordBatch.from_arrays([*(pa.array(xyz[:, k].copy()) for k in range(3)), pa.array(ids), pa.array(np.zeros(len(ids), np.int64)), pa.array(np.where(np.arange(len(ids)) < 500, 0, 1).astype(np.int32))], ["x", "y", "z", "_key", "_tile", "_part"])
        schema = pa.schema([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("_key", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("total", pa.float64())])
        found = pa.Table.from_batches(list(tiles._summed(0.9, True, schema)(iter([rows.slice(k, 64) for k in range(0, len(ids), 64)])))).to_pylist()
    finally:
        tiles.CHUNK = was
    _same({g["_key"]: (g["n"], g["first"], g["total"]) for g in found}, _wanted(xyz[:500], xyz, ids[:500], ids, 0.9))
