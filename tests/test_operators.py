"""Known transforms, gates that must reject, and formats read back."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.functions import geometry as geo
from scanloom.operators import clouds, registration, spatial, tracks
from scanloom.sources import pointfiles


def test_chunks():
    assert tracks.chunk_list(100, 30, 10) == [(0, 30), (20, 50), (40, 70), (60, 90), (80, 100)]
    assert tracks.chunk_list(50, 100, 20) == [(0, 50)]
    with pytest.raises(ValueError):
        tracks.chunk_list(50, 10, 10)


def test_similarity_is_recovered(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(size=(100, 3))
    a = 0.4
    r = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    t = 2 * s @ r.T + [1, 2, 3]
    rows = [(0, *map(float, x), *map(float, y)) for x, y in zip(s, t, strict=True)]
    fit = registration.umeyama(spark.createDataFrame(rows, "label long, sx double, sy double, sz double, tx double, ty double, tz double")).first()
    assert fit["s"] == pytest.approx(2, abs=1e-9) and fit["rmse"] < 1e-9
    assert np.allclose(np.array(fit["r"]).reshape(3, 3), r) and np.allclose(fit["t"], [1, 2, 3])


def test_icp_recovers_a_small_motion(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(0, 10, size=(400, 3))
    rows = lambda x: spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "point_id long, x double, y double, z double")
    rotation, shift, errors = registration.icp(rows(p + [0.2, -0.1, 0.05]), rows(p), gates=(1.0, 0.5, 0.3), trim=0.9)
    assert errors[-1] < 0.02 and np.allclose(p + [0.2, -0.1, 0.05] @ rotation.T + shift - (p @ np.eye(3)), 0, atol=0.2)


def test_weak_lag_is_rejected(spark):
    rng = np.random.default_rng(6)
    rows = lambda n: spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(rng.normal(size=n))], "session long, k long, value double")
    out = registration.lag_correlation(rows(200), rows(200), range(-20, 21)).first()
    assert not out["accepted"] and out["reason"] == "weak_correlation"


def test_plane_of_a_flat_patch(spark):
    rows = [(0, float(i), float(j), 5.0) for i in range(5) for j in range(5)]
    fit = spatial.plane_fit(spark.createDataFrame(rows, "patch long, x double, y double, z double"), ("patch",)).first()
    assert fit["n"] == 25 and fit["l0"] == pytest.approx(0, abs=1e-12) and abs(fit["nz"]) == pytest.approx(1)


@pytest.mark.parametrize(("lat", "lon", "epsg"), [(-3.7, -38.6, 31984), (48.8, 2.3, 32631)])
def test_map_coordinates_go_back(spark, lat, lon, epsg):
    zone, south = int((lon + 180) / 6) + 1, lat < 0
    df = spark.createDataFrame([(lat, lon)], "lat double, lon double")
    e, n = geo.to_utm("lat", "lon", zone, south)
    df = df.withColumns({"e": e, "n": n, "epsg": geo.utm_epsg("lat", "lon")})
    a, b = geo.from_utm("e", "n", zone, south)
    row = df.withColumns({"a": a, "b": b}).first()
    assert row["epsg"] == epsg and row["a"] == pytest.approx(lat, abs=1e-9) and row["b"] == pytest.approx(lon, abs=1e-9)


def test_even_sample_is_exact(spark):
    points = spark.range(1000).select((F.col("id") * 7).alias("point_id"))
    got = sorted(r[0] // 7 for r in clouds.sample_even(points, 2.5).collect())
    assert got == [int(k * 999 / 24) for k in range(25)]
    with pytest.raises(ValueError):
        clouds.sample_even(points, 0)


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitions(spark, parts):
    points = spark.range(500).select(F.col("id").alias("point_id"), (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 13).cast("double").alias("y"), (F.col("id") % 5).cast("double").alias("z")).repartition(parts)
    assert sorted(map(tuple, clouds.voxel_centroids(points, 4.0).select("kx", "ky", "kz", "n").collect())) == sorted(map(tuple, clouds.voxel_centroids(points.coalesce(1), 4.0).select("kx", "ky", "kz", "n").collect()))


def test_binary_and_text_files(spark, tmp_path):
    head = "VERSION .7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH 3\nHEIGHT 1\nPOINTS 3\nDATA {}\n"
    body = b"".join(struct.pack("<fffI", k, k + 0.5, -k, 0x804020) for k in range(2)) + struct.pack("<fffI", float("nan"), 0, 0, 0)
    (tmp_path / "a.pcd").write_bytes(head.format("binary").encode() + body)
    (tmp_path / "b.ply").write_bytes(b"ply\nformat binary_big_endian 1.0\nelement vertex 2\nproperty double x\nproperty float y\nproperty short z\nend_header\n" + struct.pack(">dfhdfh", 1, 2, 3, 4, 5, 6))
    (tmp_path / "c.pcd").write_bytes(head.replace("POINTS 3", "POINTS 1").format("ascii").encode() + b"7 8 9 0\n")
    rows = pointfiles.read_points(spark, str(tmp_path)).orderBy("path", "point_id").collect()
    assert [(r["x"], r["y"], r["z"]) for r in rows] == [(0, 0.5, 0), (1, 1.5, -1), (1, 2, 3), (4, 5, 6), (7, 8, 9)]
    assert rows[0]["r"] == pytest.approx(128 / 255)
    assert sorted(r["n"] for r in pointfiles.cloud_counts(spark, str(tmp_path)).collect()) == [1, 2, 3]


def test_broken_files_are_rejected():
    with pytest.raises(ValueError):
        pointfiles.pcd_header(b"FIELDS x\nSIZE 4\nTYPE F\nCOUNT 1\nPOINTS 1\nDATA binary_compressed\n")
    with pytest.raises(ValueError):
        pointfiles.ply_header(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int x\nend_header\n")


def test_livox_messages(spark):
    raw = b"".join(struct.pack("<IfffBBB", k * 10000, k / 10, 0, 0, 5, 16, 0) for k in range(100))
    rows = pointfiles.unpack_livox(spark.createDataFrame([(1, bytearray(raw))], "session long, raw binary")).orderBy("idx").collect()
    assert len(rows) == 100 and rows[-1]["x"] == pytest.approx(9.9) and rows[-1]["rel_ms"] == pytest.approx(0.99)
