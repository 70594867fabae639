"""Message payloads, telemetry, models, images and sinks: round trips and hand-made files."""

import glob
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import rig
from scanloom.sources import capture, pointfiles as pf

FIELDS = "fields array<struct<name:string,offset:int,datatype:int,count:int>>, height int, width int, point_step int, row_step int, is_bigendian boolean, data binary"


@pytest.mark.parametrize("order", "<>")
def test_general_point_messages(spark, order):
    kind = np.dtype({"names": ["x", "y", "z", "intensity", "t"], "formats": [order + f for f in ("f4", "f4", "f8", "u2", "u4")], "offsets": [0, 4, 8, 18, 20], "itemsize": 28})
    rows = np.zeros(6, kind)
    for k, c in enumerate(kind.names):
        rows[c] = np.arange(6) * (k + 1) + 5
    data = b"".join(rows[k : k + 3].tobytes() + b"pad." for k in (0, 3))  # two rows of three points, padded
    fields = [(c, kind.fields[c][1], {"f4": 7, "f8": 8, "u2": 4, "u4": 6}[kind[c].str[1:]], 1) for c in kind.names] + [("cov", 0, 7, 9)]
    held = (7, fields, 2, 3, 28, 28 * 3 + 4, order == ">", data)
    out = capture.unpack_pointcloud2(spark.createDataFrame([held], f"id int, {FIELDS}"), time_unit="microseconds").orderBy("idx").collect()
    assert [(r["id"], r["x"], r["y"], r["z"], r["intensity"]) for r in out] == [(7, k + 5, 2 * k + 5, 3 * k + 5, 4 * k + 5) for k in range(6)]
    assert [r["rel_ms"] for r in out] == pytest.approx([5 * k / 1000 for k in range(6)])
    with pytest.raises(Exception, match="cut short"):
        capture.unpack_pointcloud2(spark.createDataFrame([(*held[:-1], data[:-1])], f"id int, {FIELDS}")).collect()


def _capture(records, directory):
    body, listed = b"", []
    for kind, payload in records:
        listed.append(struct.pack("<BBII", kind, 0, len(payload), len(body)))
        body += payload + struct.pack("<BBI", 0, kind, len(payload))
    if directory:
        body += b"".join(listed) + struct.pack("<BBI", 0, 0, 10 * len(listed))
    footer = bytes(32) + struct.pack("<I", len(body) + 72) + bytes(4) + capture.TELEMETRY_MARK
    return b"video" * 30 + body + footer


@pytest.mark.parametrize("directory", [True, False])
def test_telemetry(spark, tmp_path, directory):
    fix = struct.pack("<IIHcdcdcddd", 1700000000, 1, 250, b"A", 3.7, b"S", 38.5, b"W", 1.5, 90.0, 20.0)
    gyro = np.zeros(3, [("t", "<u8"), *[(f"{a}{b}", "<u2") for a in "ag" for b in "xyz"]])
    gyro["t"], gyro["gx"] = [2_000_000, 2_500_000, 3_000_000], 32768 + 3
    gyro["gy"] = gyro["gz"] = 32768
    gyro["gz"] += 4
    stamps = np.array([2_000_000, 4_000_000], "<u8").tobytes()
    records = [(4, struct.pack("<Qd", 2_000_000, 0.01)), (3, gyro.tobytes()), (6, stamps), (7, fix * 2)]
    (tmp_path / "a.bin").write_bytes(_capture(records, directory))
    fixes = capture.read_gps_trailers(spark, str(tmp_path / "*.bin")).orderBy("row").collect()
    assert [(r["row"], r["epoch"], r["ms"], r["status"], r["lat"], r["ns"], r["alt"]) for r in fixes] == [(k, 1700000000, 250, "A", 3.7, "S", 20.0) for k in (0, 1)]
    turns = capture.read_gyro_trailers(spark, str(tmp_path / "*.bin")).orderBy("t").collect()
    assert [(r["t"], r["w"]) for r in turns] == [(0.0, 5.0), (0.5, 5.0), (1.0, 5.0)]
    assert [r["t"] for r in capture.read_timelapse_times(spark, str(tmp_path / "*.bin")).orderBy("frame").collect()] == [0.0, 2.0]
    for bad, text in ((b"x" * 300, "no telemetry"), (b"x", "too short"), (_capture([(7, fix[:-1])], True), "cut short")):
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad" / "b.bin").write_bytes(bad)
        with pytest.raises(Exception, match=text):
            capture.read_gps_trailers(spark, str(tmp_path / "bad" / "*.bin")).collect()


def test_models(spark, tmp_path):
    images = struct.pack("<Q", 2)
    for k in (1, 2):
        images += struct.pack("<I7dI", k, 1, 0, 0, 0, 1.0 * k, 2.0, 3.0, 5) + f"cam0/{k}.jpg".encode() + b"\0" + struct.pack("<Q", k) + b"".join(struct.pack("<ddq", 0.5 * j, 2.5, -1 if j else 9) for j in range(k))
    (tmp_path / "images.bin").write_bytes(images)
    rows = capture.camera_centres(capture.read_sfm_bin(spark, str(tmp_path / "*.bin"), "images")).orderBy("image_id").collect()
    assert [(r["name"], r["camera_id"], r["cx"], r["cz"], len(r["features"])) for r in rows] == [("cam0/1.jpg", 5, -1.0, -3.0, 1), ("cam0/2.jpg", 5, -2.0, -3.0, 2)]
    assert tuple(rows[1]["features"][1]) == (0.5, 2.5, -1)
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<Q3d3BdQ", 4, 1, 2, 3, 7, 8, 9, 0.25, 2) + struct.pack("<4I", 1, 0, 2, 5))
    (row,) = capture.read_sfm_bin(spark, str(tmp_path / "*.bin"), "points3D").collect()
    assert (row["point_id"], row["z"], row["b"], row["error"], [tuple(t) for t in row["track"]]) == (4, 3.0, 9, 0.25, [(1, 0), (2, 5)])
    (tmp_path / "cameras.txt").write_text("# c\n1 PINHOLE 640 480 500 501 320 240\n")
    (tmp_path / "images.txt").write_text("# two lines each\n1 1 0 0 0 0.5 0 0 1 a.jpg\n1.5 2.5 7 3 4 -1\n2 1 0 0 0 0 0 0 1 b.jpg\n\n")
    assert capture.read_sfm_cameras(spark, str(tmp_path / "cameras.txt")).first()["params"] == [500.0, 501.0, 320.0, 240.0]
    a, b = capture.read_sfm_images(spark, str(tmp_path / "images.txt")).orderBy("image_id").collect()
    assert (a["name"], a["tx"], [tuple(f) for f in a["features"]], b["name"], b["features"]) == ("a.jpg", 0.5, [(1.5, 2.5, 7), (3.0, 4.0, -1)], "b.jpg", [])


@pytest.mark.parametrize("kind", ["pcd", "ply", "las"])
@pytest.mark.parametrize("far", [0, 500_000])
def test_clouds_come_back(spark, tmp_path, kind, far):
    rows = [(k, far + k / 8, k * 0.25 - 20, k % 7 / 4, k % 256 / 255, 0.5, 1.0, float(k % 9)) for k in range(400)]
    points = spark.createDataFrame(rows, "point_id long, x double, y double, z double, r double, g double, b double, intensity double").repartition(5)
    files = pf.write_cloud(points, str(tmp_path / "out"), kind, rows=150).orderBy("first_id").collect()
    assert sum(f["n"] for f in files) == 400 and len(files) > 2 and all(f["n"] <= 150 for f in files)
    back = pf.read_points(spark, str(tmp_path / "out" / f"*.{kind}")).collect()
    got = sorted((r["x"], r["y"], r["z"], round(r["r"] * 255), round(r["b"] * 255), r["intensity"]) for r in back)
    want = sorted((x, y, z, round(r * 255), round(b * 255), i) for _, x, y, z, r, _, b, i in rows)
    assert all(g == pytest.approx(w, abs=6e-4) for g, w in zip(got, want, strict=True))
    assert sorted(r["n"] for r in pf.cloud_counts(spark, str(tmp_path / "out" / f"*.{kind}")).collect()) == sorted(f["n"] for f in files)


def test_seeds(spark, tmp_path):
    rows = [(k * 10, k * 1.0, 2.0, 3.0, 1.0, 0.0, 0.5) for k in range(50)]
    points = spark.createDataFrame(rows, "point_id long, x double, y double, z double, r double, g double, b double").repartition(4)
    pf.write_seed_text(points, str(tmp_path / "txt"))
    seed = pf.read_sfm_points(spark, str(tmp_path / "txt")).orderBy("point_id").collect()
    assert [(r["point_id"], r["x"], r["r"], r["b"], r["error"], r["track"]) for r in seed] == [(k + 1, float(k), 255, 128, 0.1, []) for k in range(50)]
    pf.write_seed_bin(points, str(tmp_path / "bin"))
    whole = b"".join(open(f, "rb").read() for f in sorted(glob.glob(str(tmp_path / "bin" / "*.bin"))))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "points3D.bin").write_bytes(whole)
    back = capture.read_sfm_bin(spark, str(tmp_path / "one" / "*.bin"), "points3D").orderBy("point_id").collect()
    assert [(r["point_id"], r["x"], r["g"]) for r in back] == [(k + 1, float(k), 0) for k in range(50)]


def test_texts_of_tracks_rasters_and_places(spark, tmp_path):
    import xml.etree.ElementTree as ET

    fixes = spark.createDataFrame([(1, 10.5, -3.5, -38.25, 7.0), (1, 9.0, -3.25, -38.0, None)], "session int, t double, lat double, lon double, alt double")
    pf.write_gpx(fixes, str(tmp_path / "gpx"))
    root = ET.fromstring(open(glob.glob(str(tmp_path / "gpx" / "session=1" / "*.txt"))[0], "rb").read())
    name = "{http://www.topografix.com/GPX/1/1}"
    assert [(p.get("lat"), p.find(f"{name}ele").text, p.find(f"{name}time").text) for p in root.iter(f"{name}trkpt")] == [("-3.25", "0.0", "1970-01-01T00:00:09.000Z"), ("-3.5", "7.0", "1970-01-01T00:00:10.500Z")]
    world = pf.world_file(spark.createDataFrame([(0, 0, 1.0), (1, 3, 5.0)], "row long, col long, z double"), 0.5, 100.0, 50.0).first()
    assert world["world"].split() == ["0.50000000", "0.00000000", "0.00000000", "-0.50000000", "100.25000000", "49.75000000"]
    assert (world["width"], world["height"], world["min_y"], world["coverage"], world["max_z"]) == (4, 2, 49.0, 25.0, 5.0)
    image = spark.createDataFrame([("a.jpg", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "name string, latitude double, longitude double, altitude_m double, heading_deg double, easting_m double, northing_m double")
    assert tuple(pf.geotagged(image).first()) == ("a.jpg", "1.00000000", "2.00000000", "3.000", "4.00", "5.000", "6.000")
    held = spark.createDataFrame([(1, "length", 2.5, "m", [("c", "s", 4, 1.0, 2.0, 3.0), ("c", "s", 5, 1.0, 2.0, 5.5)])], "measurement int, type string, value double, unit string, points array<struct<cloud:string,source:string,point_id:long,x:double,y:double,z:double>>")
    assert [(r["vertex"], r["point_index"], r["z"]) for r in pf.measurement_rows(held).orderBy("vertex").collect()] == [(1, 4, 3.0), (2, 5, 5.5)]


def test_images_configs_and_signatures(spark, tmp_path):
    r = np.random.default_rng(0)
    grey = r.integers(0, 256, (512, 512)).astype(np.uint8)
    flat = np.full((512, 512, 3), 90, np.uint8)
    rows = [("a", 512, 512, 1, grey.tobytes()), ("b", 512, 512, 3, flat.tobytes()), ("c", 1024, 1024, 1, np.repeat(np.repeat(grey, 2, 0), 2, 1).tobytes())]
    got = {x["origin"]: x["sharpness"] for x in capture.sharpness(spark.createDataFrame(rows, "origin string, width int, height int, nChannels int, data binary")).collect()}
    p = np.pad(grey.astype(float), 1, mode="reflect")
    want = np.var([p[i, j + 1] + p[i + 2, j + 1] + p[i + 1, j] + p[i + 1, j + 2] - 4 * p[i + 1, j + 1] for i in range(512) for j in range(512)])
    assert got["a"] == pytest.approx(want) and got["b"] == 0 and got["c"] == pytest.approx(want)
    texts = spark.createDataFrame([(k, v) for k, v in enumerate(['{"version": 2, "gain": 1.5}', '{"version": 1, "gain": 9}', "not json", None, '{"version": 2}'])], "id int, value string")
    found = {x["id"]: x["broken"] for x in capture.parse_config(texts, "version int, gain double", {"version": "config.version = 2", "gain": "config.gain between 0 and 4"}).collect()}
    assert found == {0: [], 1: ["version", "gain"], 2: ["json"], 3: ["json"], 4: ["gain"]}
    (tmp_path / "a.txt").write_text("x")
    one = capture.content_signature(spark, str(tmp_path / "*"), "s").first()
    assert one == capture.content_signature(spark, str(tmp_path / "*"), "s").first() != capture.content_signature(spark, str(tmp_path / "*"), "t").first()
    (tmp_path / "cloud.ply.geo.json").write_text(json.dumps({"crs_wkt": "WKT"}))
    sidecars = spark.read.text(str(tmp_path / "*.geo.json"), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    points = spark.createDataFrame([(str(tmp_path / "cloud.ply"), 1), (str(tmp_path / "other.ply"), 2)], "path string, point_id int")
    assert {x["point_id"]: x["crs_wkt"] for x in capture.with_crs(points, sidecars).collect()} == {1: "WKT", 2: None}
    counts = spark.createDataFrame([("/a/x.pcd", 9), ("/a/y.ply", 5), ("/b/z.las", 1)], "path string, n long")
    assert sorted(x["path"] for x in capture.prefer_coloured(counts).collect()) == ["/a/y.ply", "/b/z.las"]


def test_scan_times_and_plane_uncertainty(spark):
    r = np.random.default_rng(1)
    raw = {s: np.cumsum(r.choice([0.2, 0.4, 3.0, -2.0], 60)).tolist() for s in range(3)}
    rows = [(s, k, t) for s, ts in raw.items() for k, t in enumerate(ts)]
    scan = spark.createDataFrame(rows, "scan_id int, idx int, rel_ms double").repartition(4)
    for s, ts in raw.items():
        want, last = [], None
        for t in ts:
            last = (t if abs(t) < 1 else 0.0) if last is None else t if abs(t - last) < 1 else last + rig.TIME_STEP
            want.append(last)
        assert [x["rel_ms"] for x in rig.repair_times(scan).where(f"scan_id = {s}").orderBy("idx").collect()] == pytest.approx(want)
    kept = [x["rel_ms"] for x in rig.throttle(scan.where("scan_id = 0"), 2.0, ("scan_id",), "rel_ms").orderBy("rel_ms").collect()]
    want = []
    for t in sorted(raw[0]):
        if not want or t - want[-1] >= 0.5:
            want.append(t)
    assert kept == want
    xyz = r.normal(size=(40, 3)) * [2.0, 1.0, 0.01]
    var = [np.diag(r.random(3)) + 0.1 for _ in range(40)]
    points = spark.createDataFrame([(1, *p, v.ravel().tolist()) for p, v in zip(xyz.tolist(), var, strict=True)], "cell int, x double, y double, z double, var array<double>").repartition(3)
    got = np.array(rig.plane_variance(points, ("cell",)).first()["variance"]).reshape(6, 6)
    value, axes = np.linalg.eigh(np.cov(xyz.T, bias=True))
    want = np.zeros((6, 6))
    for p, v in zip(xyz, var, strict=True):
        j = np.zeros((6, 3))
        for m in (1, 2):
            j[:3] += np.outer(axes[:, m], (p - xyz.mean(0)) @ (np.outer(axes[:, m], axes[:, 0]) + np.outer(axes[:, 0], axes[:, m]))) / (40 * (value[0] - value[m]))
        j[3:] = np.eye(3) / 40
        want += j @ v @ j.T
    assert np.allclose(np.abs(got), np.abs(want))


def test_texts_of_poses_and_frames(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# t p q\n1.5 1 2 3 0 0 0 2\n2.5 1 2 3 0 3 0 4\n")
    rows = pf.read_trajectory(spark, str(tmp_path / "t.txt")).orderBy("t").collect()
    assert [(r["t"], r["qy"], r["qw"]) for r in rows] == [(1.5, 0.0, 1.0), (2.5, 0.6, 0.8)]
    for text, message in (("1 nan 2 3 0 0 0 1\n", "not finite"), ("1 1 2 3 0 0 0 0\n", "no length")):
        (tmp_path / "bad.txt").write_text(text)
        with pytest.raises(Exception, match=message):
            pf.read_trajectory(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "f.json").write_text('{"cam0/frame_0003.jpg": null, "cam0/frame_0004.jpg": 0.5}')
    assert {r["name"][-8:-4]: r["t"] for r in pf.read_frames(spark, str(tmp_path / "f.json"), 4.0).collect()} == {"0003": 0.5, "0004": 0.5}
    (tmp_path / "r.csv").write_text("t,point_start,point_count\n0.5,0,4\n1.5,4,2\n")
    assert [tuple(r) for r in pf.read_scan_ranges(spark, str(tmp_path / "r.csv")).orderBy("t").collect()] == [(0.5, 0, 4), (1.5, 4, 2)]
