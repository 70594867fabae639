"""Point and pose files as Spark tables: PCD, PLY and LAS by byte ranges, text tables, and their sinks.

Files are listed by Spark's readers, and fixed-width records are cut into ranges that tasks read on their own; a
record's id is its place in the file. Tasks open files through Arrow's file systems.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a task's range.
RANGE = 32 << 20
POINTS = "path string, point_id long, x double, y double, z double, r double, g double, b double, intensity double"
#: The number types of PCD fields and PLY properties.
_PCD = {("F", 4): "f4", ("F", 8): "f8", ("I", 1): "i1", ("I", 2): "i2", ("I", 4): "i4", ("I", 8): "i8", ("U", 1): "u1", ("U", 2): "u2", ("U", 4): "u4", ("U", 8): "u8"}
_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def pcd_header(head: bytes) -> tuple[np.dtype, int, int, bool]:
    """Record type, records, bytes of header, and whether the body is text."""
    fields: dict[str, list[str]] = {}
    at = 0
    for line in head.split(b"\n"):
        at += len(line) + 1
        words = line.decode("ascii", "replace").split()
        if words and not words[0].startswith("#"):
            fields[words[0]] = words[1:]
            if words[0] == "DATA":
                break
    if fields.get("DATA", [""])[0] not in ("ascii", "binary"):
        raise ValueError("only ascii and binary PCD bodies are read")
    count = fields.get("COUNT", ["1"] * len(fields["FIELDS"]))
    kinds = [(n if n != "_" else f"_{k}", _PCD[t, int(s)], (int(c),)) if int(c) > 1 else (n if n != "_" else f"_{k}", _PCD[t, int(s)]) for k, (n, s, t, c) in enumerate(zip(fields["FIELDS"], fields["SIZE"], fields["TYPE"], count, strict=True))]
    n = int(fields["POINTS"][0])
    if not 1 <= n <= 10**9:
        raise ValueError("the number of points is out of range")
    return np.dtype(kinds), n, at, fields["DATA"][0] == "ascii"


def ply_header(head: bytes) -> tuple[np.dtype, int, int, bool]:
    """The same of a PLY file; the vertex element must come first and have no lists."""
    end = head.index(b"end_header\n") + len(b"end_header\n")
    order, kinds, n, element = "<", [], 0, None
    for line in head[:end].decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            order = {"ascii": "a", "binary_little_endian": "<", "binary_big_endian": ">"}[words[1]]
        elif words[:1] == ["element"]:
            if element is None and words[1] != "vertex":
                raise ValueError("the vertex element must come first")
            element = words[1]
            n = int(words[2]) if element == "vertex" else n
        elif words[:1] == ["property"] and element == "vertex":
            if words[1] == "list":
                raise ValueError("list properties are not read")
            kinds.append((words[2], (order if order != "a" else "<") + _PLY[words[1]]))
    return np.dtype(kinds), n, end, order == "a"


def las_header(head: bytes) -> tuple[np.dtype, int, int, bool, np.ndarray, np.ndarray]:
    """The same of an uncompressed LAS file, with scale and offset."""
    if head[:4] != b"LASF":
        raise ValueError("not a LAS file")
    at, form, size = struct.unpack_from("<I", head, 96)[0], head[104] & 63, struct.unpack_from("<H", head, 105)[0]
    n = struct.unpack_from("<Q", head, 247)[0] if head[25] >= 4 else struct.unpack_from("<I", head, 107)[0]
    names, places, kinds = ["x", "y", "z", "intensity"], [0, 4, 8, 12], ["<i4", "<i4", "<i4", "<u2"]
    color = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}.get(form)
    if color is not None:
        names, places, kinds = [*names, "red", "green", "blue"], [*places, color, color + 2, color + 4], [*kinds, "<u2", "<u2", "<u2"]
    kind = np.dtype({"names": names, "formats": kinds, "offsets": places, "itemsize": size})
    return kind, n, at, False, np.array(struct.unpack_from("<3d", head, 131)), np.array(struct.unpack_from("<3d", head, 155))


def _header(path: str, head: bytes):
    kind = path.lower().rpartition(".")[2]
    if kind == "las":
        return las_header(head)
    return (*(ply_header(head) if kind == "ply" else pcd_header(head)), np.ones(3), np.zeros(3))


def _frame(path: str, rows: np.ndarray, first: int, scale: np.ndarray, offset: np.ndarray) -> pd.DataFrame:
    names = rows.dtype.names or ()
    out = {"path": path, "point_id": np.arange(first, first + len(rows))}
    for k, c in enumerate("xyz"):
        out[c] = rows[c].astype(float) * scale[k] + offset[k]
    if "rgb" in names or "rgba" in names:
        packed = rows["rgb" if "rgb" in names else "rgba"]
        packed = packed.view("u4") if packed.dtype.kind == "f" and packed.dtype.itemsize == 4 else packed.astype("u4")
        out |= {"r": (packed >> 16 & 255) / 255.0, "g": (packed >> 8 & 255) / 255.0, "b": (packed & 255) / 255.0}
    else:
        for c, long in zip("rgb", ("red", "green", "blue"), strict=True):
            own = next((x for x in (long, c) if x in names), None)
            most = 65535.0 if own and rows[own].dtype.itemsize == 2 else 255.0 if own and rows[own].dtype.kind in "iu" else 1.0
            out[c] = rows[own].astype(float) / most if own else np.nan
    out["intensity"] = rows["intensity"].astype(float) if "intensity" in names else np.nan
    return pd.DataFrame(out)


def file_system(path: str):
    """Arrow's file system of a path or address, and the path in it."""
    from pyarrow import fs

    bare = path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path
    return (fs.LocalFileSystem(), bare) if bare.startswith("/") else fs.FileSystem.from_uri(path)


def open_file(path: str):
    held, at = file_system(path)
    return held.open_input_file(at)


def _read(path: str, low: int, high: int) -> pd.DataFrame:
    with open_file(path) as file:
        kind, n, at, text, scale, offset = _header(path, file.read(1 << 16))
        if text:
            if low:
                return pd.DataFrame(columns=[c.split(" ")[0] for c in POINTS.split(", ")])
            file.seek(at)
            body = np.loadtxt(io.BytesIO(file.read()), max_rows=n, ndmin=2)
            rows = np.zeros(len(body), kind)
            for k, c in enumerate(kind.names):
                rows[c] = body[:, k]
            if len(rows) < n:
                raise ValueError("the file is cut short")
            return _frame(path, rows, 0, scale, offset)
        a, b = low // kind.itemsize, min(n, high // kind.itemsize)
        file.seek(at + a * kind.itemsize)
        raw = file.read(max(0, b - a) * kind.itemsize)
        if len(raw) < max(0, b - a) * kind.itemsize:
            raise ValueError("the file is cut short")
        return _frame(path, np.frombuffer(raw, kind), a, scale, offset)


def read_points(spark: SparkSession, glob: str, size: int = RANGE) -> DataFrame:
    """Points of all PCD, PLY and LAS files of a pattern. Binary bodies are read in ranges of so many bytes, in parallel.

    Points with a coordinate that isn't finite are dropped; their ids stay unused.
    """
    files = spark.read.format("binaryFile").load(glob).select("path", "length").where(F.lower("path").rlike(r"\.(pcd|ply|las)$"))
    step = F.lit(size // 840 * 840)  # record sizes rarely divide it; bounds are cut to whole records below
    ranges = files.withColumn("low", F.explode(F.sequence(F.lit(0), F.col("length"), step.cast("long")))).select("path", "low", (F.col("low") + step).alias("high"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, low, high in rows.itertuples(index=False):
                yield _read(path, low, high)

    points = ranges.repartition(F.col("path"), F.col("low")).mapInPandas(read, POINTS)
    finite = F.lit(True)
    for c in "xyz":
        finite = finite & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return points.where(finite)


def cloud_counts(spark: SparkSession, glob: str) -> DataFrame:
    """Records of each file by its header alone; rank prefers PLY to PCD within a folder."""

    def peek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path in rows["path"]:
                with open_file(path) as file:
                    out.append((path, int(_header(path, file.read(1 << 16))[1])))
            yield pd.DataFrame(out, columns=["path", "n"])

    return spark.read.format("binaryFile").load(glob).select("path").where(F.lower("path").rlike(r"\.(pcd|ply|las)$")).mapInPandas(peek, "path string, n long")


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Poses t px py pz qx qy qz qw from text with spaces; quaternions of no length are rejected, others normalised."""
    names = ("t", "px", "py", "pz", "qx", "qy", "qz", "qw")
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.size(parts) >= 8))
    out = rows.select(*[parts[k].cast("double").alias(c) for k, c in enumerate(names)])
    n = F.sqrt(sum((F.col(c) * F.col(c) for c in names[4:]), F.lit(0.0)))
    finite = F.forall(F.array(*names), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.when(~finite, F.raise_error(F.lit("a pose is not finite"))).when(n > 0, n).otherwise(F.raise_error(F.lit("a quaternion has no length")))
    return out.withColumn("_n", good).withColumns({c: F.col(c) / F.col("_n") for c in names[4:]}).drop("_n")


def read_scan_ranges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("t double, point_start long, point_count long").option("header", True).option("mode", "FAILFAST").csv(path)


def read_frames(spark: SparkSession, path: str, fps: float | None = None) -> DataFrame:
    """Names and times of a JSON map; a null time is that of the name's number, from 1, at fps frames a second."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,double>", {"mode": "FAILFAST"})).alias("name", "t"))
    number = F.regexp_extract("name", r"([0-9]+)[^0-9]*$", 1).cast("double")
    return rows if fps is None else rows.withColumn("t", F.coalesce("t", (number - 1) / fps))


def read_sfm_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a text model: id, place, colour, error and track."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(p) >= 8))
    rest = F.slice(p, 9, 1 << 20)
    track = F.transform(F.sequence(F.lit(0), (F.size(rest) / 2 - 1).cast("int")), lambda k: F.struct(rest[2 * k].cast("long").alias("image_id"), rest[2 * k + 1].cast("int").alias("idx")))
    return rows.select(p[0].cast("long").alias("point_id"), *[p[k + 1].cast("double").alias(c) for k, c in enumerate("xyz")], *[p[k + 4].cast("int").alias(c) for k, c in enumerate("rgb")], p[7].cast("double").alias("error"), F.when(F.size(rest) >= 2, track).otherwise(F.array().cast("array<struct<image_id:bigint,idx:int>>")).alias("track"))


def unpack_livox(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Points of 19-byte records (offset ns, x, y, z, reflectivity, tag, line): the message's key columns and one row a point."""
    kind = np.dtype([("offset", "<u4"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("reflectivity", "u1"), ("tag", "u1"), ("line", "u1")])
    keys = [c for c in messages.columns if c != raw]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k, body in enumerate(rows[raw]):
                if len(body) % kind.itemsize:
                    raise ValueError("a message is cut short")
                p = np.frombuffer(body, kind)
                own = {c: [rows[c].iloc[k]] * len(p) for c in keys}
                yield pd.DataFrame(own | {"idx": np.arange(len(p)), "x": p["x"].astype(float), "y": p["y"].astype(float), "z": p["z"].astype(float), "intensity": p["reflectivity"].astype(float), "tag": p["tag"].astype(int), "line": p["line"].astype(int), "rel_ms": p["offset"] / 1e6})

    head = "".join(f"`{c}` {t}, " for c, t in messages.dtypes if c != raw)
    return messages.mapInPandas(unpack, head + "idx long, x double, y double, z double, intensity double, tag int, line int, rel_ms double")


#: Points of an output file, all of which a task holds at once.
PART_ROWS = 1_000_000


def _pcd_bytes(p: pd.DataFrame, wide: bool, lit: bool, offset: tuple) -> bytes:
    size, kind = ("8", "<f8") if wide else ("4", "<f4")
    names = ["x", "y", "z", "rgb", *["intensity"] * lit]
    head = [f"VERSION .7\nFIELDS {' '.join(names)}", "SIZE " + " ".join("4" if c == "rgb" else size for c in names), "TYPE " + " ".join("F" * len(names)), "COUNT " + " ".join("1" * len(names)), f"WIDTH {len(p)}\nHEIGHT 1\nPOINTS {len(p)}\nDATA binary\n"]
    rows = np.zeros(len(p), [(c, "<u4" if c == "rgb" else kind) for c in names])
    for c in names:
        rows[c] = p["r"].to_numpy("u4") << 16 | p["g"].to_numpy("u4") << 8 | p["b"].to_numpy("u4") if c == "rgb" else p[c]
    return "\n".join(head).encode() + rows.tobytes()


def _ply_bytes(p: pd.DataFrame, wide: bool, lit: bool, offset: tuple) -> bytes:
    kinds = [*(("double", c, "<f8", c) for c in "xyz"), ("uchar", "red", "u1", "r"), ("uchar", "green", "u1", "g"), ("uchar", "blue", "u1", "b"), *[("double", "intensity", "<f8", "intensity")] * lit]
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(p)}", *(f"property {k} {n}" for k, n, _, _ in kinds), "end_header\n"]
    rows = np.zeros(len(p), [(n, t) for _, n, t, _ in kinds])
    for _, n, _, c in kinds:
        rows[n] = p[c]
    return "\n".join(head).encode() + rows.tobytes()


def _las_bytes(p: pd.DataFrame, wide: bool, lit: bool, offset: tuple) -> bytes:
    """LAS 1.4, point format 7, millimetres."""
    kind = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("class", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("time", "<f8"), ("r", "<u2"), ("g", "<u2"), ("b", "<u2")])
    rows, bounds = np.zeros(len(p), kind), []
    offset = offset or tuple(float(np.floor(p[c].min() / 1000) * 1000) for c in "xyz")
    for k, c in enumerate("xyz"):
        units = np.rint((p[c].to_numpy() - offset[k]) / 0.001)
        if len(units) and not (np.abs(units) < 2**31).all():
            raise ValueError(f"{c} spans more than millimetres in 32 bits can tell")
        rows[c] = units
        stored = rows[c] * 0.001 + offset[k]
        bounds += [stored.max(), stored.min()]
    for c in "rgb":
        rows[c] = p[c].to_numpy("u2") * 257
    if lit:
        rows["intensity"] = np.clip(np.rint(p["intensity"]), 0, 65535)
    head = struct.pack("<4sHH16sBB32s32sHHHIIBHI5I", b"LASF", 0, 16, bytes(16), 1, 4, b"", b"", 1, 2024, 375, 375, 0, 7, kind.itemsize, 0, *[0] * 5)
    return head + struct.pack("<12dQQIQ15Q", *[0.001] * 3, *offset, *bounds, 0, 0, 0, len(p), *[0] * 15) + rows.tobytes()


def write_cloud(points: DataFrame, path: str, kind: str, rows: int = PART_ROWS) -> DataFrame:
    """Points (colours 0 to 1) as pcd, ply or las files of so many points at most, by ranges of ids: path, n and first id of each.

    Every file is whole by itself, with its own header; a cloud that fits one file gives one. PCD coordinates are doubles
    where any is beyond 100,000; LAS offsets are whole thousands below the least coordinates (of each file, where the cloud is
    too wide for one offset; a file that is too wide is an error). A file appears under its name
    when it is complete, so a task that runs again does no harm. A null intensity column is left out. Writes at once.
    """
    make = {"pcd": _pcd_bytes, "ply": _ply_bytes, "las": _las_bytes}[kind]
    s = points.agg(F.count("*").alias("n"), F.max(F.greatest(*[F.abs(c) for c in "xyz"])).alias("most"), *[F.min(c).alias(c) for c in "xyz"], *[F.max(c).alias(f"{c}_max") for c in "xyz"], F.count("intensity").alias("lit") if "intensity" in points.columns else F.lit(0).alias("lit")).first()
    if not s["n"]:
        raise ValueError("the cloud has no points")
    offset = tuple(float(np.floor(s[c] / 1000) * 1000) for c in "xyz")
    if any(s[f"{c}_max"] - o >= 2**31 * 0.001 for c, o in zip("xyz", offset, strict=True)):
        offset = ()
    wide, lit, parts = s["most"] > 100_000, s["lit"] > 0, -(-s["n"] // max(1, rows * 3 // 4))  # ranges are uneven by a part

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held = [b for b in batches if len(b)]
        if not held:  # a range without rows
            return
        held, task = pd.concat(held), TaskContext.get()
        for k, low in enumerate(range(0, len(held), rows)):
            part = held.iloc[low : low + rows]
            where, at = file_system(f"{path}/part-{task.partitionId():05d}-{k:03d}.{kind}")
            where.create_dir(at.rpartition("/")[0])
            with where.open_output_stream(f"{at}.{task.taskAttemptId()}") as file:
                file.write(make(part, wide, lit, offset))
            where.move(f"{at}.{task.taskAttemptId()}", at)
            yield pd.DataFrame([(at, len(part), int(part["point_id"].iloc[0]))], columns=["path", "n", "first_id"])

    channel = [F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)))) * 255).cast("int").alias(c) for c in "rgb"]
    ready = points.select("point_id", *"xyz", *channel, *["intensity"] * lit).repartitionByRange(parts, "point_id").sortWithinPartitions("point_id")
    done = ready.mapInPandas(write, "path string, n long, first_id long").collect()  # one row a file
    return points.sparkSession.createDataFrame(done, "path string, n long, first_id long")


def write_ply(points: DataFrame, path: str) -> DataFrame:
    return write_cloud(points, path, "ply")


def seed_points(points: DataFrame) -> DataFrame:
    """Points (colours 0 to 1) as a model's seed: ids from 1 by the order of ids, 8-bit colours, error 0.1 and no track."""
    from scanloom.operators.clouds import dense_rank_by_key

    channel = [F.bround(F.col(c) * 255).cast("int").alias(c) for c in "rgb"]
    return dense_rank_by_key(points, "point_id", "_rank").select((F.col("_rank") + 1).alias("id"), *"xyz", *channel, F.lit(0.1).alias("error"))


def write_seed_text(points: DataFrame, path: str) -> None:
    """A seed as text parts that concatenate to one model file in name order."""
    seed = seed_points(points).repartitionByRange("id").sortWithinPartitions("id")
    seed.select(F.concat_ws(" ", "id", *[F.format_string("%.6f", c) for c in "xyz"], *"rgb", F.format_string("%.4f", "error")).alias("value")).write.mode("errorifexists").text(path)


_SEED = np.dtype([("id", "<u8"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("error", "<f8"), ("track", "<u8")])


def write_seed_bin(points: DataFrame, path: str) -> DataFrame:
    """A seed as binary parts that concatenate to one model file in name order: path and n of each. The first has the count in front."""
    seed = seed_points(points).select("id", *"xyz", *"rgb", "error")
    total = points.count()
    parts = -(-total // PART_ROWS) or 1

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held, task = [b for b in batches if len(b)], TaskContext.get()
        if held:  # a range may have no rows
            held = pd.concat(held)
            rows = np.zeros(len(held), _SEED)
            for c in held.columns:
                rows[c] = held[c]
            where, at = file_system(f"{path}/points3D-{task.partitionId():05d}.bin")
            where.create_dir(at.rpartition("/")[0])
            with where.open_output_stream(f"{at}.{task.taskAttemptId()}") as file:
                file.write((struct.pack("<Q", total) if held["id"].iloc[0] == 1 else b"") + rows.tobytes())
            where.move(f"{at}.{task.taskAttemptId()}", at)
            yield pd.DataFrame([(at, len(held))], columns=["path", "n"])

    done = seed.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInPandas(write, "path string, n long").collect()
    return points.sparkSession.createDataFrame(done, "path string, n long")


def write_gpx(fixes: DataFrame, path: str, creator: str = "scanloom") -> None:
    """A GPX document a session, in one folder each: a track of the fixes (lat, lon, alt, t) in order of time."""
    stamp = F.date_format(F.timestamp_millis(F.round(F.col("t") * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    point = F.concat(F.lit('<trkpt lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('"><ele>'), F.coalesce(F.col("alt").cast("string"), F.lit("0.0")), F.lit("</ele><time>"), stamp, F.lit("</time></trkpt>"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1" creator="{creator}"><trk><trkseg>'
    lines = fixes.select("session", F.lit(1).alias("_o"), "t", point.alias("value"))
    ends = fixes.select("session").distinct()
    for order, text in ((0, head), (2, "</trkseg></trk></gpx>")):
        lines = lines.unionByName(ends.select("session", F.lit(order).alias("_o"), F.lit(0.0).alias("t"), F.lit(text).alias("value")))
    lines.repartition("session").sortWithinPartitions("session", "_o", "t").select("session", "value").write.mode("errorifexists").partitionBy("session").text(path)


def geotagged(images: DataFrame) -> DataFrame:
    """Image places with fixed decimals."""
    form = {"latitude": 8, "longitude": 8, "altitude_m": 3, "heading_deg": 2, "easting_m": 3, "northing_m": 3}
    return images.select(F.col("name").alias("image"), *[F.format_string(f"%.{d}f", F.col(c).cast("double")).alias(c) for c, d in form.items()])


def write_geotagged_csv(images: DataFrame, path: str) -> None:
    geotagged(images).write.mode("errorifexists").option("header", True).csv(path)


def world_file(cells: DataFrame, gsd: float, x0: float, y1: float) -> DataFrame:
    """One row about a raster (row, col, z): the six lines of its world file, bounds, size, coverage and range of heights."""
    width, height = F.max("col") + 1, F.max("row") + 1
    lines = "".join(f"{v:.8f}\n" for v in (gsd, 0, 0, -gsd, x0 + gsd / 2, y1 - gsd / 2))
    return cells.agg(
        F.lit(lines).alias("world"), width.alias("width"), height.alias("height"), F.lit(x0).alias("min_x"), (y1 - height * gsd).alias("min_y"), (x0 + width * gsd).alias("max_x"), F.lit(y1).alias("max_y"),
        (100 * F.count("*") / (width * height)).alias("coverage"), F.min("z").alias("min_z"), F.max("z").alias("max_z"),
    )


def measurement_rows(measurements: DataFrame) -> DataFrame:
    """A row for each vertex of measurements (measurement, type, value, unit, points)."""
    rows = measurements.select("measurement", "type", "value", "unit", F.posexplode("points").alias("at", "p"))
    return rows.select("measurement", "type", "value", "unit", (F.col("at") + 1).alias("vertex"), "p.cloud", "p.source", F.col("p.point_id").alias("point_index"), "p.x", "p.y", "p.z")


def write_measurements(measurements: DataFrame, path: str) -> None:
    measurement_rows(measurements).write.mode("errorifexists").option("header", True).csv(path)


def write_gps_csv(gps: DataFrame, path: str) -> None:
    gps.write.mode("errorifexists").option("header", True).csv(path)


def write_geojson(gps: DataFrame, path: str, gap: float = 10.0) -> None:
    """One feature a track segment."""
    from scanloom.operators.gps import gap_segments

    line = F.transform(F.array_sort(F.collect_list(F.struct("t", "lon", "lat", "alt"))), lambda p: F.array(p["lon"], p["lat"], p["alt"]))
    rows = gap_segments(gps, gap).groupBy("session", "segment").agg(line.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("session", "segment").alias("properties"), F.struct(F.lit("LineString").alias("type"), "coordinates").alias("geometry"))
    rows.select(F.to_json(feature).alias("value")).write.mode("errorifexists").text(path)


def publish_report(report: DataFrame, path: str) -> None:
    """Written whole or not at all, and never over another."""
    report.write.mode("errorifexists").json(path)


def write_chunks(rows: DataFrame, path: str) -> None:
    """Rows of overlap_chunks in one folder a chunk."""
    rows.write.mode("errorifexists").partitionBy("name").parquet(path)
