"""Point clouds: filters, clips, voxels, rasters, sampling and comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.lineage import checkpoint
from scanloom.operators.quantiles import exact_percentiles, percentile_row
from scanloom.operators.series import Series, small

XYZ = ("x", "y", "z")


def _finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def clean_points(points: DataFrame) -> DataFrame:
    """Drops points with a coordinate that isn't finite; colours are clipped to 0..1, NaN and infinity being 0 and 1, intensity 0."""
    out = points.where(_finite("x") & _finite("y") & _finite("z"))
    own = {c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.col(c).cast("double"), F.lit(0.0)))) for c in ("r", "g", "b") if c in points.columns}
    if "intensity" in points.columns:
        own["intensity"] = F.when(_finite("intensity"), F.col("intensity")).otherwise(0.0)
    return out.withColumns(own) if own else out


def resolve_color(points: DataFrame, keys: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """red, green, blue in 0..1: from r, g, b; else from packed rgb; else grey by intensity; else 0.7.

    Channels or intensities of a cloud that go beyond 1 anywhere are taken as 0..255.
    """
    have = set(points.columns)
    c = lambda name: F.col(name).cast("double") if name in have else F.lit(None).cast("double")
    packed = F.col("rgb").cast("long") if "rgb" in have else F.lit(None).cast("long")
    parts = {"r": F.shiftright(packed, 16), "g": F.shiftright(packed, 8), "b": packed}
    most = points.groupBy(*keys).agg(F.max(F.greatest(c("r"), c("g"), c("b"))).alias("top_c"), F.max(c("intensity")).alias("top_i"))
    rows = points.join(small(checkpoint(most)), list(keys)) if keys else points.crossJoin(F.broadcast(most))
    grey = c("intensity") / F.when(F.col("top_i") > 1, 255.0).otherwise(1.0)
    out = {}
    for name, to in (("r", "red"), ("g", "green"), ("b", "blue")):
        own = c(name) / F.when(F.col("top_c") > 1, 255.0).otherwise(1.0)
        value = F.coalesce(own, parts[name].bitwiseAND(255) / 255.0, grey, F.lit(0.7))
        out[to] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return rows.withColumns(out).drop("top_c", "top_i")


def range_gate(points: DataFrame, low: float = 0.2, high: float = 32.0, z_max: float = 25.0, blind: float = 0.0) -> DataFrame:
    """Points whose distance lies between both bounds (closed), beyond the blind zone, and whose height is at most z_max."""
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    return points.where(r2.between(low * low, high * high) & (r2 >= blind * blind) & (F.abs("z") <= z_max))


def decimate(points: DataFrame, k: int, index: str = "idx") -> DataFrame:
    """Every k-th point of a scan by its index."""
    return points.where(F.pmod(F.col(index), F.lit(k)) == 0)


def livox_valid(points: DataFrame, keys: Sequence[str] = ("scan_id", "line")) -> DataFrame:
    """Returns with a good tag that differ from their predecessor on the line by more than 1e-7 in some coordinate."""
    w = Window.partitionBy(*keys).orderBy("idx")
    good = points.where(F.col("tag").bitwiseAND(0x30) == 0x10)
    moved = F.lit(False)
    for c in XYZ:
        moved = moved | (F.abs(F.col(c) - F.lag(c).over(w)) > 1e-7)
    return good.withColumn("_keep", F.coalesce(moved, F.lit(True))).where("_keep").drop("_keep")


#: What a family of sensors reports: highest ring, factor to intensity, and milliseconds of a time unit.
SENSORS = {"livox": (6, 1.0, 1e-6), "velodyne": (64, 1.0, 1e-3), "ouster": (64, 1.0, 1e-6), "hesai": (128, 1 / 255, 1e3), "robosense": (128, 1.0, 1e3), "l515": (1, 1.0, 1.0)}


def normalize_scan(points: DataFrame, kind: str, rings: int | None = None) -> DataFrame:
    """Rings below the sensor's number, intensity on its scale, and relative times in milliseconds, in time order within each scan.

    Absolute times are made relative to the first of their scan.
    """
    most, factor, unit = SENSORS[kind]
    first = F.min("time").over(Window.partitionBy("scan_id"))
    out = points.where(F.col("ring") < (rings or most)).withColumns({"intensity": F.col("intensity") * factor, "rel_ms": (F.col("time") - first) * unit})
    return sort_scan(out)


def sort_scan(points: DataFrame, keys: Sequence[str] = ("scan_id",), time: str = "rel_ms") -> DataFrame:
    """Scans whole in a partition, in time order; no global sort."""
    return points.repartition(*keys).sortWithinPartitions(*keys, time)


def filter_tie_points(points: DataFrame, z_min: float, z_max: float, error: float) -> DataFrame:
    return points.where(F.col("z").between(z_min, z_max) & (F.col("error") <= error))


def crop_bbox(points: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Inside closed bounds; the predicates reach a Parquet scan."""
    for c, a, b in zip(XYZ, low, high, strict=True):
        points = points.where(F.col(c).between(a, b))
    return points


def clip_obb(points: DataFrame, center: Sequence[float], extent: Sequence[float], yaw: float, invert: bool = False) -> DataFrame:
    """Inside (or outside) a box of full extents turned by yaw about the vertical; its faces belong to it.

    Inside, the axis-aligned bounds of the box come first, as they can be checked by a scan.
    """
    c, s = math.cos(yaw), math.sin(yaw)
    dx, dy, dz = (F.col(k) - v for k, v in zip(XYZ, center, strict=True))
    half = [e / 2 for e in extent]
    inside = (F.abs(c * dx + s * dy) <= half[0]) & (F.abs(-s * dx + c * dy) <= half[1]) & (F.abs(dz) <= half[2])
    if invert:
        return points.where(~inside)
    reach = (abs(c) * half[0] + abs(s) * half[1] + 1e-9, abs(s) * half[0] + abs(c) * half[1] + 1e-9, half[2] + 1e-9)
    return crop_bbox(points, [m - r for m, r in zip(center, reach, strict=True)], [m + r for m, r in zip(center, reach, strict=True)]).where(inside)


def default_clip_box(points: DataFrame, share: float = 0.02, least: float = 0.2) -> DataFrame:
    """Centre and extent of the bounds of all points with a margin on each side."""
    bounds = points.agg(*[f(c).alias(f"{c}_{n}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))])
    margin = lambda c: F.greatest(F.lit(least), share * (F.col(f"{c}_max") - F.col(f"{c}_min")))
    return bounds.select(
        *[((F.col(f"{c}_min") + F.col(f"{c}_max")) / 2).alias(f"c{c}") for c in XYZ],
        *[(F.col(f"{c}_max") - F.col(f"{c}_min") + 2 * margin(c)).alias(f"e{c}") for c in XYZ],
    )


def crop_percentile(points: DataFrame, low: float = 1.0, high: float = 99.0, along: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Inside the percentiles of each axis, then within a share of the extent along the main horizontal direction."""
    bounds = exact_percentiles(points, {f"{c}_{n}": (F.col(c), p / 100) for c in XYZ for n, p in (("lo", low), ("hi", high))})
    inner = points
    for c in XYZ:
        inner = inner.where(F.col(c).between(F.lit(bounds[f"{c}_lo"]), F.lit(bounds[f"{c}_hi"])))
    spread = inner.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.atan2(2 * F.covar_samp("x", "y"), F.var_samp("x") - F.var_samp("y")) / 2).alias("turn"))
    rows = inner.crossJoin(F.broadcast(spread)).withColumn("_s", (F.col("x") - F.col("mx")) * F.cos("turn") + (F.col("y") - F.col("my")) * F.sin("turn"))
    ends = rows.agg(F.min("_s").alias("_a"), F.max("_s").alias("_b"))
    share = (F.col("_s") - F.col("_a")) / F.greatest(F.col("_b") - F.col("_a"), F.lit(1e-12))
    return rows.crossJoin(F.broadcast(ends)).where(share.between(*along)).select(*points.columns)


def cell(size: float, *names: str) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("long").alias(f"k{c}") for c in names]


def voxel_centroids(points: DataFrame, size: float, cap: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and count of the points of each cell. Under a cap, cells whose mixed key comes first stay, whatever the partitioning."""
    out = points.groupBy(*keys, *cell(size, *XYZ)).agg(*[F.avg(c).alias(c) for c in XYZ], F.count("*").alias("n"))
    return out if cap is None else out.orderBy(F.xxhash64("kx", "ky", "kz"), "kx", "ky", "kz").limit(cap)


def first_per_cell(points: DataFrame, size: float, keys: Sequence[str] = ()) -> DataFrame:
    """The record with the least id of each cell."""
    return points.groupBy(*keys, *cell(size, *XYZ)).agg(F.min("point_id").alias("point_id"))


def top_surface(points: DataFrame, gsd: float, bounds: tuple[float, float, float, float] | None = None, most: int = 16384) -> DataFrame:
    """The highest point of each ground cell, row 0 in the north: row, col, z, r, g, b. Ties go to the largest id.

    One aggregation; the bounds, where not given, are a single row that is broadcast. Beyond most cells a side, cells grow.
    """
    if bounds is None:
        edge = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    else:
        edge = points.sparkSession.range(1).select(*[F.lit(float(v)).alias(n) for v, n in zip(bounds, ("x0", "x1", "y0", "y1"), strict=True)])
    widest = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    step = F.greatest(F.lit(gsd), widest / (most - 1))
    rows = points.crossJoin(F.broadcast(edge.withColumn("_step", step)))
    at = {"row": F.floor((F.col("y1") - F.col("y")) / F.col("_step")).cast("long"), "col": F.floor((F.col("x") - F.col("x0")) / F.col("_step")).cast("long")}
    best = F.max(F.struct("z", "point_id", "r", "g", "b")).alias("top")
    return rows.withColumns(at).groupBy("row", "col").agg(best).select("row", "col", "top.z", "top.r", "top.g", "top.b")


def fill_holes(cells: DataFrame, radius: int) -> DataFrame:
    """Empty cells within so many pixels of occupied ones get the nearest one's values (ties: the first row, then column)."""
    values = [c for c in cells.columns if c not in ("row", "col")]
    disk = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if 0 < i * i + j * j <= radius * radius]
    if not disk:
        return cells
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in disk])
    near = cells.withColumn("_s", F.explode(steps)).select(
        (F.col("row") + F.col("_s.i")).alias("row"), (F.col("col") + F.col("_s.j")).alias("col"),
        F.struct((F.col("_s.i") * F.col("_s.i") + F.col("_s.j") * F.col("_s.j")).alias("d"), F.col("row").alias("from_row"), F.col("col").alias("from_col"), *values).alias("v"),
    )
    best = near.groupBy("row", "col").agg(F.min("v").alias("v")).select("row", "col", *[F.col(f"v.{c}").alias(c) for c in values])
    return cells.unionByName(best.join(cells.select("row", "col"), ["row", "col"], "left_anti"))


def height_ramp(points: DataFrame) -> DataFrame:
    """Colours by height between the lowest and highest point, blue over green to red."""
    ends = points.agg(F.min("z").alias("_a"), F.max("z").alias("_b"))
    rows = points.crossJoin(F.broadcast(ends)).withColumn("_u", (F.col("z") - F.col("_a")) / F.greatest(F.col("_b") - F.col("_a"), F.lit(1e-9)))
    u = F.col("_u")
    return rows.withColumns({"red": F.greatest(F.lit(0.0), 2 * u - 1), "green": 1 - F.abs(2 * u - 1), "blue": F.greatest(F.lit(0.0), 1 - 2 * u)}).drop("_a", "_b", "_u")


def extent(points: DataFrame, *keys: str) -> DataFrame:
    """Bounds and counts for each prefix of the keys, and of all points."""
    return points.rollup(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n"))


def dense_rank_by_key(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Positions 0, 1, ... in the order of a unique key without a single-partition sort: stretches at the key's quantiles are ranked apart."""
    series = Series(rows, (), key)
    return series.ranked(series.rows, name).drop("_cut")


def sample_even(points: DataFrame, percent: float, cap: int | None = None) -> DataFrame:
    """Exactly max(1, floor(N percent / 100)) points (no more than the cap), evenly spaced over the order of ids, ends included."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    total = points.agg(F.count("*").alias("_total"))
    budget = F.greatest(F.lit(1), F.floor(F.col("_total") * percent / 100)).cast("long")
    budget = budget if cap is None else F.least(budget, F.lit(cap))
    ranked = dense_rank_by_key(points, "point_id", "_rank").crossJoin(F.broadcast(total.withColumn("_take", budget)))
    last, take = F.col("_total") - 1, F.col("_take")
    # Rank r is chosen if some k < take has floor(k last / (take - 1)) = r; the least such k is the only one to try.
    k = F.ceil(F.col("_rank") * (take - 1) / F.greatest(last, F.lit(1)))
    chosen = F.when(take == 1, F.col("_rank") == 0).otherwise((k < take) & (F.floor(k * last / (take - 1)) == F.col("_rank")))
    return ranked.where(chosen).select(*points.columns)


def mixed(key: str | Column, seed: int) -> Column:
    """An integer hash of a key that other engines can repeat."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.pmod(key, F.lit(2147483647)) * 48271 + seed, F.lit(2147483647))


def sample_hash(rows: DataFrame, n: int, seed: int = 0, key: str = "point_id") -> DataFrame:
    """n rows whose mixed keys come first; the same ones however the rows are partitioned."""
    return rows.orderBy(mixed(key, seed), key).limit(n)


def split_halves(rows: DataFrame, seed: int = 0, key: str = "point_id") -> DataFrame:
    """train or test by the mixed key."""
    return rows.withColumn("split", F.when(mixed(key, seed) < 2147483647 // 2, "train").otherwise("test"))


def color_range(points: DataFrame, column: str, low: float = 0.5, high: float = 99.5) -> DataFrame:
    """Exact percentiles between which a colour scale runs; equal ends are set one apart."""
    out = percentile_row(points, {"low": (F.col(column), low / 100), "high": (F.col(column), high / 100)})
    return out.withColumn("high", F.when(F.col("high") > F.col("low"), F.col("high")).otherwise(F.col("low") + 1))


def every_nth(points: DataFrame, step: int) -> DataFrame:
    return points.where(F.pmod(F.col("point_id"), F.lit(step)) == 0)


def record_slice(points: DataFrame, start: int, end: int) -> DataFrame:
    """Records start (included) to end (excluded); pushed down to a scan."""
    return points.where((F.col("point_id") >= start) & (F.col("point_id") < end))


def front_most(points: DataFrame, row: Column, column: Column, depth: Column) -> DataFrame:
    """The point of least depth of each output pixel (ties: least id)."""
    rows = points.select(row.cast("long").alias("row"), column.cast("long").alias("col"), F.struct(depth.alias("depth"), "point_id", "r", "g", "b").alias("p"))
    return rows.groupBy("row", "col").agg(F.min("p").alias("p")).select("row", "col", "p.*")


def pick(points: DataFrame, x: float, y: float, u: Column, v: Column, depth: Column, radius: float = 8.0, slack: float = 4.0) -> DataFrame:
    """The picked point: of those within slack of the nearest to the cursor (and radius), the least deep."""
    near = points.withColumns({"_d": F.sqrt((u - x) * (u - x) + (v - y) * (v - y)), "_depth": depth}).where(F.col("_d") <= radius)
    best = near.agg(F.min("_d").alias("_best"))
    return near.crossJoin(F.broadcast(best)).where(F.col("_d") <= F.col("_best") + slack).orderBy("_depth", "point_id").limit(1).select("point_id", F.col("_d").alias("distance"), F.col("_depth").alias("depth"))


def _key32() -> list[Column]:
    return [F.col(c).cast("float").alias(f"f{c}") for c in XYZ]


def compare_clouds(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: records of both, removed ones, ones that were not there before, and those whose colour changed, by exact 32-bit position.

    Positions that occur more than once count by their least id. Callers reject a result with added > 0.
    """
    keys = ["fx", "fy", "fz"]
    pack = F.min(F.struct("point_id", "r", "g", "b"))
    a = before.select(*_key32(), "point_id", "r", "g", "b").groupBy(*keys).agg(pack.alias("a"), F.count("*").alias("na"))
    b = after.select(*_key32(), "point_id", "r", "g", "b").groupBy(*keys).agg(pack.alias("b"), F.count("*").alias("nb"))
    both = a.join(b, keys, "full_outer")
    changed = (F.col("a.r") != F.col("b.r")) | (F.col("a.g") != F.col("b.g")) | (F.col("a.b") != F.col("b.b"))
    one = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(
        one(F.col("na")).alias("before"), one(F.col("nb")).alias("after"), F.count_if(F.col("nb").isNull()).alias("removed"),
        F.count_if(F.col("na").isNull()).alias("added"), F.count_if(changed).alias("recolored"),
    )


def rgb_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Channel differences of records with one id."""
    a = before.select("point_id", *[F.col(c).alias(f"{c}0") for c in "rgb"])
    b = after.select("point_id", *[F.col(c).alias(f"{c}1") for c in "rgb"])
    return a.join(b, "point_id").select("point_id", *[(F.col(f"{c}1") - F.col(f"{c}0")).alias(f"d{c}") for c in "rgb"])


def rgb_stats(diff: DataFrame) -> DataFrame:
    """Changed records, and mean, 95th percentile and maximum of each channel's change, and the mean distance."""
    moved = (F.col("dr") != 0) | (F.col("dg") != 0) | (F.col("db") != 0)
    p95 = exact_percentiles(diff, {c: (F.abs(f"d{c}"), 0.95) for c in "rgb"})
    stats = [v.alias(f"{n}_{c}") for c in "rgb" for n, v in (("mean", F.avg(F.abs(f"d{c}"))), ("p95", F.lit(p95[c]).cast("double")), ("max", F.max(F.abs(f"d{c}"))))]
    far = F.sqrt(F.col("dr") * F.col("dr") + F.col("dg") * F.col("dg") + F.col("db") * F.col("db"))
    return diff.agg(F.count("*").alias("n"), F.count_if(moved).alias("changed"), *stats, F.avg(far).alias("mean_distance"))


def fuse_models(sfm: DataFrame, lidar: DataFrame, error: float = 0.1) -> DataFrame:
    """All points of both; new ids of the second follow the largest of the first, in its own order, with empty tracks."""
    top = sfm.agg(F.coalesce(F.max("point_id"), F.lit(0)).alias("_top"))
    ranked = dense_rank_by_key(lidar, "point_id", "_rank").crossJoin(F.broadcast(top))
    own = ranked.withColumn("point_id", F.col("_top") + F.col("_rank") + 1).withColumn("error", F.lit(error)).drop("_top", "_rank")
    return sfm.unionByName(own, allowMissingColumns=True)


def set_difference(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return a.select(*keys).exceptAll(b.select(*keys))


def set_intersection(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))
