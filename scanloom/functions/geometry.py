"""Rigid motions, quaternions, projections and map coordinates as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Xyz = tuple[Column, Column, Column]


def col(c: Column | str | float) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(float(c))


def apply_rt(x, y, z, rotation: Sequence, shift: Sequence, scale: float = 1.0) -> Xyz:
    """scale R p + t, with R as nine numbers or columns in row order."""
    p = [col(c) for c in (x, y, z)]
    row = lambda k: (p[0] * col(rotation[3 * k]) + p[1] * col(rotation[3 * k + 1]) + p[2] * col(rotation[3 * k + 2])) * col(scale) + col(shift[k])
    return row(0), row(1), row(2)


def yaw_about(x, y, z, center: Sequence, yaw: float | Column, shift: Sequence = (0.0, 0.0, 0.0)) -> Xyz:
    """Turn by yaw about the vertical through center, then shift."""
    a = col(yaw)
    dx, dy = col(x) - col(center[0]), col(y) - col(center[1])
    return (
        F.cos(a) * dx - F.sin(a) * dy + col(center[0]) + col(shift[0]),
        F.sin(a) * dx + F.cos(a) * dy + col(center[1]) + col(shift[1]),
        col(z) + col(shift[2]),
    )


def quaternion(x, y, z, w) -> Column:
    """A unit quaternion as a struct."""
    x, y, z, w = (col(c) for c in (x, y, z, w))
    n = F.sqrt(x * x + y * y + z * z + w * w)
    return F.struct((x / n).alias("x"), (y / n).alias("y"), (z / n).alias("z"), (w / n).alias("w"))


def quat_mul(a: Column, b: Column) -> Column:
    return F.struct(
        (a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"]).alias("x"),
        (a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"]).alias("y"),
        (a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"]).alias("z"),
        (a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"]).alias("w"),
    )


def quat_inv(q: Column) -> Column:
    return F.struct((-q["x"]).alias("x"), (-q["y"]).alias("y"), (-q["z"]).alias("z"), q["w"].alias("w"))


def quat_matrix(q: Column) -> list[Column]:
    """Nine entries in row order."""
    x, y, z, w = (q[k] for k in "xyzw")
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def quat_rotate(q: Column, x, y, z) -> Xyz:
    return apply_rt(x, y, z, quat_matrix(q), (0.0, 0.0, 0.0))


def quat_angle(q: Column) -> Column:
    """The angle of the rotation."""
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(q["w"])))


def cam_center(q: Column, tx, ty, tz) -> Xyz:
    """-R' t of a world-to-camera pose."""
    x, y, z = quat_rotate(quat_inv(q), tx, ty, tz)
    return -x, -y, -z


def slerp(a: Column, b: Column, u: Column) -> Column:
    """Along the shorter arc; linear and normalised where the ends nearly agree."""
    dot = a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"] + a["w"] * b["w"]
    sign, near = F.when(dot < 0, -1.0).otherwise(1.0), F.abs(dot) > 0.9995
    angle = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    wa = F.when(near, 1 - u).otherwise(F.sin((1 - u) * angle) / F.sin(angle))
    wb = F.when(near, u).otherwise(F.sin(u * angle) / F.sin(angle)) * sign
    return quaternion(*(wa * a[k] + wb * b[k] for k in "xyzw"))


def with_slerp(df: DataFrame, a: Column, b: Column, u: Column, name: str) -> DataFrame:
    """slerp as a column of a table, step by step: each step is a projection of its own, so that no part is written out again for every use.

    Of ends half a turn apart both arcs are equally short; the sign of the product of the quaternions as they are given decides, so
    that lengths, which are 1 but for rounding, have no say in it.
    """
    unit = lambda c: F.struct(*[(F.col(f"{c}.{k}") / F.sqrt(sum((F.col(f"{c}.{j}") * F.col(f"{c}.{j}") for j in "xyzw"), F.lit(0.0)))).alias(k) for k in "xyzw"])
    dot = sum((F.col(f"_sa.{k}") * F.col(f"_sb.{k}") for k in "xyzw"), F.lit(0.0))
    out = df.withColumns({"_sa": a, "_sb": b, "_su": u})
    out = out.withColumns({"_sa": unit("_sa"), "_sb": unit("_sb"), "_given": dot})
    out = out.withColumn("_dot", dot)
    out = out.withColumn("_angle", F.acos(F.least(F.abs("_dot"), F.lit(1.0))))
    near, sign, v = F.abs("_dot") > 0.9995, F.when(F.col("_given") < 0, -1.0).otherwise(1.0), F.col("_su")
    wa = F.when(near, 1 - v).otherwise(F.sin((1 - v) * F.col("_angle")) / F.sin("_angle"))
    wb = F.when(near, v).otherwise(F.sin(v * F.col("_angle")) / F.sin("_angle")) * sign
    out = out.withColumns({"_wa": wa, "_wb": wb})
    out = out.withColumn("_raw", F.struct(*[(F.col("_wa") * F.col(f"_sa.{k}") + F.col("_wb") * F.col(f"_sb.{k}")).alias(k) for k in "xyzw"]))
    return out.withColumn(name, unit("_raw")).drop("_sa", "_sb", "_su", "_given", "_dot", "_angle", "_wa", "_wb", "_raw")


def distance(a: Xyz, b: Xyz) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0)))


def angle(a: Xyz, corner: Xyz, b: Xyz) -> Column:
    """Degrees at the corner; null where an arm has no length."""
    u, v = ([p - c for p, c in zip(s, corner, strict=True)] for s in (a, b))
    dot = sum((p * q for p, q in zip(u, v, strict=True)), F.lit(0.0))
    n = distance(a, corner) * distance(b, corner)
    return F.when(n > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / n)))))


def project_ortho(x, y, z, matrix: Sequence, width: float, height: float) -> tuple[Column, Column, Column]:
    """Pixel and depth by the first three rows of a view-projection matrix in row order, without a perspective divide."""
    p = [col(c) for c in (x, y, z)]
    row = lambda k: sum((p[i] * matrix[4 * k + i] for i in range(3)), F.lit(float(matrix[4 * k + 3])))
    return (row(0) + 1) / 2 * width, (1 - row(1)) / 2 * height, row(2)


def project_equirect(x, y, z, width: float, height: float) -> tuple[Column, Column, Column]:
    """Pixel and range on a full-sphere image; camera axes are right, down, forward."""
    x, y, z = (col(c) for c in (x, y, z))
    d = F.sqrt(x * x + y * y + z * z)
    return (F.atan2(x, z) / (2 * math.pi) + 0.5) * width, (F.asin(y / d) / math.pi + 0.5) * height, d


#: Value of the last parameter under which a layout means a pinhole camera with radial and tangential terms.
PINHOLE_BELOW = -997.0


def project_prism(x, y, z, p: Sequence) -> tuple[Column, Column, Column]:
    """Pixel and range of a thin-prism fisheye with parameters fx fy cx cy k1 k2 p1 p2 k3 k4 sx1 sy1.

    With sy1 below PINHOLE_BELOW the same layout means a pinhole with k1 k2 p1 p2 k3.
    """
    x, y, z = (col(c) for c in (x, y, z))
    fx, fy, cx, cy, k1, k2, p1, p2, k3, k4, sx1, sy1 = (col(c) for c in p)
    r = F.sqrt(x * x + y * y)
    theta = F.atan2(r, z)
    flat = sy1 < PINHOLE_BELOW
    u = F.when(flat, x / z).otherwise(F.when(r > 1e-9, theta * x / r).otherwise(0.0))
    v = F.when(flat, y / z).otherwise(F.when(r > 1e-9, theta * y / r).otherwise(0.0))
    q = u * u + v * v
    radial = k1 * q + k2 * q * q + k3 * q * q * q + F.when(flat, 0.0).otherwise(k4) * q * q * q * q
    du = u * radial + 2 * p1 * u * v + p2 * (q + 2 * u * u) + F.when(flat, 0.0).otherwise(sx1 * q)
    dv = v * radial + 2 * p2 * u * v + p1 * (q + 2 * v * v) + F.when(flat, 0.0).otherwise(sy1 * q)
    return fx * (u + du) + cx, fy * (v + dv) + cy, F.sqrt(x * x + y * y + z * z)


#: Where each camera model's parameters go in the common layout of twelve (fx fy cx cy k1 k2 p1 p2 k3 k4 sx1 sy1).
LAYOUTS = {
    0: (0, 0, 1, 2),
    1: (0, 1, 2, 3),
    2: (0, 0, 1, 2, 3),
    3: (0, 0, 1, 2, 3, 4),
    4: (0, 1, 2, 3, 4, 5, 6, 7),
    5: (0, 1, 2, 3, 4, 5, None, None, 6, 7),
    10: (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11),
}
#: Models of a pinhole; the rest are fisheyes.
PINHOLES = (0, 1, 2, 3, 4)


def camera_params12(model: Column, params: Column) -> Column:
    """The common layout of any known model's parameters; null for others."""
    out = F.lit(None).cast("array<double>")
    for number, places in LAYOUTS.items():
        own = [F.lit(0.0) if k is None else F.get(params, F.lit(k)).cast("double") for k in (*places, *[None] * (12 - len(places)))]
        if number in PINHOLES:
            own[11] = F.lit(-999.0)
        out = F.when(model == number, F.array(*own)).otherwise(out)
    return out


def heading(fx, fy) -> Column:
    """Degrees of a forward axis, 0 north, clockwise."""
    return F.pmod(F.degrees(F.atan2(col(fx), col(fy))) + 360.0, F.lit(360.0))


def beam_cov(x, y, z, range_err: float, beam_deg: float) -> list[Column]:
    """xx xy xz yy yz zz of a return's covariance: range error along the beam, angle error across it."""
    p = [col(c) for c in (x, y, z)]
    d2 = p[0] * p[0] + p[1] * p[1] + p[2] * p[2]
    across = math.sin(math.radians(beam_deg)) ** 2
    entry = lambda i, j: p[i] * p[j] / d2 * range_err**2 + ((d2 if i == j else 0.0) - p[i] * p[j]) * across
    return [entry(i, j) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]


# Map coordinates

#: Semi-major axis and flattening by ellipsoid.
ELLIPSOIDS = {"GRS80": (6378137.0, 1 / 298.257222101), "WGS84": (6378137.0, 1 / 298.257223563)}
#: The box (south, north, west, east) in which SIRGAS 2000 zones are preferred.
SIRGAS_BOX = (-60.0, 15.0, -90.0, -30.0)


def utm_zone(lon) -> Column:
    return ((col(lon) + 180) / 6).cast("int") + 1


def utm_epsg(lat, lon, prefer_sirgas: bool = True) -> Column:
    """EPSG code of the zone; no exceptions for Norway or Svalbard, and 61 at a longitude of 180."""
    lat, lon = col(lat), col(lon)
    world = F.when(lat < 0, 32700).otherwise(32600) + utm_zone(lon)
    if not prefer_sirgas:
        return world
    south, north, west, east = SIRGAS_BOX
    inside = lat.between(south, north) & lon.between(west, east)
    return F.when(inside & (lat < 0), 31960 + utm_zone(lon)).when(inside, 31954 + utm_zone(lon)).otherwise(world)


def _kruger(f: float) -> tuple[float, list[float], list[float], list[float]]:
    n = f / (2 - f)
    scale = (1 + n**2 / 4 + n**4 / 64 + n**6 / 256) / (1 + n)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]
    return scale, alpha, beta, delta


def to_utm(lat, lon, zone: Column | int, south: Column | bool, ellipsoid: str = "WGS84") -> tuple[Column, Column]:
    """Easting and northing in metres by Krüger's series."""
    a, f = ELLIPSOIDS[ellipsoid]
    scale, alpha, _, _ = _kruger(f)
    e = math.sqrt(f * (2 - f))
    zone = zone if isinstance(zone, Column) else F.lit(zone)
    south = south if isinstance(south, Column) else F.lit(south)
    phi, lam = F.radians(col(lat)), F.radians(col(lon) - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * a * scale * east, 0.9996 * a * scale * north + F.when(south, 1e7).otherwise(0.0)


def from_utm(east, north, zone: Column | int, south: Column | bool, ellipsoid: str = "WGS84") -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    a, f = ELLIPSOIDS[ellipsoid]
    scale, _, beta, delta = _kruger(f)
    zone = zone if isinstance(zone, Column) else F.lit(zone)
    south = south if isinstance(south, Column) else F.lit(south)
    xi = (col(north) - F.when(south, 1e7).otherwise(0.0)) / (0.9996 * a * scale)
    eta = (col(east) - 500000) / (0.9996 * a * scale)
    x, y = xi, eta
    for j, c in enumerate(beta, 1):
        x = x - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))  # conformal latitude
    phi = chi
    for j, c in enumerate(delta, 1):
        phi = phi + c * F.sin(2 * j * chi)
    return F.degrees(phi), F.degrees(F.atan2(F.sinh(y), F.cos(x))) + zone * 6 - 183


def tile_xyz(lat, lon, zoom: int) -> tuple[Column, Column]:
    """Column and row of the web map tile, row 0 in the north."""
    n, phi = 2**zoom, F.radians(col(lat))
    fold = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 1)).cast("long")
    return fold((col(lon) + 180) / 360 * n), fold((1 - F.asinh(F.tan(phi)) / math.pi) / 2 * n)


def tile_bounds(x, y, zoom: int) -> tuple[Column, Column, Column, Column]:
    """South, north, west and east of a tile in degrees."""
    n = 2.0**zoom
    lat = lambda k: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * k / n))))
    return lat(col(y) + 1), lat(col(y)), col(x) / n * 360 - 180, (col(x) + 1) / n * 360 - 180


def move_view(rotation: Column, center: Xyz, world: Sequence[float], shift: Sequence[float], scale: float) -> tuple[Column, Xyz, Xyz]:
    """A view after the world moved by scale R p + t: R_cw R', the new centre, and the new translation."""
    entry = lambda i, j: sum((rotation[3 * i + k] * world[3 * j + k] for k in range(3)), F.lit(0.0))
    turned = [entry(i, j) for i in range(3) for j in range(3)]
    new = apply_rt(*center, world, shift, scale)
    back = apply_rt(*new, turned, (0.0, 0.0, 0.0))
    return F.array(*turned), new, (-back[0], -back[1], -back[2])


def mat_mul(a: Column, b: Column, n: int = 3) -> Column:
    return F.array(*[sum((a[n * i + k] * b[n * k + j] for k in range(n)), F.lit(0.0)) for i in range(n) for j in range(n)])


def mat_transpose(a: Column, n: int = 3) -> Column:
    return F.array(*[a[n * j + i] for i in range(n) for j in range(n)])


def det3(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def valid_rotation(m: Column, tolerance: float = 1e-3) -> Column:
    """Whether nine numbers are finite and a proper rotation."""
    product = mat_mul(mat_transpose(m), m)
    near = F.lit(True)
    for i in range(9):
        near = near & (F.abs(product[i] - (1.0 if i % 4 == 0 else 0.0)) <= tolerance)
    finite = F.forall(m, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (F.size(m) == 9) & finite & near & (det3(m) > 0)
