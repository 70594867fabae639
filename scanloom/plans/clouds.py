"""Queries of the point cloud operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from scanloom.functions import color, geometry as geo
from scanloom.operators import clouds as op
from scanloom.plans.registry import Registry, r, rounded

REG = Registry()
add = REG.add

YAW, SHIFT = 0.35, (500000.0, 9590000.0, 12.5)
C, S = repr(math.cos(YAW)), repr(math.sin(YAW))


def georeferenced(points):
    """Points turned and shifted to map coordinates."""
    x, y, z = geo.apply_rt("x", "y", "z", (math.cos(YAW), -math.sin(YAW), 0, math.sin(YAW), math.cos(YAW), 0, 0, 0, 1), SHIFT)
    return points.withColumns({"x": x, "y": y, "z": z})


_MOVED = f"m AS (SELECT point_id, cloud_id, x * {C} + y * -{S} + z * 0.0E0 + 500000 AS x, x * {S} + y * {C} + z * 0.0E0 + 9590000 AS y, x * 0.0E0 + y * 0.0E0 + z * 1.0E0 + 12.5 AS z, r, g, b, intensity FROM points)"


def flagship(points):
    """Clean points, georeferenced, as the top surface of half-metre cells."""
    return rounded(op.top_surface(georeferenced(op.clean_points(points)), 0.5), "z")


add("flagship_top_surface", lambda t: rounded(op.top_surface(georeferenced(t("points")), 0.5), "z"), f"""
WITH {_MOVED}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM m),
s AS (SELECT *, greatest(0.5, greatest(x1 - x0, y1 - y0) / 16383) AS step FROM e)
SELECT "row", col, {r('top.z', 'z')}, top.r AS r, top.g AS g, top.b AS b FROM (
  SELECT CAST(floor((y1 - y) / step) AS BIGINT) AS "row", CAST(floor((x - x0) / step) AS BIGINT) AS col,
    max(struct_pack(z := z, point_id := point_id, r := r, g := g, b := b)) AS top FROM m, s GROUP BY 1, 2)""", "points")

add("f1_clean_points", lambda t: op.clean_points(t("points").withColumn("x", F.when(F.col("point_id") % 11 == 0, float("nan")).otherwise(F.col("x"))).withColumn("r", F.col("r") / 200.0)).groupBy("cloud_id").agg(F.count("*").alias("n"), F.round(F.sum("r"), 3).alias("sum_r")),
    "SELECT cloud_id, count(*) AS n, round(sum(least(1.0, r / 200.0E0)), 3) AS sum_r FROM points WHERE point_id % 11 <> 0 GROUP BY 1", "points")
add("f2_resolve_color", lambda t: rounded(op.resolve_color(t("points").withColumn("g", F.when(F.col("point_id") % 3 != 0, F.col("g"))).withColumn("rgb", F.when(F.col("point_id") % 6 == 0, F.lit(0x804020)))).select("point_id", "red", "green", "blue"), "red", "green", "blue"),
    f"""WITH p AS (SELECT *, CASE WHEN point_id % 3 <> 0 THEN g END AS g2, CASE WHEN point_id % 6 = 0 THEN 8405024 END AS rgb FROM points),
    m AS (SELECT cloud_id, max(greatest(r, g2, b)) AS tc, max(intensity) AS ti FROM p GROUP BY 1)
    SELECT point_id, {r('r / CASE WHEN tc > 1 THEN 255.0E0 ELSE 1 END', 'red')},
      {r('coalesce(g2 / CASE WHEN tc > 1 THEN 255.0E0 ELSE 1 END, CAST((rgb >> 8) & 255 AS DOUBLE) / 255.0E0, intensity / CASE WHEN ti > 1 THEN 255.0E0 ELSE 1 END, 0.7)', 'green')},
      {r('b / CASE WHEN tc > 1 THEN 255.0E0 ELSE 1 END', 'blue')} FROM p JOIN m USING (cloud_id)""", "points")
add("f3_range_gate", lambda t: op.range_gate(t("points"), 0.2, 32.0, 8.0, 12.0).select("point_id"),
    "SELECT point_id FROM points WHERE x*x + y*y + z*z BETWEEN 0.04 AND 1024 AND x*x + y*y + z*z >= 144 AND abs(z) <= 8", "points")
add("f4_decimate", lambda t: op.decimate(t("points"), 7, "point_id").select("point_id"), "SELECT point_id FROM points WHERE point_id % 7 = 0", "points")
_SCAN = lambda t: t("points").select("point_id", (F.col("point_id") % 40).alias("scan_id"), F.expr("point_id div 64 % 7").alias("line"), F.col("point_id").alias("idx"), (F.col("r") % 64).cast("int").alias("tag"), F.round(F.col("x") / 20).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
add("f6_livox_valid", lambda t: op.livox_valid(_SCAN(t)).select("point_id"),
    """WITH s AS (SELECT point_id, point_id % 40 AS scan_id, (point_id // 64) % 7 AS line, round(x / 20) AS x, r % 64 AS tag FROM points),
    g AS (SELECT *, lag(x) OVER (PARTITION BY scan_id, line ORDER BY point_id) AS px FROM s WHERE (tag & 48) = 16)
    SELECT point_id FROM g WHERE px IS NULL OR abs(x - px) > 1e-7""", "points")
add("f5_normalize_scan", lambda t: rounded(op.normalize_scan(t("points").select("point_id", (F.col("point_id") % 40).alias("scan_id"), (F.col("r") % 150).alias("ring"), F.col("intensity"), F.col("x").alias("time")), "hesai").select("point_id", "intensity", "rel_ms"), "intensity", "rel_ms"),
    f"""WITH s AS (SELECT *, min(x) OVER (PARTITION BY point_id % 40) AS x0 FROM points WHERE r % 150 < 128)
    SELECT point_id, {r('intensity * (1 / 255.0E0)', 'intensity')}, {r('(x - x0) * 1000.0E0', 'rel_ms')} FROM s""", "points")
add("f7_tie_points", lambda t: op.filter_tie_points(t("points").withColumn("error", F.col("intensity") / 100), 2.0, 8.0, 1.5).select("point_id"),
    "SELECT point_id FROM points WHERE z BETWEEN 2 AND 8 AND intensity / 100 <= 1.5", "points")
add("f8_crop_bbox", lambda t: op.crop_bbox(t("points"), (10, 5, 1), (60, 40, 9)).select("point_id"),
    "SELECT point_id FROM points WHERE x BETWEEN 10 AND 60 AND y BETWEEN 5 AND 40 AND z BETWEEN 1 AND 9", "points")
_OBB = f"(abs({C} * (x - 45) + {S} * (y - 25)) <= 20 AND abs(-{S} * (x - 45) + {C} * (y - 25)) <= 8 AND abs(z - 5) <= 3)"
add("f9_clip_obb", lambda t: op.clip_obb(t("points"), (45, 25, 5), (40, 16, 6), YAW).select("point_id"), f"SELECT point_id FROM points WHERE {_OBB}", "points")
add("f9_clip_obb_inverted", lambda t: op.clip_obb(t("points"), (45, 25, 5), (40, 16, 6), YAW, True).select("point_id"), f"SELECT point_id FROM points WHERE NOT {_OBB}", "points")
_EXT = ", ".join(f"(min({c}) + max({c})) / 2 AS c{c}, max({c}) - min({c}) + 2 * greatest(0.2, 0.02 * (max({c}) - min({c}))) AS e{c}" for c in "xyz")
add("f10_default_clip_box", lambda t: rounded(op.default_clip_box(t("points")), *[f"{k}{c}" for k in "ce" for c in "xyz"]),
    f"WITH b AS (SELECT {_EXT} FROM points) SELECT " + ", ".join(r(f"{k}{c}", f"{k}{c}") for k in "ce" for c in "xyz") + " FROM b", "points")
add("f23_crop_percentile", lambda t: op.crop_percentile(t("points"), 1, 99, (0.25, 0.75)).select("point_id"),
    """WITH q AS (SELECT quantile_cont(x, .01) AS x0, quantile_cont(x, .99) AS x1, quantile_cont(y, .01) AS y0, quantile_cont(y, .99) AS y1, quantile_cont(z, .01) AS z0, quantile_cont(z, .99) AS z1 FROM points),
    i AS (SELECT points.* FROM points, q WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1),
    a AS (SELECT avg(x) AS mx, avg(y) AS my, atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2 AS turn FROM i),
    s AS (SELECT i.*, (x - mx) * cos(turn) + (y - my) * sin(turn) AS s FROM i, a), e AS (SELECT min(s) AS lo, max(s) AS hi FROM s)
    SELECT point_id FROM s, e WHERE (s - lo) / (hi - lo) BETWEEN 0.25 AND 0.75""", "points")
_KEYS = "CAST(floor(x / 2.0) AS BIGINT) AS kx, CAST(floor(y / 2.0) AS BIGINT) AS ky, CAST(floor(z / 2.0) AS BIGINT) AS kz"
add("a2_voxel_centroids", lambda t: rounded(op.voxel_centroids(t("points"), 2.0, keys=("cloud_id",)), "x", "y", "z"),
    f"SELECT cloud_id, {_KEYS}, {r('avg(x)', 'x')}, {r('avg(y)', 'y')}, {r('avg(z)', 'z')}, count(*) AS n FROM points GROUP BY cloud_id, 2, 3, 4", "points")
add("a3_first_per_cell", lambda t: op.first_per_cell(t("points"), 2.0), f"SELECT {_KEYS}, min(point_id) AS point_id FROM points GROUP BY 1, 2, 3", "points")
add("a15_top_surface", lambda t: op.top_surface(t("points"), 1.5), """
    WITH e AS (SELECT min(x) AS x0, max(y) AS y1 FROM points)
    SELECT "row", col, top.z AS z, top.r AS r, top.g AS g, top.b AS b FROM (SELECT CAST(floor((y1 - y) / 1.5) AS BIGINT) AS "row", CAST(floor((x - x0) / 1.5) AS BIGINT) AS col,
      max(struct_pack(z := z, point_id := point_id, r := r, g := g, b := b)) AS top FROM points, e GROUP BY 1, 2)""", "points")
_CELLS = """c AS (SELECT CAST(floor(y) AS BIGINT) AS "row", CAST(floor(x) AS BIGINT) AS col, max(z) AS z FROM points GROUP BY 1, 2)"""
add("a16_fill_holes", lambda t: op.fill_holes(t("points").groupBy(F.floor("y").cast("long").alias("row"), F.floor("x").cast("long").alias("col")).agg(F.max("z").alias("z")), 2),
    f"""WITH {_CELLS}, d AS (SELECT i, j FROM range(-2, 3) AS a(i), range(-2, 3) AS b(j) WHERE i * i + j * j BETWEEN 1 AND 4),
    n AS (SELECT "row" + i AS "row", col + j AS col, arg_min(z, struct_pack(d := i * i + j * j, "row" := "row", col := col)) AS z FROM c, d GROUP BY "row" + i, col + j)
    SELECT * FROM c UNION ALL SELECT n."row", n.col, n.z FROM n LEFT JOIN c ON n."row" = c."row" AND n.col = c.col WHERE c.z IS NULL""", "points")
add("a17_height_ramp", lambda t: rounded(op.height_ramp(t("points")).select("point_id", "red", "green", "blue"), "red", "green", "blue"),
    f"""WITH e AS (SELECT min(z) AS lo, max(z) AS hi FROM points), u AS (SELECT point_id, (z - lo) / (hi - lo) AS u FROM points, e)
    SELECT point_id, {r('greatest(0.0, 2 * u - 1)', 'red')}, {r('1 - abs(2 * u - 1)', 'green')}, {r('greatest(0.0, 1 - 2 * u)', 'blue')} FROM u""", "points")
add("a18_extent", lambda t: op.extent(t("points"), "cloud_id"), "SELECT cloud_id, " + ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in "xyz") + ", count(*) AS n FROM points GROUP BY ROLLUP (cloud_id)", "points")
add("a34_sample_even", lambda t: op.sample_even(t("points"), 2.5).select("point_id"),
    """WITH n AS (SELECT count(*) AS n, greatest(1, CAST(floor(count(*) * 2.5 / 100) AS BIGINT)) AS k FROM points),
    i AS (SELECT CAST(floor(a.i * (n - 1) / (k - 1)) AS BIGINT) AS pos FROM n, unnest(range(k)) AS a(i)), p AS (SELECT point_id, row_number() OVER (ORDER BY point_id) - 1 AS pos FROM points)
    SELECT point_id FROM p JOIN i USING (pos)""", "points")
_MIX = "((point_id % 2147483647) * 48271 + 7) % 2147483647"
add("a35_sample_hash", lambda t: op.sample_hash(t("points"), 500, 7).select("point_id"), f"SELECT point_id FROM points ORDER BY {_MIX}, point_id LIMIT 500", "points")
add("a35_split_halves", lambda t: op.split_halves(t("points"), 7).groupBy("split").agg(F.count("*").alias("n"), F.min("point_id").alias("first")),
    f"SELECT CASE WHEN {_MIX} < 1073741823 THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(point_id) AS first FROM points GROUP BY 1", "points")
add("a47_color_range", lambda t: rounded(op.color_range(t("points"), "z"), "low", "high"), f"SELECT {r('quantile_cont(z, 0.005)', 'low')}, {r('quantile_cont(z, 0.995)', 'high')} FROM points", "points")
add("o10_every_nth", lambda t: op.every_nth(t("points"), 13).select("point_id"), "SELECT point_id FROM points WHERE point_id % 13 = 0", "points")
add("o11_record_slice", lambda t: op.record_slice(t("points"), 10**15, 2 * 10**15).select("point_id"), "SELECT point_id FROM points WHERE point_id >= 1000000000000000 AND point_id < 2000000000000000", "points")
add("o12_front_most", lambda t: op.front_most(t("points"), F.floor("z"), F.floor(F.col("x") / 2), F.col("y")),
    """SELECT CAST(floor(z) AS BIGINT) AS "row", CAST(floor(x / 2) AS BIGINT) AS col, p.depth AS depth, p.point_id AS point_id, p.r AS r, p.g AS g, p.b AS b FROM (
    SELECT z, x, min(struct_pack(depth := y, point_id := point_id, r := r, g := g, b := b)) OVER (PARTITION BY floor(z), floor(x / 2)) AS p, point_id FROM points) WHERE p.point_id = point_id""", "points")
add("o5_pick", lambda t: rounded(op.pick(t("points"), 50.0, 25.0, F.col("x"), F.col("y"), F.col("z")), "distance"),
    f"""WITH n AS (SELECT point_id, sqrt((x - 50) * (x - 50) + (y - 25) * (y - 25)) AS d, z FROM points), k AS (SELECT * FROM n WHERE d <= 8)
    SELECT point_id, {r('d', 'distance')}, z AS depth FROM k WHERE d <= (SELECT min(d) FROM k) + 4 ORDER BY z, point_id LIMIT 1""", "points")
add("j15_compare_clouds", lambda t: op.compare_clouds(t("points"), t("points_b").withColumn("z", F.col("z") - F.col("point_id") % 5 / 1000.0)), """
    WITH a AS (SELECT CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, min(row(point_id, r, g, b)) AS a, count(*) AS na FROM points GROUP BY 1, 2, 3),
    q AS (SELECT point_id, x, y, z - (point_id % 5) / 1000.0E0 AS z, r, g, b FROM points_b),
    b AS (SELECT CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, min(row(point_id, r, g, b)) AS b, count(*) AS nb FROM q GROUP BY 1, 2, 3)
    SELECT CAST(sum(na) AS BIGINT) AS before, CAST(sum(nb) AS BIGINT) AS after, count(*) FILTER (nb IS NULL) AS removed, count(*) FILTER (na IS NULL) AS added,
      count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL AND (a[2] <> b[2] OR a[3] <> b[3] OR a[4] <> b[4])) AS recolored FROM a FULL JOIN b USING (x, y, z)""", "points", "points_b")
add("j16_rgb_diff", lambda t: op.rgb_diff(t("points"), t("points_b")), "SELECT point_id, b.r - a.r AS dr, b.g - a.g AS dg, b.b - a.b AS db FROM points AS a JOIN points_b AS b USING (point_id)", "points", "points_b")
_STATS = ", ".join(f"{r(f'avg(abs(d{c}))', f'mean_{c}')}, {r(f'quantile_cont(abs(d{c}), 0.95)', f'p95_{c}')}, max(abs(d{c})) AS max_{c}" for c in "rgb")
add("a50_rgb_stats", lambda t: rounded(op.rgb_stats(op.rgb_diff(t("points"), t("points_b"))), *[f"{k}_{c}" for c in "rgb" for k in ("mean", "p95")], "mean_distance"),
    f"""WITH d AS (SELECT b.r - a.r AS dr, b.g - a.g AS dg, b.b - a.b AS db FROM points AS a JOIN points_b AS b USING (point_id))
    SELECT count(*) AS n, count(*) FILTER (dr <> 0 OR dg <> 0 OR db <> 0) AS changed, {_STATS}, {r('avg(sqrt(dr * dr + dg * dg + db * db))', 'mean_distance')} FROM d""", "points", "points_b")
add("o6_fuse_models", lambda t: op.fuse_models(t("points").where("cloud_id = 'A'").select("point_id", "x", "y", "z"), t("points").where("cloud_id = 'R'").select("point_id", "x", "y", "z")),
    """SELECT point_id, x, y, z, NULL::DOUBLE AS error FROM points WHERE cloud_id = 'A'
    UNION ALL SELECT (SELECT max(point_id) FROM points WHERE cloud_id = 'A') + row_number() OVER (ORDER BY point_id), x, y, z, 0.1 FROM points WHERE cloud_id = 'R'""", "points")
add("o7_set_difference", lambda t: op.set_difference(t("points"), t("points_b"), "point_id"), "SELECT point_id FROM points EXCEPT ALL SELECT point_id FROM points_b", "points", "points_b")
add("o8_set_intersection", lambda t: op.set_intersection(t("points"), t("points_b"), "point_id"), "SELECT point_id FROM points INTERSECT SELECT point_id FROM points_b", "points", "points_b")

# Column functions over points


def _scalars(t):
    p = t("points")
    mx, my, mz = geo.apply_rt("x", "y", "z", (0, -1, 0, 1, 0, 0, 0, 0, 1), (1, 2, 3), 2.0)
    yx, yy, _ = geo.yaw_about("x", "y", "z", (45, 25, 5), YAW, (1, 0, 0))
    u, v, d = geo.project_ortho("x", "y", "z", (0.01, 0, 0, -0.5, 0, 0.02, 0, -0.5, 0, 0, 0.1, 0, 0, 0, 0, 1), 800, 600)
    eu, ev, _ = geo.project_equirect(F.col("x") - 40, F.col("z") - 5, F.col("y"), 4096, 2048)
    return rounded(p.select("point_id", mx.alias("mx"), my.alias("my"), mz.alias("mz"), yx.alias("yx"), yy.alias("yy"), u.alias("u"), v.alias("v"), d.alias("d"), eu.alias("eu"), ev.alias("ev")), "mx", "my", "mz", "yx", "yy", "u", "v", "d", "eu", "ev", digits=5)


add("m1_m2_m10_m11_projections", _scalars, f"""SELECT point_id, {r('2 * -y + 1', 'mx', 5)}, {r('2 * x + 2', 'my', 5)}, {r('2 * z + 3', 'mz', 5)},
    {r(f'{C} * (x - 45) - {S} * (y - 25) + 46', 'yx', 5)}, {r(f'{S} * (x - 45) + {C} * (y - 25) + 25', 'yy', 5)},
    {r('(0.01 * x - 0.5 + 1) / 2 * 800', 'u', 5)}, {r('(1 - (0.02 * y - 0.5)) / 2 * 600', 'v', 5)}, {r('0.1 * z', 'd', 5)},
    {r('(atan2(x - 40, y) / (2 * pi()) + 0.5) * 4096', 'eu', 5)}, {r('(asin((z - 5) / sqrt((x - 40) * (x - 40) + (z - 5) * (z - 5) + y * y)) / pi() + 0.5) * 2048', 'ev', 5)} FROM points""", "points")

_LIN = lambda c: f"CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"


def _colors(t):
    o = t("observations")
    lin = [color.to_linear(c) for c in "rgb"]
    gain = color.apply_gain(lin[0], "radius", (0.1, -0.3, -0.1, 0.05))
    return rounded(o.select("obs", "point_id", lin[0].alias("lr"), color.to_srgb(lin[1]).alias("sg"), gain.alias("gr"), color.view_score("radius", 1.0, F.col("weight") * 3).alias("score"), color.delta_e76(lin, [lin[2], lin[1], lin[0]]).alias("de")), "lr", "sg", "gr", "score", "de", digits=5)


_FX = lambda e: f"(CASE WHEN {e} > 216 / 24389.0E0 THEN pow({e}, 1 / 3.0E0) ELSE (24389 / 27.0E0 * ({e}) + 16) / 116 END)"
_X = lambda a, b, c: _FX(f"((0.4124564E0 * {a} + 0.3575761E0 * {b} + 0.1804375E0 * {c}) / 0.95047E0)")
_Y = lambda a, b, c: _FX(f"(0.2126729E0 * {a} + 0.7151522E0 * {b} + 0.0721750E0 * {c})")
_Z = lambda a, b, c: _FX(f"((0.0193339E0 * {a} + 0.1191920E0 * {b} + 0.9503041E0 * {c}) / 1.08883E0)")
add("m13_m14_m17_m20_photometry", _colors, f"""WITH l AS (SELECT *, {_LIN('r')} AS lr, {_LIN('g')} AS lg, {_LIN('b')} AS lb FROM observations),
    f AS (SELECT *, {_X('lr', 'lg', 'lb')} AS x1, {_Y('lr', 'lg', 'lb')} AS y1, {_Z('lr', 'lg', 'lb')} AS z1, {_X('lb', 'lg', 'lr')} AS x2, {_Y('lb', 'lg', 'lr')} AS y2, {_Z('lb', 'lg', 'lr')} AS z2 FROM l)
    SELECT obs, point_id, {r('lr', 'lr', 5)}, {r('g', 'sg', 5)},
      {r('lr * exp(greatest(-ln(2), least(ln(2), 0.1 - 0.3 * radius ** 2 - 0.1 * radius ** 4 + 0.05 * radius ** 6)))', 'gr', 5)},
      {r('(1 - 0.5 * radius ** 2) / pow(greatest(weight * 3, 0.5), 1.5)', 'score', 5)},
      {r('sqrt((116 * (y1 - y2)) ** 2 + (500 * ((x1 - y1) - (x2 - y2))) ** 2 + (200 * ((y1 - z1) - (y2 - z2))) ** 2)', 'de', 5)} FROM f""", "observations")


def _chroma(t):
    o = t("observations")
    h = (1.02, 0.01, -0.005, 0.0, 0.98, 0.004, 0.02, -0.01)
    a, b, c = color.chroma_h("r", "g", "b", h)
    grid = F.array(*[F.lit(float(k % 7)) for k in range(108)])
    s = color.grid_gain(grid, "r", "radius", "b")
    tr, tg, tb = color.colormap("radius", "turbo")
    return rounded(o.select("obs", "point_id", a.alias("cr"), b.alias("cg"), c.alias("cb"), (a + b + c).alias("total"), s[0].alias("s0"), tr.alias("tr")), "cr", "cg", "cb", "total", "s0", "tr", digits=5)


_GRID = " + ".join(f"({'fu' if k & 1 else '1 - fu'}) * ({'fv' if k & 2 else '1 - fv'}) * ({'fl' if k & 4 else '1 - fl'}) * ((((il + {k >> 2 & 1}) * 3 + iv + {k >> 1 & 1}) * 3 + iu + {k & 1}) * 3 % 7)" for k in range(8))
add("m15_m16_m19_color_models", _chroma, f"""WITH u AS (SELECT *, r / (r + g + b) AS u, g / (r + g + b) AS v, least(floor(r * 2), 1) AS iu, least(floor(radius * 2), 1) AS iv, least(floor(b * 3), 2) AS il FROM observations),
    w AS (SELECT *, 0.02 * u - 0.01 * v + 1 AS w, r * 2 - iu AS fu, radius * 2 - iv AS fv, b * 3 - il AS fl, floor(radius * 255) / 255 AS x FROM u),
    c AS (SELECT *, (1.02 * u + 0.01 * v - 0.005) / w AS nu, (0.98 * v + 0.004) / w AS nv, r + g + b AS t FROM w)
    SELECT obs, point_id, {r('nu * t', 'cr', 5)}, {r('nv * t', 'cg', 5)}, {r('(1 - nu - nv) * t', 'cb', 5)}, {r('t', 'total', 5)}, {r(_GRID, 's0', 5)},
      {r('255 * greatest(0, least(1, 0.13572138 + 4.61539260 * x - 42.66032258 * x ** 2 + 132.13108234 * x ** 3 - 152.94239396 * x ** 4 + 59.28637943 * x ** 5))', 'tr', 5)} FROM c""", "observations")
add("m26_beam_cov", lambda t: rounded(t("points").select("point_id", *[c.alias(n) for c, n in zip(geo.beam_cov("x", "y", "z", 0.02, 0.05), ("xx", "xy", "xz", "yy", "yz", "zz"), strict=True)]), "xx", "xy", "xz", "yy", "yz", "zz", digits=9),
    f"""WITH d AS (SELECT *, x*x + y*y + z*z AS d2, {math.sin(math.radians(0.05)) ** 2!r} AS s FROM points)
    SELECT point_id, {r('x*x/d2*0.0004 + (d2 - x*x)*s', 'xx', 9)}, {r('x*y/d2*0.0004 - x*y*s', 'xy', 9)}, {r('x*z/d2*0.0004 - x*z*s', 'xz', 9)}, {r('y*y/d2*0.0004 + (d2 - y*y)*s', 'yy', 9)}, {r('y*z/d2*0.0004 - y*z*s', 'yz', 9)}, {r('z*z/d2*0.0004 + (d2 - z*z)*s', 'zz', 9)} FROM d""", "points")
