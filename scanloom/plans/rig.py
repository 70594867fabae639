"""Queries of rigs, drift, throttles, tables of places, lookups and SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import color, geometry as geo
from scanloom.operators import rig as op
from scanloom.plans.registry import Registry, r, rounded
from scanloom.sources import capture

REG = Registry()
add = REG.add


def _maps(t):
    out = t("observations").select("obs", "point_id", *[c.alias(f"{n}_{k}") for n in ("heat", "rainbow", "grey") for c, k in zip(color.colormap("radius", n), "rgb", strict=True)])
    return rounded(out, *[f"{n}_{k}" for n in ("heat", "rainbow", "grey") for k in "rgb"], digits=5)


_CLIP = lambda e: f"255 * greatest(0, least(1, {e}))"
add("m19_colormaps", _maps, "WITH v AS (SELECT obs, point_id, floor(radius * 255) / 255 AS x FROM observations) SELECT obs, point_id, "
    + ", ".join(r(_CLIP(e), f"{n}_{k}", 5) for n, parts in (("heat", [f"x * 3 - {k}" for k in range(3)]), ("rainbow", [f"1.5 - abs(x * 4 - {k})" for k in (3, 2, 1)]), ("grey", ["x"] * 3)) for e, k in zip(parts, "rgb", strict=True)) + " FROM v", "observations")
add("f18_reproj_gate", lambda t: t("features").select("image_id", "idx", op.reproj_gate("u", "v", F.col("u") + F.col("idx") % 4, F.col("v") + F.col("point_id") % 3, F.col("idx") - 2, F.col("u") / 500).alias("ok")),
    "SELECT image_id, idx, sqrt((idx % 4) ** 2 + (point_id % 3) ** 2) <= 2 AND idx - 2 > 0 AND u / 500 < 0.98 AS ok FROM features", "features")
add("x2_map_lookup", lambda t: t("frames").select("event_id", capture.map_lookup(F.create_map(F.lit("cam0"), F.lit(1.5)), "camera", 2.5).alias("offset")),
    "SELECT event_id, CASE WHEN camera = 'cam0' THEN 1.5::DOUBLE ELSE 2.5::DOUBLE END AS \"offset\" FROM frames", "frames")
add("u4_chunk_bounds", lambda t: t("trajectory").groupBy("session").agg((F.max("t") - F.min("t")).alias("total")).select("session", F.inline(op.chunk_bounds("total", 300000.0, 30000.0))).withColumn("chunk", F.col("chunk").cast("long")),
    """WITH e AS (SELECT session, max(t) - min(t) AS total FROM trajectory GROUP BY 1), c AS (SELECT *, unnest(range(CAST(greatest(0, ceil((total - 300000) / 270000)) AS BIGINT) + 1)) AS chunk FROM e)
    SELECT session, chunk, chunk * 270000.0::DOUBLE AS "start", least(chunk * 270000.0::DOUBLE + 300000, total) AS "end" FROM c""", "trajectory")
add("u4_neighbours27", lambda t: t("points").select(*[F.floor(F.col(c) / 5).cast("long").alias(f"k{c}") for c in "xyz"]).distinct().select(F.inline(op.neighbours27())).groupBy("kx", "ky", "kz").agg(F.count("*").alias("n")),
    """WITH c AS (SELECT DISTINCT CAST(floor(x / 5) AS BIGINT) AS kx, CAST(floor(y / 5) AS BIGINT) AS ky, CAST(floor(z / 5) AS BIGINT) AS kz FROM points)
    SELECT kx + i AS kx, ky + j AS ky, kz + k AS kz, count(*) AS n FROM c, range(-1, 2) AS a(i), range(-1, 2) AS b(j), range(-1, 2) AS d(k) GROUP BY 1, 2, 3""", "points")
add("u4_tiles", lambda t: t("gps").groupBy("session").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d")).select("session", F.inline(op.tiles("a", "b", "c", "d", 18))),
    """WITH e AS (SELECT session, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM gps GROUP BY 1),
    x AS (SELECT session, unnest(range(CAST(floor((c + 180) / 360 * 262144) AS BIGINT), CAST(floor((d + 180) / 360 * 262144) AS BIGINT) + 1)) AS x FROM e),
    y AS (SELECT session, unnest(range(CAST(floor((1 - asinh(tan(radians(b))) / pi()) / 2 * 262144) AS BIGINT), CAST(floor((1 - asinh(tan(radians(a))) / pi()) / 2 * 262144) AS BIGINT) + 1)) AS y FROM e)
    SELECT session, x, y FROM x JOIN y USING (session)""", "gps")
add("w17_throttle", lambda t: op.throttle(t("trajectory").select("session", "t"), 0.1, ("session",)).groupBy("session").agg(F.count("*").alias("n"), F.max("t").alias("last")),
    """WITH RECURSIVE k AS (SELECT session, min(t) AS t FROM trajectory GROUP BY 1 UNION ALL SELECT session, t FROM (SELECT k.session, (SELECT min(j.t) FROM trajectory AS j WHERE j.session = k.session AND j.t - k.t >= 10) AS t FROM k) WHERE t IS NOT NULL)
    SELECT session, count(*) AS n, max(t) AS last FROM k GROUP BY 1""", "trajectory")


def _matched(t):
    some = t("trajectory").where("CAST(floor(t) AS BIGINT) % 5 = 0 AND session <> 3")
    return some.select("session", "t", *[(F.col(f"p{c}") + k).alias(f"m{c}") for k, c in ((1, "x"), (2, "y"), (-1, "z"))], *[F.col(f"q{k}").alias(f"mq{k}") for k in "xyzw"])


def _drift(t):
    deltas = t("trajectory").where("CAST(floor(t) AS BIGINT) % 5 = 0 AND session <> 3").select("session", "t", *[F.lit(v).alias(c) for c, v in zip(("px", "py", "pz", "qx", "qy", "qz", "qw"), (1.0, 2.0, -1.0, 0.0, 0.0, 0.0, 1.0), strict=True)])
    return rounded(op.drift_correct(t("trajectory"), deltas).select("session", "t", "px", "py", "pz", "qw"), "px", "py", "pz", "qw", digits=5)


add("j23_pose_deltas", lambda t: rounded(op.pose_deltas(_matched(t), t("trajectory")).select("session", "t", "px", "py", "pz", "qw"), "px", "py", "pz", "qw", digits=5),
    "SELECT session, t, 1.0::DOUBLE AS px, 2.0::DOUBLE AS py, -1.0::DOUBLE AS pz, 1.0::DOUBLE AS qw FROM trajectory WHERE CAST(floor(t) AS BIGINT) % 5 = 0 AND session <> 3", "trajectory")
add("j23_drift_correct", _drift,
    f"""WITH d AS (SELECT session FROM trajectory WHERE CAST(floor(t) AS BIGINT) % 5 = 0 AND session <> 3 GROUP BY 1 HAVING count(*) >= 2), p AS (SELECT *, CASE WHEN session IN (SELECT session FROM d) THEN 1 ELSE 0 END AS moved FROM trajectory)
    SELECT session, t, {r('px + moved', 'px', 5)}, {r('py + 2 * moved', 'py', 5)}, {r('pz - moved', 'pz', 5)}, {r('qw', 'qw', 5)} FROM p""", "trajectory")


def _mounts(t):
    poses = t("trajectory").withColumn("camera", F.concat(F.lit("cam"), (F.floor("t").cast("long") % 2).cast("string")))
    front = F.col("camera") == "cam0"
    q = F.struct(*[F.col(f"q{k}").alias(k) for k in "xyzw"])
    x, y, z = geo.quat_rotate(F.col("_q"), F.when(front, 0.1).otherwise(0.05), F.when(front, 0.0).otherwise(-0.02), F.lit(0.12))
    mount = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.when(front, 0.6).otherwise(0.8).alias("z"), F.when(front, 0.8).otherwise(-0.6).alias("w"))
    posed = poses.withColumn("_q", q).withColumn("_r", geo.quat_mul(F.col("_q"), mount))
    images = posed.select("session", "t", "camera", (F.col("px") + x).alias("cx"), (F.col("py") + y).alias("cy"), (F.col("pz") + z).alias("cz"), *[F.col(f"_r.{k}").alias(f"iq{k}") for k in "xyzw"])
    return op.lens_mounts(images, t("trajectory"))


add("a29_lens_mounts", lambda t: rounded(_mounts(t).select("camera", "n", "tx", "ty", "tz", "qz", "qw"), "tx", "ty", "tz", "qz", "qw", digits=5).withColumns({"qz": F.abs("qz"), "qw": F.abs("qw")}),
    f"""SELECT 'cam' || CAST(CAST(floor(t) AS BIGINT) % 2 AS VARCHAR) AS camera, count(*) AS n, {r('any_value(CASE WHEN CAST(floor(t) AS BIGINT) % 2 = 0 THEN 0.1 ELSE 0.05 END)', 'tx', 5)},
      {r('any_value(CASE WHEN CAST(floor(t) AS BIGINT) % 2 = 0 THEN 0.0 ELSE -0.02 END)', 'ty', 5)}, {r('any_value(0.12::DOUBLE)', 'tz', 5)},
      {r('any_value(CASE WHEN CAST(floor(t) AS BIGINT) % 2 = 0 THEN 0.6 ELSE 0.8 END)', 'qz', 5)}, {r('any_value(CASE WHEN CAST(floor(t) AS BIGINT) % 2 = 0 THEN 0.8 ELSE 0.6 END)', 'qw', 5)} FROM trajectory GROUP BY 1""", "trajectory")


def _sql_functions(t):
    points = t("points")
    op.register_functions(points.sparkSession)
    return rounded(points.select("point_id", F.expr("voxel_key(x, 2.5D)").alias("k"), F.expr("srgb_to_linear(r / 255D)").alias("lin"), F.expr("linear_to_srgb(g / 255D)").alias("srgb"), F.expr("CAST(utm_zone(y * 3.5D) AS BIGINT)").alias("zone"), F.expr("tile_x(y, 12)").alias("tx"), F.expr("tile_y(z, 12)").alias("ty")), "lin", "srgb", digits=5)


add("u1_sql_functions", _sql_functions,
    f"""SELECT point_id, CAST(floor(x / 2.5) AS BIGINT) AS k, {r('CASE WHEN r / 255.0 <= 0.04045 THEN r / 255.0 / 12.92 ELSE pow((r / 255.0 + 0.055) / 1.055, 2.4) END', 'lin', 5)},
      {r('CASE WHEN g / 255.0 <= 0.0031308 THEN g / 255.0 * 12.92 ELSE 1.055 * pow(g / 255.0, 1 / 2.4) - 0.055 END', 'srgb', 5)}, CAST(least(60, floor((y * 3.5 + 180) / 6) + 1) AS BIGINT) AS zone,
      CAST(floor((y + 180) / 360 * 4096) AS BIGINT) AS tx, CAST(floor((1 - asinh(tan(radians(z))) / pi()) / 2 * 4096) AS BIGINT) AS ty FROM points""", "points")
