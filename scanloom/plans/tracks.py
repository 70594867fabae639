"""Queries of the operators on time series: poses, frames, messages, scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import geometry as geo, naming
from scanloom.operators import scanlines, tracks as op
from scanloom.plans.registry import Registry, r, rounded

REG = Registry()
add = REG.add

add("a1_summarize_log", lambda t: rounded(op.summarize_log(t("messages")), "seconds"),
    f"SELECT topic, msgtype, count(*) AS n, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, {r('(max(ts_ns) - min(ts_ns)) / 1e9', 'seconds')} FROM messages GROUP BY 1, 2", "messages")
_T0 = 1704067200
add("f11_slice_messages", lambda t: op.slice_messages(t("messages"), 86400.5, 200000.25, _T0 * 10**9).select("event_id"),
    f"SELECT event_id FROM messages WHERE ts_ns BETWEEN {_T0}000000000 + 86400500000000 AND {_T0}000000000 + 200000250000000", "messages")
add("f12_trim_synchronized", lambda t: (lambda a: a[0].select("session", "t").withColumn("log", F.lit("lidar")).unionByName(a[1].select("session", "t").withColumn("log", F.lit("video"))))(op.trim_synchronized(t("trajectory"), t("frames"), _T0 + 5e5, _T0 + 9e5, -1000.0)),
    f"SELECT session, t, 'lidar' AS log FROM trajectory WHERE t BETWEEN {_T0 + 5e5} AND {_T0 + 9e5} UNION ALL SELECT session, t, 'video' FROM frames WHERE t BETWEEN {_T0 + 5e5 - 1000} AND {_T0 + 9e5 - 1000}", "trajectory", "frames")
add("f21_detect_topics", lambda t: op.detect_topics(op.summarize_log(t("messages")), {"pose": (("view", ".*"), ("msg/", "^c")), "clock": (("^msg/e", ".*"), ("msg/", ".*"))}).select("role", "topic", "n"),
    """WITH s AS (SELECT topic, count(*) AS n FROM messages GROUP BY 1), c AS (
      SELECT 'pose' AS role, topic, n, CASE WHEN topic = 'view' THEN 0 WHEN topic LIKE 'c%' THEN 1 END AS k FROM s
      UNION ALL SELECT 'clock', topic, n, CASE WHEN topic LIKE 'e%' THEN 0 ELSE 1 END FROM s)
    SELECT role, topic, n FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY k, n DESC, topic) AS q FROM c WHERE k IS NOT NULL) WHERE q = 1""", "messages")
add("j14_merge_logs", lambda t: op.merge_logs(t("messages").where("topic = 'view'"), t("messages").where("topic = 'click'")).select("event_id", "source", "ts_ns"),
    "SELECT event_id, CASE WHEN topic = 'view' THEN 0 ELSE 1 END AS source, ts_ns FROM messages WHERE topic IN ('view', 'click') ORDER BY ts_ns, source", "messages")
add("o2_time_order", lambda t: op.time_order(t("frames"), "camera", "name").select("t", "camera", "name"), "SELECT t, camera, name FROM frames ORDER BY t, camera, name", "frames")
add("w2_step_stats", lambda t: rounded(op.step_stats(t("trajectory")).select("session", "t", "dt", "step", "speed"), "dt", "step", "speed"),
    f"""WITH s AS (SELECT *, t - lag(t) OVER w AS d, sqrt(pow(px - lag(px) OVER w, 2) + pow(py - lag(py) OVER w, 2) + pow(pz - lag(pz) OVER w, 2)) AS l FROM trajectory WINDOW w AS (PARTITION BY session ORDER BY t))
    SELECT session, t, {r('d', 'dt')}, {r('l', 'step')}, {r('CASE WHEN d > 0 THEN l / d END', 'speed')} FROM s""", "trajectory")
add("w3_assert_increasing", lambda t: op.assert_increasing(t("trajectory").withColumns({"ord": F.col("t"), "t": F.floor(F.col("t") / 3600)}), ["session"]).groupBy("session").agg(F.count("*").alias("n")),
    "SELECT session, count(*) AS n FROM (SELECT session, floor(t / 3600) AS h, lag(floor(t / 3600)) OVER (PARTITION BY session ORDER BY t) AS b FROM trajectory) WHERE h <= b GROUP BY 1", "trajectory")
_RANGES = "rg AS (SELECT session, t, CAST(coalesce(sum(c) OVER (PARTITION BY session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS point_start, CAST(c AS BIGINT) AS point_count FROM (SELECT session, t, CAST(floor(sharpness) AS BIGINT) % 40 AS c FROM frames))"


def ranges(t):
    from pyspark.sql import Window

    f = t("frames").withColumn("point_count", F.floor("sharpness").cast("long") % 40)
    start = F.coalesce(F.sum("point_count").over(Window.partitionBy("session").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return f.select("session", "t", start.alias("point_start"), "point_count")


add("w4_assert_contiguous", lambda t: op.assert_contiguous(ranges(t).withColumn("point_start", F.when(F.col("point_count") == 7, F.col("point_start") + 1).otherwise(F.col("point_start")))).select("session", "t", "expected"),
    f"WITH {_RANGES} SELECT session, t, point_start AS expected FROM rg WHERE point_count = 7", "frames")
add("w5_sharpest_per_bucket", lambda t: op.sharpest_per_bucket(t("frames"), 1 / 7200, 3).select("session", "bucket", "name"),
    """WITH b AS (SELECT *, CAST(floor(greatest(0, t) * (1 / 7200.0E0) + 1e-7) AS BIGINT) AS bucket FROM frames),
    e AS (SELECT *, row_number() OVER (PARTITION BY session, bucket ORDER BY t, name) AS k FROM b),
    s AS (SELECT *, row_number() OVER (PARTITION BY session, bucket ORDER BY sharpness DESC, t, name) AS q FROM e WHERE k <= 3)
    SELECT session, bucket, name FROM s WHERE q = 1""", "frames")
add("w6_motion_onset", lambda t: op.motion_onset(t("trajectory"), 60.0, 20000.0),
    """WITH f AS (SELECT session, t, sqrt(pow(px - first(px) OVER w, 2) + pow(py - first(py) OVER w, 2) + pow(pz - first(pz) OVER w, 2)) AS far FROM trajectory WINDOW w AS (PARTITION BY session ORDER BY t)),
    m AS (SELECT *, min(far) OVER (PARTITION BY session ORDER BY t RANGE BETWEEN CURRENT ROW AND 20000 FOLLOWING) AS least FROM f)
    SELECT session, coalesce(min(t) FILTER (far >= 60 AND least >= 45), min(t)) AS onset, count(*) FILTER (far >= 60 AND least >= 45) > 0 AS moving FROM m GROUP BY 1""", "trajectory")
add("w7_max_overlap", lambda t: op.max_overlap(t("trajectory"), 36000.0), "SELECT session, max(n) AS most FROM (SELECT session, count(*) OVER (PARTITION BY session ORDER BY t RANGE BETWEEN CURRENT ROW AND 36000 FOLLOWING) AS n FROM trajectory) GROUP BY 1", "trajectory")
add("w9_cyclic_pairs", lambda t: op.cyclic_pairs(t("observations").select("point_id", "frame_id", "obs")).select("point_id", F.col("a.obs").alias("a"), F.col("b.obs").alias("b")),
    """SELECT point_id, obs AS a, coalesce(lead(obs) OVER w, first_value(obs) OVER w) AS b FROM observations
    WINDOW w AS (PARTITION BY point_id ORDER BY frame_id, obs) QUALIFY count(*) OVER (PARTITION BY point_id) > 1""", "observations")
_CHUNK = "CAST(greatest(0, ceil((pos - 300000) / 270000.0E0)) AS BIGINT)"
add("w11_overlap_chunks", lambda t: op.overlap_chunks(t("trajectory"), 300000.0, 30000.0).groupBy("session", "chunk", "name").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1")),
    f"""WITH e AS (SELECT session, min(t) AS t0, max(t) AS t1 FROM trajectory GROUP BY 1), r AS (SELECT tr.session, tr.t, tr.t - t0 AS pos, greatest(0, ceil((t1 - t0 - 300000) / 270000.0E0)) AS last FROM trajectory AS tr JOIN e USING (session)),
    c AS (SELECT session, t, unnest(generate_series({_CHUNK}, CAST(least(last, floor(pos / 270000)) AS BIGINT))) AS chunk FROM r)
    SELECT session, chunk, printf('chunk_%02d', chunk) AS name, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM c GROUP BY 1, 2, 3""", "trajectory")
add("w12_bounded_clip", lambda t: op.bounded_clip(t("frames"), 11, _T0 + 1.2e6).select("session", "name"),
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, name) - 1 AS k, count(*) OVER (PARTITION BY session) AS n FROM frames),
    m AS (SELECT session, arg_min(k, row(abs(t - {_T0 + 1.2e6}), k)) AS m FROM k GROUP BY 1)
    SELECT session, name FROM k JOIN m USING (session) WHERE k >= greatest(0, least(m - 5, n - 11)) AND k < greatest(0, least(m - 5, n - 11)) + 11""", "frames")
_SCAN = "sc AS (SELECT point_id, point_id % 40 AS scan_id, (point_id // 64) % 5 AS ring, point_id AS idx, x - 45 AS x, y - 25 AS y, z FROM points)"


def scan(t):
    return t("points").select("point_id", (F.col("point_id") % 40).alias("scan_id"), F.expr("point_id div 64 % 5").alias("ring"), F.col("point_id").alias("idx"), (F.col("x") - 45).alias("x"), (F.col("y") - 25).alias("y"), "z")


add("w13_line_diffs", lambda t: rounded(op.line_diffs(scan(t)).select("point_id", "range", "d2_next"), "range", "d2_next"),
    f"WITH {_SCAN} SELECT point_id, {r('sqrt(x * x + y * y)', 'range')}, {r('pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2) + pow(lead(z) OVER w - z, 2)', 'd2_next')} FROM sc WINDOW w AS (PARTITION BY scan_id, ring ORDER BY idx)", "points")
# Times are rounded within their turn: a sum of many turns lies so close to the edges of rounding that engines differ.
add("w14_ring_times", lambda t: rounded(op.ring_times(scan(t)), "turn_ms", digits=4).select("point_id", (F.col("turn_ms") + F.col("turn") * 360 / 3.61).alias("rel_ms")),
    f"""WITH {_SCAN}, d AS (SELECT *, first(degrees(atan2(y, x))) OVER (PARTITION BY scan_id, ring ORDER BY idx) - degrees(atan2(y, x)) AS d FROM sc),
    m AS (SELECT *, CASE WHEN d >= 0 THEN d / 3.61 ELSE (d + 360) / 3.61 END AS ms FROM d), w AS (SELECT *, CASE WHEN ms < lag(ms) OVER (PARTITION BY scan_id, ring ORDER BY idx) THEN 1 ELSE 0 END AS w FROM m)
    , v AS (SELECT point_id, {r('ms', 'ms', 4)}, sum(w) OVER (PARTITION BY scan_id, ring ORDER BY idx) AS turn FROM w)
    SELECT point_id, ms + turn * 360 / 3.61E0 AS rel_ms FROM v""", "points")
add("w16_running_valid", lambda t: op.running_valid(scan(t).withColumn("valid", F.col("x") > 0), 5).select("point_id"),
    f"WITH {_SCAN}, c AS (SELECT point_id, x, sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id ORDER BY idx) AS n FROM sc) SELECT point_id FROM c WHERE x > 0 AND n % 5 = 0", "points")


def lines(t):
    """The points of 160 orders in a row (some 640) as a line, so that more points are more lines."""
    order = F.expr("point_id div 1024000000000")
    return t("points").select("point_id", F.floor(order / 800).alias("scan_id"), (F.floor(order / 160) % 5).alias("ring"), F.col("point_id").alias("idx"), (F.col("x") - 45).alias("x"), (F.col("y") - 25).alias("y"), "z")


add("w18_line_features", lambda t: scanlines.line_features(lines(t), 4.0).select("point_id", "feature"))
add("w18_thin_surfaces", lambda t: rounded(scanlines.thin_surfaces(scanlines.line_features(lines(t), 4.0)).select("idx", "n", "x", "y"), "x", "y", digits=5))
_IDS = "pt AS (SELECT user_id % 10 AS session, event_id % 1500 AS point_id, event_id, value AS x FROM events)"


def id_points(t):
    return t("events").select((F.col("user_id") % 10).alias("session"), (F.col("event_id") % 1500).alias("point_id"), "event_id", F.col("value").alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"))


add("j3_points_with_scan", lambda t: op.points_with_scan(id_points(t), ranges(t)).select("session", "event_id", "t"),
    f"WITH {_RANGES}, {_IDS} SELECT pt.session, event_id, t FROM pt JOIN rg ON pt.session = rg.session AND pt.point_id >= point_start AND pt.point_id < point_start + point_count", "frames")
add("w10_submaps", lambda t: rounded(op.submaps(id_points(t), ranges(t), 50000.0, 20).select("session", "node", "t0", "t1", "n", "x", "t"), "x", "t", digits=3),
    f"""WITH {_RANGES}, {_IDS}, j AS (SELECT pt.session, x, t FROM pt JOIN rg ON pt.session = rg.session AND pt.point_id >= point_start AND pt.point_id < point_start + point_count),
    f AS (SELECT session, min(t) AS f FROM rg GROUP BY 1), g AS (SELECT session, CAST(floor((t - f) / 50000) AS BIGINT) AS node, min(t) AS t0, max(t) AS t1, count(*) AS n, avg(x) AS x FROM j JOIN f USING (session) GROUP BY 1, 2)
    SELECT session, node, t0, t1, n, {r('x', 'x', 3)}, {r('(t0 + t1) / 2', 't', 3)} FROM g WHERE n >= 20""", "frames")
_ASOF = """pose AS (SELECT * FROM trajectory QUALIFY row_number() OVER (PARTITION BY session, t ORDER BY px NULLS FIRST, py, pz, qx, qy, qz, qw) = 1),
    lo AS (SELECT f.session, f.name, f.t, a.t AS ta, a.px AS ax, a.qz AS az, a.qw AS aw FROM frames AS f ASOF JOIN pose AS a ON f.session = a.session AND f.t >= a.t),
    hi AS (SELECT lo.*, b.t AS tb, b.px AS bx, b.qz AS bz, b.qw AS bw FROM lo ASOF JOIN pose AS b ON lo.session = b.session AND lo.t <= b.t),
    u AS (SELECT *, CASE WHEN tb > ta THEN (t - ta) / (tb - ta) ELSE 0 END AS u, az * bz + aw * bw AS dot FROM hi),
    w AS (SELECT *, acos(least(abs(dot), 1.0)) AS an, CASE WHEN dot < 0 THEN -1 ELSE 1 END AS sg FROM u),
    s AS (SELECT *, CASE WHEN abs(dot) > 0.9995 THEN 1 - u ELSE sin((1 - u) * an) / sin(an) END AS wa, CASE WHEN abs(dot) > 0.9995 THEN u ELSE sin(u * an) / sin(an) END * sg AS wb FROM w),
    q AS (SELECT *, wa * az + wb * bz AS z0, wa * aw + wb * bw AS w0 FROM s)"""
add("j1_m4_asof_interpolate", lambda t: rounded(op.asof_interpolate(t("frames"), t("trajectory")).select("session", "name", "px", "qz", "qw", "alpha"), "px", "qz", "qw", "alpha"),
    f"WITH {_ASOF} SELECT session, name, {r('ax + (bx - ax) * u', 'px')}, {r('z0 / sqrt(z0 * z0 + w0 * w0)', 'qz')}, {r('w0 / sqrt(z0 * z0 + w0 * w0)', 'qw')}, {r('u', 'alpha')} FROM q", "frames", "trajectory")
add("j1_asof_clipped", lambda t: op.asof_interpolate(t("frames"), t("trajectory"), "clip").groupBy("session", "valid").agg(F.count("*").alias("n")),
    "WITH e AS (SELECT session, min(t) AS a, max(t) AS b FROM trajectory GROUP BY 1) SELECT session, t BETWEEN a AND b AS valid, count(*) AS n FROM frames JOIN e USING (session) GROUP BY 1, 2", "frames", "trajectory")
add("j4_knot_weights", lambda t: rounded(op.knot_weights(t("frames"), t("trajectory")).select("session", "name", "knot0", "knot1", "alpha"), "alpha"),
    f"WITH {_ASOF} SELECT session, name, ta AS knot0, tb AS knot1, {r('(t - ta) / (tb - ta)', 'alpha')} FROM q WHERE tb > ta", "frames", "trajectory")
add("j20_nearest_frame", lambda t: op.nearest_frame(t("trajectory").select("session", "t"), t("frames")).select("session", "t", "frame"),
    """WITH lo AS (SELECT p.session, p.t, f.t AS fa, f.name AS na FROM trajectory AS p ASOF LEFT JOIN frames AS f ON p.session = f.session AND p.t >= f.t),
    hi AS (SELECT lo.*, f.t AS fb, f.name AS nb FROM lo ASOF LEFT JOIN frames AS f ON lo.session = f.session AND lo.t <= f.t)
    SELECT session, t, CASE WHEN fa IS NOT NULL AND (fb IS NULL OR t - fa <= fb - t) THEN na ELSE nb END AS frame FROM hi""", "trajectory", "frames")


def scans(t):
    from pyspark.sql import Window

    return t("frames").withColumn("end", F.col("t") + 0.0).select("session", F.col("event_id").alias("scan_id"), "t", "end")


add("j2_sync_scan_imu", lambda t: op.sync_scan_imu(scans(t), t("imu")).groupBy("session", "scan_id").agg(F.count("*").alias("n"), F.min("t").alias("first")),
    """WITH s AS (SELECT session, event_id AS scan_id, t AS hi, coalesce(lag(t) OVER (PARTITION BY session ORDER BY t), -1) AS lo FROM frames), m AS (SELECT session, max(t) AS last FROM imu GROUP BY 1)
    SELECT s.session, scan_id, count(*) AS n, min(imu.t) AS first FROM s JOIN m ON m.session = s.session AND last >= hi JOIN imu ON imu.session = s.session AND imu.t > lo AND imu.t <= hi GROUP BY 1, 2""", "frames", "imu")
add("w8_resample", lambda t: rounded(op.resample(t("imu"), 1 / 1800), "t", "value", digits=4),
    f"""WITH p AS (SELECT session, t, avg(w) AS v FROM imu GROUP BY 1, 2), l AS (SELECT *, min(t) OVER (PARTITION BY session) AS t0, lead(t) OVER (PARTITION BY session ORDER BY t) AS t1, lead(v) OVER (PARTITION BY session ORDER BY t) AS v1 FROM p),
    g AS (SELECT *, unnest(generate_series(CAST(ceil(round((t - t0) / 1800, 6)) AS BIGINT), CAST(ceil(round((t1 - t0) / 1800, 6)) AS BIGINT) - 1)) AS k FROM l WHERE t1 IS NOT NULL)
    SELECT session, k, {r('t0 + k * 1800', 't', 4)}, {r('v + (v1 - v) * (t0 + k * 1800 - t) / (t1 - t)', 'value', 4)} FROM g""", "imu")
add("a49_imu_init", lambda t: rounded(op.imu_init(t("imu"), 20), "wx", "wy", "wz", "ax", "ay", "az", "gravity"),
    f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t) AS k FROM imu), a AS (SELECT session, {', '.join(f'avg({c}) AS {c}' for c in ('wx', 'wy', 'wz', 'ax', 'ay', 'az'))}, count(*) AS n FROM f WHERE k <= 20 GROUP BY 1)
    SELECT session, n, {', '.join(r(c, c) for c in ('wx', 'wy', 'wz', 'ax', 'ay', 'az'))}, {r('sqrt(ax * ax + ay * ay + az * az)', 'gravity')} FROM a""", "imu")
add("j13_pair_frames", lambda t: op.pair_frames(*[t("frames").where(f"camera = 'cam{k}'").select(F.format_string("f%d", F.floor(F.col("event_id") / 2)).alias("name")) for k in (0, 1)]).groupBy("status").agg(F.count("*").alias("n")),
    """WITH a AS (SELECT event_id // 2 AS f FROM frames WHERE camera = 'cam0'), b AS (SELECT event_id // 2 AS f FROM frames WHERE camera = 'cam1')
    SELECT CASE WHEN b.f IS NULL THEN 'left' WHEN a.f IS NULL THEN 'right' ELSE 'both' END AS status, count(*) AS n FROM a FULL JOIN b USING (f) GROUP BY 1""", "frames")
add("m21_m23_frame_names", lambda t: rounded(t("frames").select("name", naming.frame_no("name").alias("no"), naming.camera_of("name").alias("camera"), naming.safe_name("name", "cam1").alias("safe"), geo.heading(F.sin(F.col("sharpness")), F.cos(F.col("sharpness"))).alias("heading")), "heading", digits=5),
    f"""SELECT name, event_id AS no, camera, CASE WHEN camera = 'cam1' THEN name END AS safe, {r('(degrees(atan2(sin(sharpness), cos(sharpness))) + 360) % 360', 'heading', 5)} FROM frames""", "frames")
add("m24_x7_log_stages", lambda t: t("log_lines").select("run", "turn", naming.parse_stage("line").alias("s")).select("run", "turn", F.col("s.stage").cast("long").alias("stage"), F.col("s.of").cast("long").alias("of"), F.round("s.progress", 4).alias("progress")),
    "SELECT run, turn, turn % 7 + 1 AS stage, CAST(7 AS BIGINT) AS of, round(run % 100 / 100.0E0, 4) AS progress FROM log_lines", "log_lines")
