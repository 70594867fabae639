"""Canonical tables from the star schema: points, poses, fixes, messages and observations for queries and tests.

Each is one SELECT over base tables that both Spark and the oracle run. Identifiers are integer arithmetic on keys,
so that they need no sort and don't depend on the order of rows. {us} stands for an event's microseconds. Only Spark reads located and located_b.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL: dict[str, str] = {
    "points": """
        SELECT (((l_orderkey * 8 + l_linenumber) * 200000 + l_partkey) * 10000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS point_id,
          l_returnflag AS cloud_id, l_extendedprice / 1000 AS x, l_quantity AS y, l_discount * 100 + l_tax * 10 AS z,
          l_partkey % 256 AS r, l_partkey * 7 % 256 AS g, l_partkey * 13 % 256 AS b, CAST(l_suppkey % 256 AS DOUBLE) AS intensity
        FROM lineitem""",
    "points_b": """
        SELECT point_id, cloud_id, x, y, z + (point_id % 5) / 1000.0E0 AS z,
          r + CASE WHEN point_id % 7 = 0 THEN 1 ELSE 0 END AS r, g, b, intensity
        FROM (SELECT * FROM points) AS p WHERE point_id % 101 <> 0""",
    # Points and points_b by place, for queries that only tell ids apart: {u} * 64 is more than a long holds from order keys of 9.0 million
    # on, where a shift goes on modulo 2 ** 64, up to order keys of 576 million. What depends on the whole id is worked out from its parts.
    "located": """
        SELECT shiftleft({u}, 6) + CAST(l_quantity AS BIGINT) AS point_id, l_extendedprice / 1000 AS x, l_quantity AS y, l_discount * 100 + l_tax * 10 AS z
        FROM lineitem""",
    "located_b": """
        SELECT shiftleft({u}, 6) + CAST(l_quantity AS BIGINT) AS point_id, l_extendedprice / 1000 AS x, l_quantity AS y,
          l_discount * 100 + l_tax * 10 + (({u} % 5 * 64 + CAST(l_quantity AS BIGINT)) % 5) / 1000.0E0 AS z
        FROM lineitem WHERE ({u} % 101 * 64 + CAST(l_quantity AS BIGINT)) % 101 <> 0""",
    "messages": """
        SELECT user_id % 10 AS session, event_type AS topic, CONCAT('msg/', event_type) AS msgtype, {us} * 1000 AS ts_ns, event_id, props AS raw FROM events""",
    "trajectory": """
        SELECT user_id % 10 AS session, {us} / 1000000.0E0 AS t, value AS px, CAST(event_id % 97 AS DOUBLE) AS py, (event_id % 11) / 10.0E0 AS pz,
          0.0E0 AS qx, 0.0E0 AS qy, sin(radians((event_id * 37) % 360) / 2) AS qz, cos(radians((event_id * 37) % 360) / 2) AS qw
        FROM events WHERE event_type = 'view'""",
    "frames": """
        SELECT user_id % 10 AS session, event_id, CONCAT('cam', CAST(event_id % 2 AS STRING), '/frame_', CAST(event_id AS STRING)) AS name,
          CONCAT('cam', CAST(event_id % 2 AS STRING)) AS camera, {us} / 1000000.0E0 AS t, value AS sharpness
        FROM events WHERE event_type = 'click'""",
    "imu": """
        SELECT user_id % 10 AS session, {us} / 1000000.0E0 AS t, value AS w, value / 10 AS wx, (event_id % 7) / 10.0E0 AS wy, (event_id % 5) / 10.0E0 AS wz,
          (event_id % 13) / 10.0E0 AS ax, (event_id % 3) / 10.0E0 AS ay, 9.0E0 + (event_id % 17) / 10.0E0 AS az
        FROM events WHERE event_type = 'error'""",
    "gps": """
        SELECT user_id % 10 AS session, CAST(floor({us} / 1000000) AS BIGINT) AS epoch, CAST(floor({us} / 1000) AS BIGINT) % 1000 AS ms,
          CASE WHEN event_id % 17 = 0 THEN 'V' ELSE 'A' END AS status, 3.7E0 + (event_id % 100) / 10000.0E0 AS lat, 'S' AS ns,
          38.6E0 + (event_id % 83) / 10000.0E0 AS lon, 'W' AS ew, value AS alt, value / 10 AS speed, CAST(event_id % 360 AS DOUBLE) AS track, event_id, copy
        FROM (SELECT e.*, c.copy FROM events AS e CROSS JOIN (SELECT 0 AS copy UNION ALL SELECT 1 AS copy) AS c
          WHERE event_type = 'purchase' AND (c.copy = 0 OR event_id % 5 = 0)) AS e""",
    "observations": """
        SELECT l_partkey AS point_id, l_suppkey % 12 AS frame_id, l_suppkey % 2 AS lens_id, l_quantity / 51 AS radius, 1 / (1 + l_tax) AS weight,
          (30 + CAST(floor(l_extendedprice) AS BIGINT) % 200) / 255.0E0 AS r, (30 + CAST(floor(l_extendedprice) AS BIGINT) * 3 % 200) / 255.0E0 AS g,
          (30 + CAST(floor(l_extendedprice) AS BIGINT) * 7 % 200) / 255.0E0 AS b, (((l_orderkey * 8 + l_linenumber) * 200000 + l_partkey) * 10000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS obs
        FROM lineitem""",
    "tracks": "SELECT l_partkey AS point_id, l_orderkey AS image_id, l_linenumber AS idx, l_discount * 20 AS error FROM lineitem",
    "features": """
        SELECT l_orderkey AS image_id, l_linenumber AS idx, l_quantity * 10 AS u, l_tax * 1000 AS v,
          CASE WHEN l_orderkey % 13 = 0 THEN l_partkey + 1 ELSE l_partkey END AS point_id FROM lineitem""",
    "views": """
        SELECT s_suppkey AS image_id, CONCAT('cam', CAST(s_nationkey AS STRING), '/img_', CAST(s_suppkey AS STRING)) AS name, s_nationkey AS camera_id,
          s_acctbal / 1000 AS cx, s_suppkey / 10.0E0 AS cy, 5.0E0 AS cz, radians(s_suppkey * 37 % 360) AS yaw FROM supplier""",
    "mask_pixels": """
        SELECT 'a' AS side, p_partkey % 10 AS image, p_partkey % 64 AS x, p_size * 3 % 64 AS y, min(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END) AS keep
        FROM part GROUP BY p_partkey % 10, p_partkey % 64, p_size * 3 % 64
        UNION ALL
        SELECT 'b', p_partkey % 10, p_partkey % 64, p_size * 3 % 64, min(CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE 1 END)
        FROM part GROUP BY p_partkey % 10, p_partkey % 64, p_size * 3 % 64""",
    "pairs": """
        SELECT vec_id AS id, label, {e1} AS sx, {e2} AS sy, {e3} AS sz, 2 * {e1} - {e2} + 5 + {e4} / 1000 AS tx, {e1} + 2 * {e2} - 3 + {e5} / 1000 AS ty,
          2.2E0 * {e3} + 1 + {e6} / 1000 AS tz FROM embeddings""",
    "log_lines": """
        SELECT conv_id AS run, turn, CONCAT('[STAGE ', CAST(turn % 7 + 1 AS STRING), '/7] stage_', CAST(turn % 7 + 1 AS STRING), ' ', CAST(conv_id % 100 AS STRING), '%') AS line,
          conv_id * 1000 + turn * (10 + conv_id % 7) AS at FROM conversations""",
}
BASE = ("lineitem", "events", "supplier", "part", "embeddings", "conversations", "orders")
#: Tables that a table is made of, if not a base table.
USES = {"points_b": ("points",)}

_SPARK = {"u": "(((l_orderkey * 8 + l_linenumber) * 200000 + l_partkey) * 10000 + l_suppkey)", "us": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"} | {f"e{k}": f"CAST(embedding[{k - 1}] AS DOUBLE)" for k in range(1, 7)}
_DUCK = {"us": "epoch_us(ts)"} | {f"e{k}": f"CAST(embedding[{k}] AS DOUBLE)" for k in range(1, 7)}


def _filled(sql: str, values: dict[str, str]) -> str:
    for k, v in values.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical table over the Parquet files of a folder; other names are base tables."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _filled(SQL[name], _SPARK)
    used = {}
    for other in (*BASE, *USES.get(name, ())):
        if f"FROM {other}" in sql:
            sql = sql.replace(f"FROM {other}", "FROM {" + other + "}")
            used[other] = table(spark, sf_dir, other)
    return spark.sql(sql, **used)


def oracle(sql: str, *names: str) -> str:
    """The oracle's SQL with the canonical tables it uses in front."""
    need: list[str] = []
    for name in names:
        need += [n for n in (*USES.get(name, ()), name) if n not in need]
    parts = ",\n".join(f"{n} AS ({_filled(SQL[n], _DUCK).replace('AS STRING', 'AS VARCHAR')})" for n in need)
    rest = sql.strip()
    if not parts:
        return rest
    recursive = rest.upper().startswith("WITH RECURSIVE ")
    if rest.upper().startswith("WITH "):
        rest = rest[len("WITH RECURSIVE ") if recursive else 5 :]
        return f"WITH {'RECURSIVE ' * recursive}{parts},\n{rest}"
    return f"WITH {parts}\n{rest}"
