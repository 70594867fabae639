"""Queries on copies of the tables with keys as large as in big tables, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from scanloom.operators import spatial
from scanloom.plans import catalog
from tests.test_oracle import _plain


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = catalog.queries()[name](spark, folder)
    columns = sorted(found.columns)
    mine = sorted(repr(tuple(map(_plain, r))) for r in found.select(*columns).collect())
    answer = con.execute(catalog.oracles()[name])
    order = [[d[0] for d in answer.description].index(c) for c in columns]
    assert mine == sorted(repr(tuple(_plain(r[k]) for k in order)) for r in answer.fetchall())


@pytest.fixture(scope="module")
def copies(spark, sf, tmp_path_factory):
    """Three copies of lineitem and events, as in larger tables: keys shifted, all else the same; order keys up to nine million."""
    folder = str(tmp_path_factory.mktemp("copies"))
    times = spark.range(3).select(F.col("id").alias("k"))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").crossJoin(times)
    rows.withColumns({"l_orderkey": F.col("l_orderkey") + 8_900_000 + F.col("k") * 5_000, "l_partkey": F.col("l_partkey") + F.col("k") * 200, "l_suppkey": F.col("l_suppkey") + F.col("k") * 10}).drop("k").write.parquet(f"{folder}/lineitem.parquet")
    rows = spark.read.parquet(f"{sf}/events.parquet").crossJoin(times)
    rows.withColumns({"event_id": F.col("event_id") + F.col("k") * 1_000, "user_id": F.col("user_id") + F.col("k") * 1_500}).drop("k").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["f6_livox_valid", "w13_line_diffs", "w14_ring_times"])
def test_lines_follow_whole_ids(spark, copies, name):
    """Ids beyond 2 ** 53 are not divided as doubles."""
    same_as_sql(spark, copies, name)


def test_cloud_maxima_shuffle_no_points(spark, sf):
    """Two or three clouds must not become as many tasks that read all points."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()["f2_resolve_color"](spark, sf)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_few_rows_go_to_the_points(spark):
    """A radius join with few rows on its left reads the other side where it lies, also where cells are crowded."""
    points = spark.range(3000).select(F.col("id").alias("point_id"), (F.col("id") % 30 / 10).alias("x"), (F.col("id") % 7 / 10).alias("y"), F.lit(0.0).alias("z"))
    centres = points.where("point_id < 4")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = spatial.radius_join(centres, points, 0.55, crowd=50)
        plan = met._jdf.queryExecution().toString()
        got = sorted((r["point_id"], r["point_id_b"]) for r in met.select("point_id", "point_id_b").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    places = [(i % 30 / 10, i % 7 / 10) for i in range(3000)]
    assert got == [(i, j) for i in range(4) for j in range(3000) if (places[i][0] - places[j][0]) ** 2 + (places[i][1] - places[j][1]) ** 2 <= 0.55**2]


def test_copies_are_compared_once(spark):
    """Sums over neighbours, and normals, of 40 copies of each place: no row a pair of copies, none a neighbour."""
    points = spark.range(1200).select((F.col("id") * 3).alias("point_id"), (F.col("id") % 30 / 10).alias("x"), (F.col("id") % 30 % 4 / 2).alias("y"), F.lit(0.0).alias("z"))
    got = {r["point_id"]: (r["n"], r["first"], round(r["total"], 6)) for r in spatial.radius_sums(points, points, 0.7).collect()}
    places = [(i / 10, i % 4 / 2) for i in range(30)]
    for p in range(30):
        d = {q: ((places[p][0] - places[q][0]) ** 2 + (places[p][1] - places[q][1]) ** 2) ** 0.5 for q in range(30)}
        near = [q for q in d if d[q] <= 0.7]
        want = (40 * len(near), 3 * min(near), round(40 * sum(d[q] for q in near), 6))
        assert all(got[3 * (p + 30 * k)] == want for k in (0, 1, 39))
    fit = spatial.normals(points, 45, 1.0)
    assert "Generate" not in fit._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    rows = {r["point_id"]: r for r in fit.collect()}
    assert len(rows) == 1200 and all(r["n"] == 46 for r in rows.values())
    for i in (0, 10, 29):
        d = sorted(((places[i][0] - places[j % 30][0]) ** 2 + (places[i][1] - places[j % 30][1]) ** 2, j) for j in range(1200) if j != i)[:45]
        around = [places[i], *[places[j % 30] for _, j in d]]
        mean = [sum(p[c] for p in around) / 46 for c in (0, 1)]
        assert abs(rows[3 * i]["cx"] - mean[0]) < 1e-9 and abs(rows[3 * i]["cy"] - mean[1]) < 1e-9
        assert abs(rows[3 * i]["l1"] + rows[3 * i]["l2"] - sum((p[c] - mean[c]) ** 2 for p in around for c in (0, 1)) / 46) < 1e-9


def test_poses_at_one_time(spark, copies):
    """Of several poses at one time the least counts, in the query and in its SQL."""
    same_as_sql(spark, copies, "j1_m4_asof_interpolate")


def test_offset_among_poses_at_one_time(spark, copies):
    """The SQL searches as the query does: where times are shared, the best fit's scale is not that of the planted copy."""
    same_as_sql(spark, copies, "a27_refine_offset")
