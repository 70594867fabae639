"""Poses half a turn apart: both arcs are equally short, and the query takes the one that its SQL takes."""

import datetime

import duckdb

from scanloom.plans import catalog
from tests.test_oracle import _plain


def test_half_turns_as_in_sql(spark, tmp_path):
    """All 360 turns of the made poses, each with a frame before the pose that looks back."""
    ids = {k * 37 % 360: k for k in range(360)}
    start, rows = datetime.datetime(2024, 1, 1), []
    for a in range(360):
        at = [start + datetime.timedelta(seconds=10 * a + s) for s in (0, 1, 4)]
        rows += [(ids[a], at[0], 0, "view", 1.0, ""), (1000 + a, at[1], 0, "click", 0.0, ""), (ids[(a + 180) % 360], at[2], 0, "view", 2.0, "")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    found = catalog.queries()["j1_m4_asof_interpolate"](spark, str(tmp_path))
    columns = sorted(found.columns)
    mine = sorted(repr(tuple(map(_plain, r))) for r in found.select(*columns).collect())
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracles()['j1_m4_asof_interpolate']})").fetchall()
    assert len(mine) == 360 and mine == sorted(repr(tuple(map(_plain, r))) for r in theirs)
