"""Series in stretches against plain walks: one long session, outlying times, equal times, small stretches."""

import bisect

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import clouds, gps, series, tracks


@pytest.fixture(params=[200_000, 40, 3])
def most(request, monkeypatch):
    monkeypatch.setattr(series, "STRETCH_ROWS", request.param)
    if request.param == 3:
        monkeypatch.setattr(series, "FAN", 4)
    return request.param


def _times(seed=0):
    """One session with nearly all rows and two outlying times, two small ones."""
    r = np.random.default_rng(seed)
    out = {"a": np.sort(np.concatenate([r.uniform(0, 50, 400), [1e9, -1e9]])), "b": np.sort(r.uniform(0, 50, 7)), "c": np.array([5.0])}
    return {k: v.tolist() for k, v in out.items()}


def _rows(spark, times):
    rows = [(s, k, t, float((k * 37) % 11)) for s, own in times.items() for k, t in enumerate(own)]
    return spark.createDataFrame(rows, "session string, k long, t double, v double").repartition(3)


def test_lag_lead_sums_and_ranks(spark, most):
    times = _times()
    s = series.Series(_rows(spark, times), ("session",), "t")
    assert s.cut == (most < 402)
    out = s.lead(s.lag(s.rows, before=F.col("v")), after=F.col("v"))
    out = s.ranked(s.running(out, total=F.col("v")), "rank")
    values = {n: [float((k * 37) % 11) for k in range(len(own))] for n, own in times.items()}
    got = out.collect()
    assert len(got) == sum(map(len, times.values()))
    for g in got:
        v, k = values[g["session"]], g["k"]
        assert (g["rank"], g["before"], g["after"], g["total"]) == (k, v[k - 1] if k else None, v[k + 1] if k + 1 < len(v) else None, sum(v[: k + 1]))
    if most < 402:
        sizes = [g["n"] for g in s.rows.groupBy("session", "_cut").agg(F.count("*").alias("n")).collect()]
        assert max(sizes) <= 3 * most and len(sizes) >= 400 / most


def test_equal_times_stay_together(spark, most):
    rows = spark.createDataFrame([("a", 1.0, k) for k in range(300)] + [("a", 2.0, 300)], "session string, t double, k long")
    cut, _ = series.stretched(rows, ("session",), "t")
    assert cut.groupBy("t").agg(F.count_distinct("_cut").alias("n")).where("n > 1").isEmpty()
    s = series.Series(rows, ("session",), "t", "k")
    assert sorted((g["k"], g["rank"]) for g in s.ranked(s.rows, "rank").collect()) == [(k, k) for k in range(301)]


def test_asof_over_stretches(spark, most):
    times = _times()
    poses = spark.createDataFrame([(s, t, float(k), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for s, own in times.items() for k, t in enumerate(own) if k % 3 == 0], "session string, t double, px double, py double, pz double, qx double, qy double, qz double, qw double")
    asked = _rows(spark, _times(5)).unionByName(spark.createDataFrame([("d", 0, 1.0, 0.0), ("a", 1, None, 0.0)], "session string, k long, t double, v double"))
    knots = {s: [(t, float(k)) for k, t in enumerate(own) if k % 3 == 0] for s, own in times.items()}
    got = {(g["session"], g["k"]): g["px"] for g in tracks.asof_interpolate(asked, poses).where("t is not null").collect()}
    want = {}
    for s, own in _times(5).items():
        for k, t in enumerate(own):
            at = bisect.bisect_right(knots[s], (t, float("inf")))
            if at and (at < len(knots[s]) or knots[s][at - 1][0] == t):
                (t0, p0), (t1, p1) = knots[s][at - 1], knots[s][min(at, len(knots[s]) - 1)]
                want[s, k] = p0 + (p1 - p0) * ((t - t0) / (t1 - t0) if t1 > t0 else 0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, abs(want[k])) for k in want)


def test_operators_over_stretches(spark, most):
    times = _times(7)
    rows = _rows(spark, times).withColumns({"px": F.col("v"), "py": F.col("t") % 5, "pz": F.lit(0.0), "lon": F.when(F.col("k") % 50 < 25, 179.0).otherwise(-179.0), "event_id": F.col("k"), "name": F.col("k").cast("string")})
    steps = {(g["session"], g["k"]): (g["dt"], g["step"]) for g in tracks.step_stats(rows).collect()}
    found, segments = {}, {(g["session"], g["k"]): g["segment"] for g in gps.gap_segments(rows, 1.5).collect()}
    for s, own in times.items():
        v = [float((k * 37) % 11) for k in range(len(own))]
        number, numbers = 0, []
        for k, t in enumerate(own):
            want = (None, None) if k == 0 else (t - own[k - 1], np.hypot(v[k] - v[k - 1], np.fmod(t, 5) - np.fmod(own[k - 1], 5)))
            assert steps[s, k][0] == want[0] and (k == 0 or steps[s, k][1] == pytest.approx(want[1]))
            if k and (t - own[k - 1] > 1.5 or (k % 50 < 25) != ((k - 1) % 50 < 25)):
                number += 1
            numbers.append(number)
        found |= {(s, k): n for k, n in enumerate(numbers) if numbers.count(n) > 1}
    assert segments == found
    clip = sorted(g["k"] for g in tracks.bounded_clip(rows.where("session = 'a'"), 9, 25.0).collect())
    near = min(range(402), key=lambda k: abs(times["a"][k] - 25.0))
    assert clip == list(range(near - 4, near + 5))
    even = sorted(g["point_id"] for g in clouds.sample_even(spark.range(1000).selectExpr("if(id = 999, 1000000000000, id * id) as point_id"), 3.0).collect())
    ids = [k * k for k in range(999)] + [10**12]
    assert even == [ids[k * 999 // 29] for k in range(30)]


def test_resample_over_stretches(spark, most):
    times = _times(3)
    got = tracks.resample(_rows(spark, {"a": times["a"][1:-1], "b": times["b"]}), 2.0, "v").collect()
    assert got
    for s, own in (("a", times["a"][1:-1]), ("b", times["b"])):
        v = [float((k * 37) % 11) for k in range(len(own))]
        mine = sorted((g["k"], g["value"]) for g in got if g["session"] == s)
        assert [k for k, _ in mine] == list(range(len(mine)))
        assert np.allclose([x for _, x in mine], np.interp(own[0] + np.arange(len(mine)) / 2, own, v))
