"""Folds by time against numpy, and the verdict over them."""

import numpy as np

from scanloom.operators import registration as reg


def _fit(s, t):
    a, b = s - s.mean(0), t - t.mean(0)
    u, d, vt = np.linalg.svd(b.T @ a / len(s))
    sign = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
    scale = np.trace(np.diag(d) @ sign) / (a * a).sum(1).mean()
    r = u @ sign @ vt
    return scale, r, t.mean(0) - scale * r @ s.mean(0)


def test_held_out_errors_match_numpy(spark):
    r = np.random.default_rng(4)
    s = r.normal(0, 5, (120, 3))
    t = 1.5 * s @ reg._turn(np.array([0.2, -0.1, 0.4])).T + 3 + r.normal(0, 0.1, s.shape)
    rows = [("a", float(k), *map(float, s[k]), *map(float, t[k]), int(k)) for k in r.permutation(120)]
    got = {g["fold"]: g for g in reg.blocked_cv(spark.createDataFrame(rows, "session string, t double, sx double, sy double, sz double, tx double, ty double, tz double, id long").repartition(3)).collect()}
    fold = np.arange(120) * 5 // 120
    for f in range(5):
        at = np.flatnonzero(fold == f)
        train = np.flatnonzero((np.arange(120) < at[0] - 5) | (np.arange(120) > at[-1] + 5))
        scale, turn, shift = _fit(s[train], t[train])
        miss = np.linalg.norm(scale * s[at] @ turn.T + shift - t[at], axis=1)
        assert got[f]["n"] == 24 and np.isclose(got[f]["rmse"], np.sqrt((miss**2).mean())) and np.isclose(got[f]["median"], np.median(miss)) and np.isclose(got[f]["p90"], np.percentile(miss, 90))


def test_the_verdict_asks_for_wins_gain_and_the_same_rows(spark):
    kind = "session string, fold int, n long, rmse double"
    base = [(x, f, 10 + f, 1.0) for x in "abcd" for f in range(5)]
    other = [("a", f, 10 + f, 0.9 if f else 1.2) for f in range(5)] + [("b", f, 10 + f, 0.98) for f in range(5)] + [("c", f, 10 + f, 0.5 if f > 1 else 1.0) for f in range(5)] + [("d", f, 10, 0.5) for f in range(4)]
    got = {x["session"]: x for x in reg.judge_cv(spark.createDataFrame(base, kind), spark.createDataFrame(other, kind)).collect()}
    assert {k: v["accepted"] for k, v in got.items()} == {"a": True, "b": False, "c": False, "d": False}
    assert [got[k]["wins"] for k in "abc"] == [4, 5, 3] and not got["d"]["same_rows"]
    n = np.arange(10, 15)
    assert np.isclose(got["a"]["candidate_rmse"], np.sqrt((n * np.array([1.2, 0.9, 0.9, 0.9, 0.9]) ** 2).sum() / n.sum()))
