"""The greedy cap by series and by rounds against a walk in order."""

import random

import pytest

from scanloom.operators import spatial


def _walk(rows, cap):
    room, out = {}, {}
    for s, i, j, d, dt in sorted(rows, key=lambda x: (x[3], -x[4], x[1], x[2])):
        good = room.get((s, i), cap) > 0 and room.get((s, j), cap) > 0
        out[s, i, j] = good
        if good:
            room[s, i], room[s, j] = room.get((s, i), cap) - 1, room.get((s, j), cap) - 1
    return out


@pytest.mark.parametrize("keys,in_order", [(("session",), 50_000), (("session",), 20), (("session",), 0), ((), 50_000)])
def test_cap_equals_a_walk(spark, keys, in_order):
    r = random.Random(3)
    rows = [("chain", k, k + 1, float(k), 1.0) for k in range(40 if in_order else 5)]
    rows += [(s, *sorted(r.sample(range(12), 2)), float(r.randrange(4)), float(r.randrange(5))) for s in "ab" for _ in range(15)]
    rows = list({x[:3]: x for x in rows}.values())
    if not keys:
        rows = [("a", *x[1:]) for x in {x[1:3]: x for x in rows}.values()]
    pairs = spark.createDataFrame(rows, "session string, i long, j long, distance double, dt double").repartition(3)
    got = {(g["session"], g["i"], g["j"]): g["accepted"] for g in spatial.greedy_cap(pairs, 2 if keys else 1, keys, in_order).collect()}
    assert got == _walk(rows, 2 if keys else 1)


def test_cap_of_no_pairs(spark):
    none = spark.createDataFrame([], "session string, i long, j long, distance double, dt double")
    assert spatial.greedy_cap(none, 2).columns == [*none.columns, "accepted"] and spatial.greedy_cap(none, 2).count() == 0
