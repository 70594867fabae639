"""Features of scan lines against a plain walk, point by point."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import scanlines as sl


def _walk(points, blind, solid):
    """Every rule in turn, one point at a time."""
    n, kind = len(points), ["none"] * len(points)
    reach = [math.hypot(p[0], p[1]) for p in points]
    sub = lambda a, b: [x - y for x, y in zip(a, b, strict=True)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    step = [dot(sub(points[k + 1], points[k]), sub(points[k + 1], points[k])) for k in range(n - 1)] + [0.0]
    head = next((k for k in range(n) if reach[k] >= blind), n)

    def group(i):
        at = i
        while at < i + 8:
            if reach[at] < blind:
                return at, None
            at += 1
        v = None
        while at < n:
            if reach[at] < blind:
                return at, None
            v = sub(points[at], points[i])
            if dot(v, v) >= (0.01 * reach[i] + 0.1) ** 2:
                break
            at += 1
        v = sub(points[min(at, n - 1)], points[i])
        wide = 0.0
        for k in range(i + 1, at):
            c = np.cross(sub(points[k], points[i]), v)
            wide = max(wide, float(c @ c))
        gaps = sorted(step[i:at], reverse=True)
        if dot(v, v) ** 2 < 225 * wide or gaps[-2] < 1e-16 or dot(v, v) == 0:
            return at, None
        mid = gaps[len(gaps) // 2]
        if (gaps[0] >= 6.25 * mid or mid >= 6.25 * gaps[-2]) if solid else gaps[0] >= 3.24 * gaps[-2]:
            return at, None
        return at, [c / math.sqrt(dot(v, v)) for c in v]

    i, last = head, None
    while i < n - 8:
        if reach[i] < blind:
            i += 1
            continue
        end, way = group(i)
        if way:
            for k in range(i, min(end, n - 1) + 1):
                kind[k] = "maybe_plane" if k in (i, end) else "plane"
            if last:
                kind[i] = "edge_plane" if -0.707 < dot(way, last) < 0.707 else "plane"
        i, last = end if way else end + 1, way

    corner = [2.0] * n
    for i in range(head + 3, n - 3):
        if reach[i] < blind or kind[i] not in ("none", "maybe_plane") or step[i - 1] < 1e-16 or step[i] < 1e-16:
            continue
        lies, to = [], []
        for m in (-1, 1):
            if reach[i + m] < blind:
                lies.append("far" if reach[i] > 10 else "gone")
                to.append(None)
                continue
            v = sub(points[i + m], points[i])
            to.append(v)
            c = dot(points[i], v) / math.sqrt(dot(points[i], points[i])) / math.sqrt(dot(v, v))
            lies.append("behind" if c < math.cos(math.radians(170)) else "ahead" if c > math.cos(math.radians(8)) else "beside")
        if all(to):
            corner[i] = dot(*to) / math.sqrt(dot(to[0], to[0])) / math.sqrt(dot(to[1], to[1]))

        def even(m, i=i):
            if reach[i + m] < blind or reach[i + 2 * m] < blind:
                return False
            a, b = (math.sqrt(step[i - 1]), math.sqrt(step[i - 2])) if m < 0 else (math.sqrt(step[i]), math.sqrt(step[i + 1]))
            return max(a, b) <= 2 * min(a, b) and abs(a - b) <= 0.1

        open_ = corner[i] > math.cos(math.radians(160))
        if lies == ["beside", "ahead"] and step[i] > 0.0225 and step[i] > 4 * step[i - 1]:
            jump = open_ and even(-1)
        elif lies == ["ahead", "beside"] and step[i - 1] > 0.0225 and step[i - 1] > 4 * step[i]:
            jump = open_ and even(1)
        elif lies == ["beside", "far"]:
            jump = even(-1)
        elif lies == ["far", "beside"]:
            jump = even(1)
        else:
            jump = False
            if "beside" not in lies and kind[i] == "none":
                kind[i] = "wire"
        if jump:
            kind[i] = "edge_jump"

    for i in range(head + 1, n - 1):
        if min(reach[i - 1 : i + 2]) < blind or step[i - 1] < 1e-8 or step[i] < 1e-8 or kind[i] != "none":
            continue
        if corner[i] < math.cos(math.radians(172.5)) and max(step[i - 1], step[i]) / min(step[i - 1], step[i]) < 1.2:
            for k in (i - 1, i, i + 1):
                kind[k] = "plane" if kind[k] == "none" else kind[k]
    return kind


def _room(r, n, far):
    """A line of a turning sensor in a room, with poles, a gap of near returns and some noise."""
    angle = np.linspace(0.01, 2 * np.pi, n, endpoint=False)
    wall = np.minimum(far / np.maximum(np.abs(np.cos(angle)), 1e-3), 0.7 * far / np.maximum(np.abs(np.sin(angle)), 1e-3))
    reach = wall + r.normal(0, 0.001, n)
    for a in r.integers(0, n, 8):
        reach[a : a + int(r.integers(1, 12))] *= r.uniform(0.3, 0.9)
    reach[r.integers(0, n, n // 60)] = 0.1
    return np.c_[reach * np.cos(angle), reach * np.sin(angle), np.full(n, 0.3)]


@pytest.mark.parametrize("solid", [False, True])
def test_lines_match_a_plain_walk(spark, solid):
    r = np.random.default_rng(7)
    lines = {(s, k): _room(r, int(r.integers(200, 900)), [3.0, 14.0][k]) for s in range(4) for k in range(2)}
    lines |= {(9, k): _room(r, 12, 3.0)[:k] for k in range(1, 12)}
    lines[10, 0], lines[10, 1] = np.zeros((20, 3)), np.ones((20, 3))
    rows = [(s, k, i, *map(float, p)) for (s, k), line in lines.items() for i, p in enumerate(line)]
    frame = spark.createDataFrame(rows, "scan_id long, ring long, idx long, x double, y double, z double")
    got = {}
    for row in sl.line_features(frame.repartition(5), 0.5, solid).collect():
        got.setdefault((row["scan_id"], row["ring"]), {})[row["idx"]] = row["feature"]
    seen = set()
    for name, line in lines.items():
        want = _walk(line.tolist(), 0.5, solid)
        seen |= set(want)
        assert [got[name][i] for i in range(len(line))] == want, name
    assert seen >= {"none", "maybe_plane", "plane", "edge_jump", "wire"}


def test_a_fold_lies_between_two_walls(spark):  # groups of eight steps end where the walls meet
    wall = [(2.0, -1.0 + 0.02 * k, 0.0) for k in range(81)] + [(2.0 - 0.02 * k, 0.6, 0.0) for k in range(1, 60)]
    frame = spark.createDataFrame([(0, 0, i, *p) for i, p in enumerate(wall)], "scan_id long, ring long, idx long, x double, y double, z double")
    found = sl.line_features(frame).where("feature = 'edge_plane'").collect()
    assert len(found) == 1 and abs(found[0]["x"] - 2) < 0.1 and abs(found[0]["y"] - 0.6) < 0.1


def test_surfaces_are_thinned_by_stretch(spark):
    kinds = ["plane"] * 7 + ["none"] + ["maybe_plane"] * 2 + ["wire"]
    frame = spark.createDataFrame([(0, 0, i, float(i), 0.0, 1.0, k) for i, k in enumerate(kinds)], "scan_id long, ring long, idx long, x double, y double, z double, feature string")
    got = sorted((r["idx"], r["n"], r["x"]) for r in sl.thin_surfaces(frame).collect())
    assert got == [(2, 3, 2.0), (5, 3, 5.0), (6, 1, 6.0), (9, 2, 8.5)]
    assert sl.line_features(frame.drop("feature").where(F.lit(False))).count() == 0
