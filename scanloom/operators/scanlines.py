"""Features along the lines of a scan: planes, edges between planes, edges at jumps, wires."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The features' names, and the limits of the classification (metres, degrees, ratios).
FEATURES = ("none", "maybe_plane", "plane", "edge_jump", "edge_plane", "wire")
LIMITS = {"group": 8, "wide_a": 0.01, "wide_b": 0.1, "slender": 225.0, "mid": 6.25, "spread": 3.24, "behind": 170.0, "ahead": 8.0, "fold": 160.0, "far": 10.0, "edge_ratio": 2.0, "edge_gap": 0.1, "straight": 172.5, "even": 1.2}
_NONE, _MAYBE, _PLANE, _JUMP, _FOLD, _WIRE = range(6)
#: How a neighbour lies: beside, ahead of or behind the point on its ray, missing since the point is far, missing.
_BESIDE, _AHEAD, _BEHIND, _FAR, _GONE = range(5)


class _Line:
    """One line's points in order, and what follows from each two neighbours."""

    def __init__(self, xyz: np.ndarray, blind: float, solid: bool, limits: dict):
        self.p, self.n, self.solid, self.limits = xyz, len(xyz), solid, limits
        self.reach = np.hypot(xyz[:, 0], xyz[:, 1])
        self.near = self.reach < blind
        self.step = np.append((np.diff(xyz, axis=0) ** 2).sum(1), 0.0)  # squared distance to the next point
        places = np.where(self.near, np.arange(self.n), self.n)
        self.gap = np.append(np.minimum.accumulate(places[::-1])[::-1], self.n)  # the next near point at or after each
        self.head = int(np.argmin(self.near)) if not self.near.all() else self.n
        self.kind = np.zeros(self.n, np.int8)

    def stretch(self, i: int) -> tuple[int, np.ndarray | None]:
        """Where the group that starts at i stops, and its direction if it is a plane."""
        own, limits = self.p[i], self.limits
        least, far = i + limits["group"], (limits["wide_a"] * self.reach[i] + limits["wide_b"]) ** 2
        end = least
        while end < self.n:
            beyond = np.flatnonzero(((self.p[end : end + 64] - own) ** 2).sum(1) >= far)
            if len(beyond):
                end += int(beyond[0])
                break
            end = min(end + 64, self.n)
        if self.gap[i] <= min(end, self.n - 1):
            return max(int(self.gap[i]), i), None
        chord = self.p[min(end, self.n - 1)] - own
        long, wide = chord @ chord, (np.cross(self.p[i + 1 : end] - own, chord) ** 2).sum(1).max(initial=0.0)
        if long * long < limits["slender"] * wide:
            return end, None
        gaps = np.sort(self.step[i:end])[::-1]
        if gaps[-2] < 1e-16:
            return end, None
        middle = gaps[len(gaps) // 2]
        uneven = gaps[0] >= limits["mid"] * middle or middle >= limits["mid"] * gaps[-2] if self.solid else gaps[0] >= limits["spread"] * gaps[-2]
        return end, None if uneven or long == 0 else chord / np.sqrt(long)

    def planes(self) -> None:
        """Groups in a row; where two planes meet, the fold between them counts."""
        i, last = self.head, None
        while i < self.n - self.limits["group"]:
            if self.near[i]:
                i += 1
                continue
            end, way = self.stretch(i)
            if way is None:
                i = end + 1
            else:
                self.kind[i + 1 : end] = _PLANE
                self.kind[[i, *([end] if end < self.n else [])]] = _MAYBE
                if last is not None:
                    self.kind[i] = _FOLD if abs(last @ way) < 0.707 else _PLANE
                i = end
            last = way

    def _even(self, at: np.ndarray, side: int) -> np.ndarray:
        """Whether the two steps on a side (-1 or 1) of points are alike, and both points there not near."""
        first, second = (at - 1, at - 2) if side < 0 else (at, at + 1)
        low, high = np.sort(np.sqrt(np.stack([self.step[first], self.step[second]])), 0)
        return ~self.near[at + side] & ~self.near[at + 2 * side] & ~((high > self.limits["edge_ratio"] * low) | (high - low > self.limits["edge_gap"]))

    def edges(self) -> np.ndarray:
        """Jumps and wires by how each point's neighbours lie; returns the cosine between both neighbours, 2 where it is unknown."""
        corner = np.full(self.n, 2.0)
        at = np.arange(self.head + 3, max(self.n - 3, self.head + 3))
        at = at[~self.near[at] & (self.kind[at] < _PLANE) & (self.step[at - 1] >= 1e-16) & (self.step[at] >= 1e-16)]
        if not len(at):
            return corner
        own, size = self.p[at], np.linalg.norm(self.p[at], axis=1)
        to, lies = [], []
        for side in (-1, 1):
            v = self.p[at + side] - own
            cosine = (own * v).sum(1) / size / np.linalg.norm(v, axis=1)
            lie = np.select([cosine < np.cos(np.radians(self.limits["behind"])), cosine > np.cos(np.radians(self.limits["ahead"]))], [_BEHIND, _AHEAD], _BESIDE)
            gone = self.near[at + side]
            lies.append(np.where(gone, np.where(self.reach[at] > self.limits["far"], _FAR, _GONE), lie))
            to.append(np.where(gone[:, None], np.nan, v))
        cosine = (to[0] * to[1]).sum(1) / np.linalg.norm(to[0], axis=1) / np.linalg.norm(to[1], axis=1)
        corner[at] = np.where(np.isnan(cosine), 2.0, cosine)
        before, after = lies
        open_ = corner[at] > np.cos(np.radians(self.limits["fold"]))
        here, prior = self.step[at], self.step[at - 1]
        left, right = self._even(at, -1), self._even(at, 1)
        drop = [(before == _BESIDE) & (after == _AHEAD) & (here > 0.0225) & (here > 4 * prior), (before == _AHEAD) & (after == _BESIDE) & (prior > 0.0225) & (prior > 4 * here), (before == _BESIDE) & (after == _FAR), (before == _FAR) & (after == _BESIDE)]
        lone = ~np.any(drop, 0) & (before > _BESIDE) & (after > _BESIDE) & (self.kind[at] == _NONE)
        jump = np.select(drop, [open_ & left, open_ & right, left, right], False)
        self.kind[at] = np.where(jump, _JUMP, np.where(lone, _WIRE, self.kind[at]))
        return corner

    def small_planes(self, corner: np.ndarray) -> None:
        """Three points on a straight line with even steps. One that was taken up can't begin another, so of neighbours every second counts."""
        at = np.arange(self.head + 1, max(self.n - 1, self.head + 1))
        a, b = self.step[at - 1], self.step[at]
        fit = ~self.near[at] & ~self.near[at - 1] & ~self.near[at + 1] & (a >= 1e-8) & (b >= 1e-8) & (self.kind[at] == _NONE)
        with np.errstate(divide="ignore", invalid="ignore"):
            fit &= (corner[at] < np.cos(np.radians(self.limits["straight"]))) & (np.maximum(a, b) / np.minimum(a, b) < self.limits["even"])
        at = at[fit]
        if len(at):
            start = np.append(True, np.diff(at) > 1)
            at = at[(at - np.maximum.accumulate(np.where(start, at, 0))) % 2 == 0]
            around = np.unique(np.concatenate([at - 1, at, at + 1]))
            self.kind[around[self.kind[around] == _NONE]] = _PLANE


def line_features(scan: DataFrame, blind: float = 0.5, solid: bool = False, keys: Sequence[str] = ("scan_id", "ring"), order: str = "idx", limits: dict = LIMITS) -> DataFrame:
    """scan with the feature of each return along its line.

    Returns nearer than blind have none, and no group reaches over one. solid: limits for sensors without turning parts.
    A line is a group; its length is bounded by a turn of the sensor. Returns without a place are left out; equal
    orders go by the place.
    """
    schema = T.StructType([*scan.schema.fields, T.StructField("feature", T.StringType())])

    def classify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([order, "x", "y", "z"], kind="stable")
        line = _Line(rows[["x", "y", "z"]].to_numpy(float), blind, solid, limits)
        line.planes()
        line.small_planes(line.edges())
        return rows.assign(feature=[FEATURES[k] for k in line.kind])

    return scan.where("x is not null and y is not null and z is not null").groupBy(*keys).applyInPandas(classify, schema)


def thin_surfaces(features: DataFrame, every: int = 3, keys: Sequence[str] = ("scan_id", "ring"), order: str = "idx") -> DataFrame:
    """Surface points: of each stretch of planes, every so-manieth return, and the mean of those left at its end."""
    w = Window.partitionBy(*keys).orderBy(order)
    flat = F.col("feature").isin("plane", "maybe_plane")
    rows = features.withColumns({"_k": F.row_number().over(w), "_s": flat}).withColumn("_r", F.sum((~F.col("_s")).cast("long")).over(w)).where("_s")
    rows = rows.withColumn("_p", F.floor((F.row_number().over(Window.partitionBy(*keys, "_r").orderBy("_k")) - 1) / every))
    last = lambda c: F.max_by(c, "_k")
    whole = F.count("*") == every
    return rows.groupBy(*keys, "_r", "_p").agg(F.max(order).alias(order), F.count("*").alias("n"), *[F.when(whole, last(c)).otherwise(F.avg(c)).alias(c) for c in "xyz"]).drop("_r", "_p")
