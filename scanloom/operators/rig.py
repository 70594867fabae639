"""Rigs, drift and single scans: corrections from matched poses, lens mounts, plane uncertainty, time repair, throttling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import geometry as geo
from scanloom.operators.lineage import checkpoint
from scanloom.operators.quantiles import grouped_percentiles
from scanloom.operators.series import small
from scanloom.operators.tracks import asof_interpolate

#: A jump of offset times in milliseconds, and the step that takes its place.
TIME_JUMP, TIME_STEP = 1.0, 0.004166667


def _turn(prefix: str) -> Column:
    """A quaternion of unit length from four columns, taken as it is: norms written out at every use would make plans explode."""
    return F.struct(*[F.col(f"{prefix}{k}").cast("double").alias(k) for k in "xyzw"])


def pose_deltas(matched: DataFrame, trajectory: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """At each matched pose (t, mx..mz, mqx..mqw) the shift and turn from the trajectory's pose at that time to it."""
    at = asof_interpolate(matched, trajectory, "drop", keys)
    at = at.withColumns({"_m": _turn("mq"), "_q": _turn("q")}).withColumn("_d", geo.quat_mul(F.col("_m"), geo.quat_inv(F.col("_q"))))
    shift = [(F.col(f"m{c}") - F.col(f"p{c}")).alias(f"p{c}") for c in "xyz"]
    return at.select(*keys, "t", *shift, *[F.col(f"_d.{k}").alias(f"q{k}") for k in "xyzw"])


def drift_correct(poses: DataFrame, deltas: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Poses with the deltas interpolated at their times added: shifts linearly, turns on the shorter arc, the end ones beyond the ends.

    Series with fewer than two deltas stay as they are.
    """
    enough = deltas.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n >= 2").drop("_n")
    own = F.struct(*[F.col(c) for c in poses.columns]).alias("_own")
    held = poses.select(*keys, "t", own).join(enough, list(keys))
    moved = asof_interpolate(held, deltas.join(enough, list(keys)), "clip", keys)
    moved = moved.withColumns({"_d": _turn("q"), "_q": _turn("_own.q")}).withColumn("_r", geo.quat_mul(F.col("_d"), F.col("_q")))
    new = {f"p{c}": F.col(f"_own.p{c}") + F.col(f"p{c}") for c in "xyz"} | {f"q{k}": F.col(f"_r.{k}") for k in "xyzw"}
    out = moved.select(*[new.get(c, F.col(f"_own.`{c}`")).alias(c) for c in poses.columns])
    return out.unionByName(poses.join(enough, list(keys), "left_anti").select(*poses.columns))


def lens_mounts(images: DataFrame, trajectory: DataFrame, lens: str = "camera", keys: Sequence[str] = ("session",)) -> DataFrame:
    """Of each lens the mean turn and the median lever arm in the body's frame, over images with world poses (cx..cz, iqx..iqw) at time t.

    The mean turn is the main axis of the sum of the quaternions' outer products, so signs don't matter; sums merge.
    """
    at = asof_interpolate(images, trajectory, "drop", keys)
    at = at.withColumns({"_b": geo.quat_inv(_turn("q")), "_i": _turn("iq")})
    x, y, z = geo.quat_rotate(F.col("_b"), F.col("cx") - F.col("px"), F.col("cy") - F.col("py"), F.col("cz") - F.col("pz"))
    at = at.withColumns({"_r": geo.quat_mul(F.col("_b"), F.col("_i")), "_x": x, "_y": y, "_z": z})
    outer = [F.sum(F.col(f"_r.{a}") * F.col(f"_r.{b}")).alias(f"_{a}{b}") for a in "xyzw" for b in "xyzw"]
    at = checkpoint(at.select(lens, "_r", "_x", "_y", "_z"))
    sums = at.groupBy(lens).agg(F.count("*").alias("n"), *outer)
    sums = sums.join(small(grouped_percentiles(at, [lens], {f"t{c}": (F.col(f"_{c}"), 0.5) for c in "xyz"})), lens)

    def axis(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            m = rows[[f"_{a}{b}" for a in "xyzw" for b in "xyzw"]].to_numpy(float).reshape(-1, 4, 4)
            q = np.linalg.eigh(m)[1][:, :, -1] if len(rows) else np.zeros((0, 4))
            q = q * np.where(q[:, 3:] < 0, -1.0, 1.0)
            yield rows[[lens, "n", "tx", "ty", "tz"]].assign(**{f"q{k}": q[:, i] for i, k in enumerate("xyzw")})

    return sums.mapInPandas(axis, f"`{lens}` {dict(sums.dtypes)[lens]}, n long, tx double, ty double, tz double, qx double, qy double, qz double, qw double")


def plausible_rig(mounts: DataFrame, lens: str = "camera", least: float = 0.08, most: float = 0.30, apart: float = 0.12, turn: float = 180.0, within: float = 5.0) -> DataFrame:
    """Pairs of lenses with the distance of their lever arms, their relative turn in degrees, and whether all gates hold."""
    side = lambda k: mounts.select(F.col(lens).alias(f"{lens}_{k}"), F.struct(*[c for c in mounts.columns if c != lens]).alias(k))
    pairs = side("a").join(side("b"), F.col(f"{lens}_a") < F.col(f"{lens}_b"))  # a rig has a few lenses
    arm = lambda k: F.sqrt(sum((F.col(f"{k}.t{c}") ** 2 for c in "xyz"), F.lit(0.0)))
    gap = F.sqrt(sum(((F.col(f"a.t{c}") - F.col(f"b.t{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    dot = F.abs(sum((F.col(f"a.q{k}") * F.col(f"b.q{k}") for k in "xyzw"), F.lit(0.0)))
    angle = F.degrees(2 * F.acos(F.least(dot, F.lit(1.0))))
    good = arm("a").between(least, most) & arm("b").between(least, most) & (gap <= apart) & (F.abs(angle - turn) <= within)
    return pairs.select(f"{lens}_a", f"{lens}_b", gap.alias("arm_gap"), angle.alias("turn_deg"), good.alias("accepted"))


def plane_variance(points: DataFrame, keys: Sequence[str], threshold: float = 0.01, least: int = 5) -> DataFrame:
    """The 6 x 6 covariance (row order) of normal and centre of each planar cell, from its points' 3 x 3 covariances (column var, row order).

    The plane's moments are summed first and joined back; each batch sums its points' parts by plane, and Spark the rest.
    """
    mean, pairs = [F.avg(c).alias(f"m{c}") for c in "xyz"], [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    moments = points.groupBy(*keys).agg(F.count("*").alias("n"), *mean, *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs]).where(F.col("n") >= least)
    joined = points.select(*keys, "x", "y", "z", "var").join(moments, list(keys))
    kinds = dict(joined.dtypes)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            where, planes = pd.factorize(pd.MultiIndex.from_frame(rows[list(keys)]))
            one = rows.iloc[pd.Series(where).drop_duplicates().index]
            c = {p: one[f"c{p}"].to_numpy(float) for p in ("xx", "xy", "xz", "yy", "yz", "zz")}
            value, axes = np.linalg.eigh(np.stack([np.stack([c["xx"], c["xy"], c["xz"]], 1), np.stack([c["xy"], c["yy"], c["yz"]], 1), np.stack([c["xz"], c["yz"], c["zz"]], 1)], 1))
            flat = (value[:, 0] < threshold)[where]
            d = rows[["x", "y", "z"]].to_numpy(float) - rows[["mx", "my", "mz"]].to_numpy(float)
            n, l, u = rows["n"].to_numpy(float), value[where], axes[where]
            jacobian = np.zeros((len(rows), 6, 3))
            for m in (1, 2):
                low, other = u[:, :, 0], u[:, :, m]
                part = (np.einsum("ni,ni->n", d, other)[:, None] * low + np.einsum("ni,ni->n", d, low)[:, None] * other) / (n * (l[:, 0] - l[:, m]))[:, None]
                jacobian[:, :3] += other[:, :, None] * part[:, None, :]
            jacobian[:, 3:] = np.eye(3) / n[:, None, None]
            var = np.array(rows["var"].tolist(), float).reshape(-1, 3, 3)
            each = (jacobian @ var @ jacobian.transpose(0, 2, 1)).reshape(-1, 36)
            total = np.zeros((len(planes), 36))
            np.add.at(total, where[flat], each[flat])
            kept = np.unique(where[flat])
            yield pd.DataFrame({k: one[k].to_numpy()[kept] for k in keys} | {"part": list(total[kept])})

    found = joined.mapInPandas(parts, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", part array<double>")
    return found.groupBy(*keys).agg(F.array(*[F.sum(F.get("part", F.lit(k))) for k in range(36)]).alias("variance"))


def reproj_gate(u, v, pu, pv, depth, radius, most: float = 2.0, rim: float = 0.98) -> Column:
    """Whether an observation serves: in front, inside the rim, and within so many pixels of its point's projection."""
    c = [F.col(x) if isinstance(x, str) else x for x in (u, v, pu, pv, depth, radius)]
    return F.coalesce((F.sqrt((c[0] - c[2]) ** 2 + (c[1] - c[3]) ** 2) <= most) & (c[4] > 0) & (c[5] < rim), F.lit(False))


def _in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step, schema: str) -> DataFrame:
    """step(state, batch of one group) -> (state, frame) over sorted rows; a group's state goes on from batch to batch, so none is held whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            group = pd.MultiIndex.from_frame(batch[list(keys)]) if keys else pd.Index([0] * len(batch))
            edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            for low, high in zip(edges, np.append(edges[1:], len(batch)), strict=True):
                if group[low] != now:
                    now, state = group[low], None
                state, out = step(state, batch.iloc[low:high])
                yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def repair_times(scan: DataFrame, keys: Sequence[str] = ("scan_id",), order: str = "idx", jump: float = TIME_JUMP, step: float = TIME_STEP) -> DataFrame:
    """rel_ms without jumps: a time that is a jump or more away from the one before (as repaired) becomes that one and a step.

    The first of a scan must itself be below a jump, else it is 0.
    """

    def repair(last: float | None, rows: pd.DataFrame) -> tuple[float, pd.DataFrame]:
        out, value = [], last
        for t in rows["rel_ms"].to_numpy(float).tolist():
            value = (t if abs(t) < jump else 0.0) if value is None else (t if abs(t - value) < jump else value + step)
            out.append(value)
        return value, rows.assign(rel_ms=out)

    return _in_order(scan, keys, [order], repair, ", ".join(f"`{c}` {t}" for c, t in scan.dtypes))


def throttle(rows: DataFrame, fps: float, keys: Sequence[str] = ("session", "topic"), time: str = "t") -> DataFrame:
    """Rows that come 1 / fps seconds or more after the last kept one of their series; all for fps 0. Ties in time keep the first."""
    least = 1 / max(0.1, fps) if fps > 0 else 0.0

    def keep(last: float | None, group: pd.DataFrame) -> tuple[float, pd.DataFrame]:
        t, kept, at = group[time].to_numpy(float), [], 0
        while at < len(t):
            if last is None or t[at] - last >= least:
                kept.append(at)
                last = t[at]
                at += 1
            else:
                at = max(at + 1, int(np.searchsorted(t, last + least - 1e-6)))
                while at < len(t) and t[at] - last < least:
                    at += 1
        return last, group.iloc[kept]

    return _in_order(rows, keys, [time], keep, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes))


# Tables of places, made where they are used


def neighbours27(x="kx", y="ky", z="kz") -> Column:
    """The cell and the 26 about it, to be exploded."""
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    return F.array(*[F.struct((F.col(x) + i).alias("kx"), (F.col(y) + j).alias("ky"), (F.col(z) + k).alias("kz")) for i, j, k in steps])


def lag_grid(low: int, high: int, step: int = 1) -> Column:
    return F.sequence(F.lit(low), F.lit(high), F.lit(step))


def chunk_bounds(total: Column | str, length: float, overlap: float) -> Column:
    """(chunk, start, end) of the chunks of a span, to be exploded; the last is cut at the end, an empty span has none."""
    total = F.col(total) if isinstance(total, str) else total
    step = length - overlap
    if length <= 0 or not 0 <= overlap < length:
        raise ValueError("a chunk must be longer than its overlap")
    last = F.greatest(F.lit(0), F.ceil((total - length) / step)).cast("int")
    return F.when(total > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("chunk"), (k * step).alias("start"), F.least(k * step + length, total).alias("end")))).otherwise(F.array())


def tiles(lat0, lat1, lon0, lon1, zoom: int) -> Column:
    """(x, y) of the web tiles of a zoom that a box of degrees touches, to be exploded."""
    c = [F.col(v) if isinstance(v, str) else F.lit(v) if isinstance(v, (int, float)) else v for v in (lat0, lat1, lon0, lon1)]
    at = [geo.tile_xyz(la, lo, zoom) for la, lo in ((c[1], c[2]), (c[0], c[3]))]
    span = lambda k: F.sequence(at[0][k].cast("long"), at[1][k].cast("long"))
    return F.flatten(F.transform(span(0), lambda x: F.transform(span(1), lambda y: F.struct(x.alias("x"), y.alias("y")))))


#: SQL functions of the library, by name: arguments and expression.
SQL_FUNCTIONS = {
    "srgb_to_linear": ("v DOUBLE", "CASE WHEN v <= 0.04045D THEN v / 12.92D ELSE power((v + 0.055D) / 1.055D, 2.4D) END"),
    "linear_to_srgb": ("v DOUBLE", "CASE WHEN v <= 0.0031308D THEN v * 12.92D ELSE 1.055D * power(v, 1 / 2.4D) - 0.055D END"),
    "utm_zone": ("lon DOUBLE", "CAST(least(60, floor((lon + 180) / 6) + 1) AS INT)"),
    "voxel_key": ("v DOUBLE, size DOUBLE", "CAST(floor(v / size) AS BIGINT)"),
    "tile_x": ("lon DOUBLE, zoom INT", "CAST(floor((lon + 180) / 360 * power(2, zoom)) AS BIGINT)"),
    "tile_y": ("lat DOUBLE, zoom INT", "CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * power(2, zoom)) AS BIGINT)"),
}


def register_functions(spark) -> list[str]:
    """The library's scalar functions for SQL texts of this session."""
    for name, (arguments, expression) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURN {expression}")
    return list(SQL_FUNCTIONS)
