"""Registration of poses and signals: similarity fits, robust consensus, lags and graphs.

Sums are taken by Spark, one row a group; only matrices of a few numbers are decomposed, in numpy, group by group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.lineage import checkpoint
from scanloom.operators.quantiles import exact_percentiles, grouped_percentiles
from scanloom.operators.series import Series, small
from scanloom.operators.solve import HELD, conjugate_gradient

_S, _T = ("sx", "sy", "sz"), ("tx", "ty", "tz")


def sim3_sums(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means, cross-covariance and spread of paired points, about the group's means: two aggregations, all mergeable."""
    means = pairs.groupBy(*keys).agg(*[F.avg(c).alias(f"m{c}") for c in (*_S, *_T)], F.count("*").alias("n"))
    near = pairs.join(means, list(keys)) if keys else pairs.crossJoin(F.broadcast(means))
    d = lambda c: F.col(c) - F.col(f"m{c}")
    cross = [F.avg(d(t) * d(s)).alias(f"h{i}{j}") for i, t in enumerate(_T) for j, s in enumerate(_S)]
    spread = F.avg(sum((d(s) * d(s) for s in _S), F.lit(0.0))).alias("spread")
    kept = [F.first(f"m{c}").alias(f"m{c}") for c in (*_S, *_T)] + [F.first("n").alias("n")]
    return near.groupBy(*keys).agg(*kept, *cross, spread)


def umeyama(pairs: DataFrame, keys: Sequence[str] = ("label",), scale: bool = True) -> DataFrame:
    """Scale, rotation (nine numbers) and shift that carry s onto t with least squares, and the root mean square left."""
    sums = sim3_sums(pairs, keys)
    names = [f"h{i}{j}" for i in range(3) for j in range(3)]

    def solve(batches):
        for rows in batches:
            h = rows[names].to_numpy().reshape(-1, 3, 3)
            u, d, vt = np.linalg.svd(h)
            sign = np.ones((len(h), 3))
            sign[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
            r = (u * sign[:, None, :]) @ vt
            s = (d * sign).sum(1) / rows["spread"].to_numpy() if scale else np.ones(len(h))
            shift = rows[[f"m{c}" for c in _T]].to_numpy() - s[:, None] * np.einsum("nij,nj->ni", r, rows[[f"m{c}" for c in _S]].to_numpy())
            yield rows[[*keys, "n"]].assign(s=s, r=list(r.reshape(-1, 9)), t=list(shift))

    schema = ", ".join(f"`{k}` {dict(sums.dtypes)[k]}" for k in keys)
    fit = sums.mapInPandas(solve, f"{schema + ', ' if keys else ''}n long, s double, r array<double>, t array<double>")
    both = pairs.join(fit.drop("n"), list(keys)) if keys else pairs.crossJoin(F.broadcast(fit.drop("n")))
    miss = sum((F.pow(_moved(k) - F.col(_T[k]), 2) for k in range(3)), F.lit(0.0))
    rms = both.groupBy(*keys).agg(F.sqrt(F.avg(miss)).alias("rmse"))
    return fit.join(rms, list(keys)) if keys else fit.crossJoin(rms)


def _moved(k: int) -> Column:
    return F.col("s") * sum((F.col("r")[3 * k + j] * F.col(_S[j]) for j in range(3)), F.lit(0.0)) + F.col("t")[k]


def pose_consensus(poses: DataFrame, keys: Sequence[str], share: float = 0.7, least: tuple[float, float] = (0.05, 0.5), most: tuple[float, float] = (1.0, 10.0)) -> DataFrame:
    """Mean rotation (largest eigenvector of the quaternions' outer products) and median shift; inliers lie within
    median + 3 * 1.4826 * MAD of both (clamped, metres and degrees). accepted if enough of them are inliers."""
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    q = ("qx", "qy", "qz", "qw")
    sums = poses.groupBy(*keys).agg(*[F.avg(F.col(q[i]) * F.col(q[j])).alias(f"o{i}{j}") for i, j in pairs], F.count("*").alias("n"))
    sums = sums.join(small(grouped_percentiles(poses, keys, {f"m{c}": (F.col(c), 0.5) for c in ("px", "py", "pz")})), list(keys))

    def solve(batches):
        for rows in batches:
            m = np.empty((len(rows), 4, 4))
            for i, j in pairs:
                m[:, i, j] = m[:, j, i] = rows[f"o{i}{j}"]
            v = np.linalg.eigh(m)[1][:, :, 3]
            v *= np.where(v[:, 3:] < 0, -1, 1)
            yield rows[[*keys, "n", "mpx", "mpy", "mpz"]].assign(**{f"m{c}": v[:, k] for k, c in enumerate(q)})

    schema = ", ".join(f"`{k}` {dict(sums.dtypes)[k]}" for k in keys)
    mean = sums.mapInPandas(solve, f"{schema}, n long, " + ", ".join(f"m{c} double" for c in ("px", "py", "pz", *q)))
    dot = F.abs(sum((F.col(c) * F.col(f"m{c}") for c in q), F.lit(0.0)))
    off = poses.join(mean, list(keys)).withColumns({"off_m": F.sqrt(sum((F.pow(F.col(c) - F.col(f"m{c}"), 2) for c in ("px", "py", "pz")), F.lit(0.0))), "off_deg": F.degrees(2 * F.acos(F.least(F.lit(1.0), dot)))})
    off = checkpoint(off)
    mid = small(grouped_percentiles(off, keys, {"_a": (F.col("off_m"), 0.5), "_b": (F.col("off_deg"), 0.5)}))
    far = off.join(mid, list(keys))
    spread = mid.join(grouped_percentiles(far, keys, {"_c": (F.abs(F.col("off_m") - F.col("_a")), 0.5), "_d": (F.abs(F.col("off_deg") - F.col("_b")), 0.5)}), list(keys))
    clamp = lambda v, k: F.greatest(F.lit(least[k]), F.least(F.lit(most[k]), v))
    gates = spread.select(*keys, clamp(F.col("_a") + 3 * 1.4826 * F.col("_c"), 0).alias("gate_m"), clamp(F.col("_b") + 3 * 1.4826 * F.col("_d"), 1).alias("gate_deg"))
    held = off.join(gates, list(keys)).withColumn("_in", (F.col("off_m") <= F.col("gate_m")) & (F.col("off_deg") <= F.col("gate_deg")))
    out = held.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("_in").alias("inliers"), F.first("gate_m").alias("gate_m"), F.first("gate_deg").alias("gate_deg"), *[F.first(f"m{c}").alias(f"m{c}") for c in ("px", "py", "pz", *q)])
    out = out.join(small(grouped_percentiles(off, keys, {"p90_m": (F.col("off_m"), 0.9), "p90_deg": (F.col("off_deg"), 0.9)})), list(keys))
    return out.withColumn("accepted", F.col("inliers") >= share * F.col("n"))


def lag_join(a: DataFrame, b: DataFrame, lags: Sequence[int] | DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Values of both signals at grid places that differ by each lag (b's place = a's place + lag): an equi-join on the place.

    Lags are the same for all series, or rows of keys and lag.
    """
    left = a.select(*keys, F.col("k").alias("_ka"), F.col("value").alias("va"))
    left = left.join(small(lags), list(keys)) if isinstance(lags, DataFrame) else left.withColumn("lag", F.explode(F.array(*[F.lit(int(x)) for x in lags])))
    return left.withColumn("k", F.col("_ka") + F.col("lag")).join(b.select(*keys, "k", F.col("value").alias("vb")), [*keys, "k"]).drop("_ka")


def lag_correlation(a: DataFrame, b: DataFrame, lags: Sequence[int], keys: Sequence[str] = ("session",), overlap: int = 20, share: float = 0.5, score: float = 0.5, margin: float = 0.05, apart: int = 2) -> DataFrame:
    """The lag of best correlation, with the runner-up at least apart away, and whether it is accepted or why not.

    Lags with less overlap than the bound (or share of the shorter signal) don't count. coarse to fine: call again with lags about the best.
    """
    short = F.least(F.col("na"), F.col("nb"))
    sizes = a.groupBy(*keys).agg(F.count("*").alias("na")).join(b.groupBy(*keys).agg(F.count("*").alias("nb")), list(keys))
    by_lag = lag_join(a, b, lags, keys).groupBy(*keys, "lag").agg(F.corr("va", "vb").alias("r"), F.count("*").alias("n"))
    held = by_lag.join(sizes, list(keys)).where((F.col("n") >= overlap) & (F.col("n") >= share * short) & F.col("r").isNotNull() & ~F.isnan("r"))
    best = held.groupBy(*keys).agg(F.max(F.struct("r", (-F.col("lag")).alias("_l"), "n")).alias("_b"))
    best = best.select(*keys, (-F.col("_b._l")).alias("best_lag"), F.col("_b.r").alias("score"), F.col("_b.n").alias("overlap"))
    second = held.join(best, list(keys)).where(F.abs(F.col("lag") - F.col("best_lag")) >= apart).groupBy(*keys).agg(F.max("r").alias("runner_up"))
    out = sizes.select(*keys).join(best, list(keys), "left").join(second, list(keys), "left").withColumn("margin", F.col("score") - F.coalesce("runner_up", F.lit(0.0)))
    reason = F.when(F.col("score").isNull(), "no_overlap").when(F.col("score") < score, "weak_correlation").when(F.col("margin") < margin, "ambiguous_peak").otherwise("ok")
    return out.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "ok")


def sync_clocks(a: DataFrame, b: DataFrame, reach: float, rates: Sequence[int] = (1, 10, 100), value: str = "w", keys: Sequence[str] = ("session",), seconds: float = 5.0, share: float = 0.5, score: float = 0.55, margin: float = 0.03, apart: float = 2.0) -> DataFrame:
    """The offset of two clocks (time in b less time in a) from a signal that both recorded, from coarse to fine grids.

    All lags within the reach are correlated at the first rate, where the peak must stand out from all that are so many
    seconds apart; each further rate, a multiple of the one before, tries the lags within a step of the best. Per series:
    offset (null unless accepted), score, overlap in samples, runner_up, margin, reason and accepted. The work of a rate
    grows with samples times lags, which are few but at the coarsest.
    """
    from scanloom.operators.tracks import resample

    if any(later % rate for rate, later in zip(rates, rates[1:], strict=False)) or list(rates) != sorted(set(rates)):
        raise ValueError("each rate must be a multiple of the one before")
    starts = [rows.groupBy(*keys).agg(F.min("t").alias(n)) for rows, n in ((a, "_ta"), (b, "_tb"))]
    first = rates[0]
    steps = int(np.ceil(reach * first))
    grids = [checkpoint(resample(rows, first, value, keys)) for rows in (a, b)]
    found = checkpoint(lag_correlation(*grids, range(-steps, steps + 1), keys, int(np.ceil(seconds * first)), share, score, margin, max(1, int(np.ceil(apart * first)))))
    best = found.where("best_lag is not null").select(*keys, F.col("best_lag").cast("long").alias("lag"), "score", "overlap")
    for rate, later in zip(rates, rates[1:], strict=False):
        ratio = later // rate
        near = best.select(*keys, F.explode(F.sequence(F.col("lag") * ratio - ratio, F.col("lag") * ratio + ratio)).alias("lag"))
        by_lag = lag_join(*[resample(rows, later, value, keys) for rows in (a, b)], near, keys).groupBy(*keys, "lag").agg(F.corr("va", "vb").alias("r"), F.count("*").alias("n"))
        top = by_lag.where("r is not null and not isnan(r)").groupBy(*keys).agg(F.max(F.struct("r", (-F.col("lag")).alias("_l"), "n")).alias("_b"))
        best = checkpoint(top.select(*keys, (-F.col("_b._l")).alias("lag"), F.col("_b.r").alias("score"), F.col("_b.n").alias("overlap")))
    out = found.select(*keys, "runner_up", "margin", "reason", "accepted").join(best, list(keys), "left")
    for start in starts:
        out = out.join(start, list(keys), "left")
    offset = F.col("_tb") - F.col("_ta") + F.col("lag") / rates[-1]
    return out.select(*keys, F.when(F.col("accepted"), offset).alias("offset"), "score", "overlap", "runner_up", "margin", "reason", "accepted")


def refine_offset(views: DataFrame, trajectory: DataFrame, low: float, high: float, step: float, levels: int = 2, finer: int = 10, margin: float = 0.05, least: int = 6, keys: Sequence[str] = ("session",)) -> DataFrame:
    """The clock offset between low and high at which the views fit the trajectory best, on grids from coarse to fine.

    Only offsets with at least so many views inside the trajectory, and half of the most that any has, are compared. The best of the
    first grid must be better by the margin than all that are two steps or more away (unique); each further level parts
    two steps about the best. Per series: dt, s, rmse, n, rival (the other's rmse, null if there is none) and unique.
    """
    if not low < high or step <= 0:
        raise ValueError("a span and a step above 0")
    count = int(np.floor((high - low) / step + 1e-9)) + 1
    offsets, best, first, width = [low + k * step for k in range(count)], None, None, step
    for level in range(levels):
        tried = checkpoint(search_offset(views, trajectory, offsets, keys).drop("rank"))
        full = tried.groupBy(*keys).agg(F.max("n").alias("_most"))
        held = tried.join(small(full), list(keys)).where((F.col("n") >= least) & (2 * F.col("n") >= F.col("_most")) & F.col("rmse").isNotNull())
        best = checkpoint(held.groupBy(*keys).agg(F.min(F.struct("rmse", F.abs("dt").alias("_a"), "dt", "s", "n")).alias("_b")).select(*keys, "_b.dt", "_b.s", "_b.rmse", "_b.n"))
        if level == 0:
            other = held.select(*keys, F.col("dt").alias("_d"), F.col("rmse").alias("_r")).join(small(best), list(keys)).where(F.abs(F.col("_d") - F.col("dt")) >= 2 * step * (1 - 1e-9))
            first = checkpoint(best.select(*keys, F.col("rmse").alias("_first")).join(other.groupBy(*keys).agg(F.min("_r").alias("rival")), list(keys), "left"))
        steps = F.sequence(F.lit(-finer), F.lit(finer))
        width /= finer
        offsets = best.select(*keys, "dt", F.explode(steps).alias("_k")).select(*keys, (F.col("dt") + F.col("_k") * width).alias("dt"))
    unique = F.col("rival").isNull() | (F.col("_first") * (1 + margin) < F.col("rival"))
    return best.join(first, list(keys)).withColumn("unique", unique).drop("_first")


def search_offset(views: DataFrame, trajectory: DataFrame, offsets: Sequence[float] | DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """For each candidate clock offset, how well the views' centres fit the trajectory at their shifted times; best has the least error.

    views: t, cx, cy, cz. Candidates, the same for all series or rows of keys and dt, are interpolated in one as-of pass,
    then fitted group by group.
    """
    from scanloom.operators.tracks import asof_interpolate

    tried = views.join(small(offsets), list(keys)) if isinstance(offsets, DataFrame) else views.withColumn("dt", F.explode(F.array(*[F.lit(float(x)) for x in offsets])))
    tried = tried.withColumn("t", F.col("t") + F.col("dt"))
    at = asof_interpolate(tried, trajectory, "drop", keys)
    pairs = at.select(*keys, "dt", F.col("cx").alias("sx"), F.col("cy").alias("sy"), F.col("cz").alias("sz"), F.col("px").alias("tx"), F.col("py").alias("ty"), F.col("pz").alias("tz"))
    fit = umeyama(pairs, [*keys, "dt"])
    best = Window.partitionBy(*keys).orderBy("rmse", F.abs("dt"))
    return fit.withColumn("rank", F.row_number().over(best))


def ransac_sim3(pairs: DataFrame, keys: Sequence[str] = ("label",), trials: int = 60, tolerance: float = 1.2, refine: float = 0.5) -> DataFrame:
    """The similarity of the four-point sample (by mixed keys) that most pairs agree with, fitted again to its inliers.

    Every trial's four pairs come from one aggregation; its model scores all pairs of its group.
    """
    turn = lambda trial: F.pmod(F.col("id") * 48271 + trial * 7919 + F.lit(11), F.lit(2147483647)) * 69621 % 2147483647
    tried = pairs.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    four = tried.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "trial").orderBy(turn(F.col("trial")), "id"))).where("_k <= 4")
    models = umeyama(four, [*keys, "trial"]).select(*keys, "trial", "s", "r", "t")
    miss = F.sqrt(sum((F.pow(_moved(k) - F.col(_T[k]), 2) for k in range(3)), F.lit(0.0)))
    scored = tried.join(models, [*keys, "trial"]).withColumn("_in", miss <= tolerance).groupBy(*keys, "trial").agg(F.count_if("_in").alias("inliers"))
    best = scored.groupBy(*keys).agg(F.max_by("trial", F.struct("inliers", -F.col("trial"))).alias("trial"))
    own = pairs.join(best, list(keys)).join(models, [*keys, "trial"]).where(miss <= tolerance).select(*pairs.columns)
    rough = umeyama(own, keys).select(*keys, "s", "r", "t")
    final = pairs.join(rough, list(keys)).where(miss <= refine).select(*pairs.columns)
    total = pairs.groupBy(*keys).agg(F.count("*").alias("total"))
    return umeyama(final, keys).join(total, list(keys)).withColumn("accepted", (2 * F.col("n") > F.col("total")) & (F.col("rmse") <= 0.25 + refine))


def icp(source: DataFrame, target: DataFrame, gates: Sequence[float] = (1.5, 0.7, 0.3), trim: float = 0.7) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Rotation, shift and errors of source onto target by a gate schedule; pairs beyond the trim percentile of distances are left out.

    Each round is one neighbour join and one sum; only the sums come to the driver.
    """
    from scanloom.functions.geometry import apply_rt
    from scanloom.operators.spatial import nn_join

    rotation, shift, errors = np.eye(3), np.zeros(3), []
    for gate in gates:
        x, y, z = apply_rt("x", "y", "z", rotation.ravel().tolist(), shift.tolist())
        moved = source.select("point_id", x.alias("x"), y.alias("y"), z.alias("z"))
        near = checkpoint(nn_join(moved, target.select("point_id", "x", "y", "z"), gate))
        limit = exact_percentiles(near, {"d": (F.col("d"), trim)})["d"]
        if limit is None:
            break
        kept = near.where(F.col("d") <= limit)
        pairs = kept.select(*[F.col(c).alias(f"s{c}") for c in "xyz"], *[F.col(f"{c}_b").alias(f"t{c}") for c in "xyz"])
        fit = umeyama(pairs, (), scale=False).first()
        if fit is None or fit["n"] < 3:
            break
        r, t = np.array(fit["r"]).reshape(3, 3), np.array(fit["t"])
        rotation, shift = r @ rotation, r @ shift + t
        errors.append(fit["rmse"])
    return rotation, shift, errors


def scene_normals(target: DataFrame, k: int = 20, radius: float = 1.0, least: int = 200, weakest: float = 0.025, spread: float = 35.0) -> DataFrame:
    """point_id and unit normal of the points whose surroundings are planar, of a scene that faces enough ways.

    The mean outer product of the normals must have no eigenvalue below weakest, nor a ratio of eigenvalues above spread:
    what only one plane (or one edge) shows can't hold a cloud in place. Raises ValueError otherwise.
    """
    from scanloom.operators.spatial import normals

    out = checkpoint(normals(target, k, radius).where("planar").select("point_id", "nx", "ny", "nz"))
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    s = out.agg(F.count("*").alias("n"), *[F.avg(F.col(f"n{a}") * F.col(f"n{b}")).alias(a + b) for a, b in pairs]).first()
    if s["n"] < least:
        raise ValueError(f"only {s['n']} points with planar surroundings")
    values = np.linalg.eigvalsh([[s["".join(sorted(a + b))] for b in "xyz"] for a in "xyz"])
    if values[0] < weakest or values[2] > spread * values[0]:
        raise ValueError(f"the scene's normals are degenerate: {values.tolist()}")
    return out


def plane_step(pairs: DataFrame, conditioned: float = 1e4) -> tuple[np.ndarray, np.ndarray]:
    """The small turn and shift that bring x, y, z nearest to the planes through tx, ty, tz with normals nx, ny, nz.

    Linearised: one aggregation of 6 x 6 sums, with the turn scaled by the median distance from the origin and Huber weights
    by the median residual. Raises ValueError where the planes leave a motion open.
    """
    n = [F.col(f"n{c}") for c in "xyz"]
    rows = pairs.withColumn("_r", sum((n[k] * (F.col(c) - F.col(f"t{c}")) for k, c in enumerate("xyz")), F.lit(0.0)))
    mid = exact_percentiles(rows, {"far": (F.sqrt(sum((F.col(c) * F.col(c) for c in "xyz"), F.lit(0.0))), 0.5), "off": (F.abs("_r"), 0.5)})
    scale, cut = max(mid["far"], 1.0), max(2.5 * max(mid["off"] * 1.4826, 0.01), 0.03)
    x, y, z = (F.col(c) for c in "xyz")
    terms = [(y * n[2] - z * n[1]) / scale, (z * n[0] - x * n[2]) / scale, (x * n[1] - y * n[0]) / scale, *n]
    rows = rows.select("_r", (F.least(F.lit(1.0), cut / F.greatest(F.abs("_r"), F.lit(1e-300)))).alias("_w"), *[t.alias(f"_d{k}") for k, t in enumerate(terms)])
    both = [(i, j) for i in range(6) for j in range(i, 6)]
    product = {ij: F.col(f"_d{ij[0]}") * F.col(f"_d{ij[1]}") for ij in both}
    s = rows.agg(*[F.sum(v).alias(f"u{i}{j}") for (i, j), v in product.items()], *[F.sum(F.col("_w") * v).alias(f"w{i}{j}") for (i, j), v in product.items()], *[F.sum(F.col("_w") * F.col("_r") * F.col(f"_d{k}")).alias(f"y{k}") for k in range(6)]).first()
    plain, weighed = (np.array([[s[f"{c}{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)]) for c in "uw")
    values = np.linalg.eigvalsh(plain)
    if values[0] <= 0 or values[5] > conditioned**2 * values[0]:
        raise ValueError("the planes leave a motion open")
    motion = -np.linalg.solve(weighed, [s[f"y{k}"] for k in range(6)])
    return motion[:3] / scale, motion[3:]


def _turn(vector: np.ndarray) -> np.ndarray:
    """The rotation about a vector by its length."""
    angle = np.linalg.norm(vector)
    if angle < 1e-15:
        return np.eye(3)
    x, y, z = vector / angle
    cross = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross


def plane_icp(source: DataFrame, target: DataFrame, rotation: np.ndarray | None = None, shift: np.ndarray | None = None, gates: Sequence[float] = (1.5, 0.7, 0.3), rounds: int = 35, k: int = 20, radius: float = 1.0, least: int = 200) -> dict:
    """Point-to-plane registration by a gate schedule: rotation, shift, fitness, rms and plane_rms.

    Each round is one neighbour search, in the same tree of the target, and one aggregation; only sums come to the driver. A gate's
    rounds end when the motion is below 2e-5 radians and 0.2 mm. Raises ValueError where the scene is degenerate, too few
    points (least, or a quarter) have a partner, or the result fails: half of the points within the last gate, at 0.25 m
    root mean square, and 0.15 m off the planes.
    """
    from scanloom.functions.geometry import apply_rt
    from scanloom.operators import neighbours

    facing = scene_normals(target, k, radius, least)
    tree = neighbours.plant(target, 4 * max(gates))
    source = checkpoint(source.select("point_id", "x", "y", "z"))
    total = source.count()
    rotation, shift = np.eye(3) if rotation is None else np.array(rotation, float), np.zeros(3) if shift is None else np.array(shift, float)

    def partners(gate: float) -> DataFrame:
        x, y, z = apply_rt("x", "y", "z", rotation.ravel().tolist(), shift.tolist())
        moved = source.select("point_id", x.alias("x"), y.alias("y"), z.alias("z"))
        near = neighbours.nearest(moved, target, 1, gate=gate, tree=tree).select("x", "y", "z", F.get("near", F.lit(0)).alias("_n"))
        met = moved.join(near, ["x", "y", "z"]).select("x", "y", "z", "_n.d", F.col("_n.id").alias("_id"), *[F.col(f"_n.{c}_b").alias(f"t{c}") for c in "xyz"])
        met = checkpoint(met.join(facing.withColumnRenamed("point_id", "_id"), "_id"))
        count = met.count()
        if count < max(least, total / 4):
            raise ValueError(f"only {count} of {total} points have a partner within {gate}")
        return met

    for gate in gates:
        for _ in range(rounds):
            turn, move = plane_step(partners(gate))
            delta = _turn(turn)
            rotation, shift = delta @ rotation, delta @ shift + move
            if np.linalg.norm(turn) < 2e-5 and np.linalg.norm(move) < 2e-4:
                break
    off = sum((F.col(f"n{c}") * (F.col(c) - F.col(f"t{c}")) for c in "xyz"), F.lit(0.0))
    s = partners(gates[-1]).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"), F.sqrt(F.avg(off * off)).alias("plane_rms")).first()
    out = {"rotation": rotation, "shift": shift, "fitness": s["n"] / total, "rms": s["rms"], "plane_rms": s["plane_rms"]}
    if out["fitness"] < 0.5 or out["rms"] >= 0.25 or out["plane_rms"] >= 0.15:
        raise ValueError(f"the registration fails: {out}")
    return out


def blocked_cv(rows: DataFrame, folds: int = 5, purge: int = 5, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Contiguous folds by time: a similarity fitted outside each fold (and its purged margins) is tested, untrimmed, inside.

    rows: t and pairs sx..tz. Returns rmse, median and 90th percentile by fold.
    """
    series = Series(rows, keys, "t", "id")
    ranked = series.ranked(series.rows, "_k").drop("_cut").join(small(rows.groupBy(*keys).agg(F.count("*").alias("_n"))), list(keys))
    ranked = ranked.withColumn("fold", F.floor(F.col("_k") * folds / F.col("_n")).cast("int"))
    edges = ranked.groupBy(*keys, "fold").agg(F.min("_k").alias("_a"), F.max("_k").alias("_b"))
    train = ranked.drop("fold").join(edges, list(keys)).where((F.col("_k") < F.col("_a") - purge) | (F.col("_k") > F.col("_b") + purge))
    fit = umeyama(train.select(*keys, "fold", *_S, *_T), [*keys, "fold"]).select(*keys, "fold", "s", "r", "t")
    miss = F.sqrt(sum((F.pow(_moved(k) - F.col(_T[k]), 2) for k in range(3)), F.lit(0.0)))
    held = ranked.select(*keys, "fold", *_S, *_T).join(fit, [*keys, "fold"]).withColumn("_e", miss)
    held = checkpoint(held.select(*keys, "fold", "_e"))
    sums = held.groupBy(*keys, "fold").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"))
    return sums.join(small(grouped_percentiles(held, [*keys, "fold"], {"median": (F.col("_e"), 0.5), "p90": (F.col("_e"), 0.9)})), [*keys, "fold"])


def judge_cv(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str] = ("session",), gain: float = 0.03, losses: int = 1) -> DataFrame:
    """Whether a candidate's fit holds against a baseline's, fold by fold (tables of blocked_cv).

    Root mean squares are pooled over all held-out rows. The candidate is accepted where both were tested on as many rows of the
    same folds, its pooled error is less by the share gain at least, and it loses (or ties) losses folds at most.
    A fold that only one of both has counts as untested.
    """
    a = baseline.select(*keys, "fold", F.col("n").alias("_na"), F.col("rmse").alias("_a"))
    b = candidate.select(*keys, "fold", F.col("n").alias("_nb"), F.col("rmse").alias("_b"))
    both = a.join(b, [*keys, "fold"], "full")
    pooled = lambda e, n: F.sqrt(F.sum(F.col(e) * F.col(e) * F.col(n)) / F.sum(n))
    out = both.groupBy(*keys).agg(F.count("*").alias("folds"), F.count_if(F.col("_b") < F.col("_a")).alias("wins"), F.bool_and(F.col("_na").eqNullSafe(F.col("_nb"))).alias("same_rows"), pooled("_a", "_na").alias("baseline_rmse"), pooled("_b", "_nb").alias("candidate_rmse"))
    good = F.col("same_rows") & (F.col("candidate_rmse") <= F.col("baseline_rmse") * (1 - gain)) & (F.col("wins") >= F.col("folds") - losses)
    return out.withColumn("accepted", F.coalesce(good, F.lit(False)))


def edge_residuals(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Weighted shift and angle left of each edge of a pose graph (sigma 0.10 m and 0.8 degrees; loops 0.02 m and 0.2)."""
    from scanloom.functions import geometry as geo

    side = lambda p, k: nodes.select(*keys, F.col("node").alias(k), *[F.col(c).alias(f"{p}{c}") for c in ("px", "py", "pz", "qx", "qy", "qz", "qw")])
    both = edges.join(side("a_", "i"), [*keys, "i"]).join(side("b_", "j"), [*keys, "j"])
    qa, qb = (geo.quaternion(*[F.col(f"{p}q{c}") for c in "xyzw"]) for p in ("a_", "b_"))
    rows = both.withColumns({"_qa": qa, "_qb": qb})
    dx, dy, dz = geo.quat_rotate(geo.quat_inv(F.col("_qa")), *[F.col(f"b_p{c}") - F.col(f"a_p{c}") for c in "xyz"])
    turn = geo.quat_mul(geo.quat_inv(geo.quaternion("qx", "qy", "qz", "qw")), geo.quat_mul(geo.quat_inv(F.col("_qa")), F.col("_qb")))
    off = F.sqrt(F.pow(dx - F.col("px"), 2) + F.pow(dy - F.col("py"), 2) + F.pow(dz - F.col("pz"), 2))
    loop = F.col("kind") == "loop"
    out = rows.withColumns({"_turn": turn, "off_m": off}).withColumn("off_deg", F.degrees(geo.quat_angle(F.col("_turn"))))
    w = F.pow(F.col("off_m") / F.when(loop, 0.02).otherwise(0.10), 2) + F.pow(F.col("off_deg") / F.when(loop, 0.2).otherwise(0.8), 2)
    return out.withColumn("cost", w).select(*keys, "i", "j", "kind", "off_m", "off_deg", "cost")


def components(edges: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    """(id, component): the least id that each id can reach. Labels halve their paths each round; rounds go through a checkpoint, until none moves."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = checkpoint(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    while True:
        near = both.join(label.select(F.col("u").alias("v"), F.col("m").alias("mv")), "v").groupBy("u").agg(F.min("mv").alias("mv"))
        step = label.join(near, "u", "left").select("u", F.least("m", F.coalesce("mv", "m")).alias("m"))
        jump = checkpoint(step.join(step.select(F.col("u").alias("m"), F.col("m").alias("mm")), "m", "left").select("u", F.least("m", F.coalesce("mm", "m")).alias("m")))
        settled = jump.join(label.withColumnRenamed("m", "was"), "u").where(F.col("was") != F.col("m")).isEmpty()
        label = jump
        if settled:
            break
    return label.select(F.col("u").alias("id"), F.col("m").alias("component"))


def gauss_newton_step(nodes: DataFrame, edges: DataFrame, damping: float = 1e-6, keys: Sequence[str] = ("session",), held: int = HELD) -> DataFrame:
    """Shift corrections of one damped step on the edges' position residuals, the first node of each session held.

    All sessions are one sparse system, solved by conjugate gradients: no matrix of a session is ever dense. Nodes that no
    edge names are left out.
    """
    left = edges.join(nodes.select(*keys, F.col("node").alias("i"), *[F.col(c).alias(f"a{c}") for c in ("px", "py", "pz")]), [*keys, "i"])
    both = left.join(nodes.select(*keys, F.col("node").alias("j"), *[F.col(c).alias(f"b{c}") for c in ("px", "py", "pz")]), [*keys, "j"])
    w = F.when(F.col("kind") == "loop", 1 / 0.02**2).otherwise(1 / 0.10**2)
    r = [F.col(f"b{c}") - F.col(f"a{c}") - F.col(c) for c in ("px", "py", "pz")]
    first = nodes.groupBy(*keys).agg(F.min("node").alias("_first"))
    name = lambda c, k: F.struct(*keys, F.col(c).alias("node"), F.lit(k).alias("axis"))
    rows = both.join(first, list(keys)).withColumn("_w", w).withColumns({f"_r{k}": v for k, v in enumerate(r)})
    entries, right = None, None
    for k in range(3):
        cells = F.array(*[F.struct(name(a, k).alias("i"), name(b, k).alias("j"), (F.col("_w") * sign).alias("a"), ((F.col(a) != F.col("_first")) & (F.col(b) != F.col("_first"))).alias("free")) for a, b, sign in (("i", "i", 1.0), ("j", "j", 1.0), ("i", "j", -1.0), ("j", "i", -1.0))])
        sides = F.array(*[F.struct(name(a, k).alias("i"), (F.col("_w") * F.col(f"_r{k}") * sign).alias("b"), (F.col(a) != F.col("_first")).alias("free")) for a, sign in (("i", 1.0), ("j", -1.0))])
        own = rows.select(F.explode(cells).alias("c")).where("c.free").select("c.i", "c.j", "c.a")
        rest = rows.select(F.explode(sides).alias("c")).where("c.free").select("c.i", "c.b")
        entries, right = (own, rest) if entries is None else (entries.unionByName(own), right.unionByName(rest))
    entries = entries.groupBy("i", "j").agg(F.sum("a").alias("a")).withColumn("a", F.col("a") + F.when(F.col("i") == F.col("j"), damping).otherwise(0.0))
    found = conjugate_gradient(entries, right, held=held)
    found = found.groupBy(*[F.col(f"i.{c}").alias(c) for c in keys], F.col("i.node").alias("node")).agg(*[F.max(F.when(F.col("i.axis") == k, F.col("x"))).alias(c) for k, c in enumerate(("dx", "dy", "dz"))])
    met = edges.select(*keys, F.col("i").alias("node")).unionByName(edges.select(*keys, F.col("j").alias("node"))).distinct()
    return met.join(found, [*keys, "node"], "left").fillna(0.0, ["dx", "dy", "dz"])


def accept_loop(before: DataFrame, after: DataFrame, overlap: float = 0.5, gain: float = 0.02) -> DataFrame:
    """Whether a loop's correction holds: more overlap and less error on both directions of held-out points."""
    a = before.select("direction", F.col("overlap").alias("o0"), F.col("capped_rms").alias("c0"))
    b = after.select("direction", F.col("overlap").alias("o1"), F.col("capped_rms").alias("c1"))
    good = (F.col("o1") >= overlap) & (F.col("o1") >= F.col("o0") - 1e-9) & (F.col("c1") <= F.col("c0") * (1 - gain))
    return a.join(b, "direction").agg(F.bool_and(good).alias("accepted"), F.min("o1").alias("overlap"), F.max("c1").alias("capped_rms"))


def synthesize_poses(frames: DataFrame, trajectory: DataFrame, rotation: Sequence[float], shift: Sequence[float], keys: Sequence[str] = ("session",)) -> DataFrame:
    """World poses of a rigidly mounted camera (body-to-camera quaternion and lever arm) at its frames' times."""
    from scanloom.functions import geometry as geo
    from scanloom.operators.tracks import asof_interpolate

    at = asof_interpolate(frames, trajectory, "drop", keys).withColumn("_q", geo.quaternion("qx", "qy", "qz", "qw"))
    x, y, z = geo.quat_rotate(F.col("_q"), *[F.lit(float(v)) for v in shift])
    q = geo.quat_mul(F.col("_q"), geo.quaternion(*[F.lit(float(v)) for v in rotation]))
    return at.withColumns({"cx": F.col("px") + x, "cy": F.col("py") + y, "cz": F.col("pz") + z, "q": q}).select(*frames.columns, "cx", "cy", "cz", "q.x", "q.y", "q.z", "q.w")


def override_poses(own: DataFrame, accepted: DataFrame, fallback: DataFrame) -> DataFrame:
    """Each name's accepted pose, else the fallback's, else none; source tells which."""
    a = accepted.select("name", F.struct("cx", "cy", "cz").alias("_a"))
    b = fallback.select("name", F.struct("cx", "cy", "cz").alias("_b"))
    both = own.select("name").join(a, "name", "left").join(b, "name", "left").withColumn("_p", F.coalesce("_a", "_b")).where("_p is not null")
    return both.select("name", "_p.*", F.when(F.col("_a").isNotNull(), "accepted").otherwise("fallback").alias("source"))


def support_poses(candidates: DataFrame, views: DataFrame, frames: DataFrame, least: int = 6) -> DataFrame:
    """Candidate poses registered in the model whose time matches the manifest within a microsecond; none if fewer than least."""
    held = candidates.join(views.select("name"), "name", "left_semi").join(frames.select("name", F.col("t").alias("_t")), "name").where(F.abs(F.col("t") - F.col("_t")) <= 1e-6).drop("_t")
    count = held.agg(F.count("*").alias("_n"))
    return held.crossJoin(F.broadcast(count)).where(F.col("_n") >= least).drop("_n")
