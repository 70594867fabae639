"""Neighbour joins over a hashed grid or a tree of cells, and the geometry of neighbourhoods.

A radius join is an equi-join: each row of one side goes to the 27 cells about its own, so that rows within a cell's edge
meet. Cells are as wide as the radius; crowded ones are dealt into parts, so that no task has a whole one. Nearest rows
come from a descent through cells that follow the density (`neighbours`), which never forms the pairs of a crowded cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.operators import neighbours
from scanloom.operators.lineage import checkpoint
from scanloom.operators.series import BROADCAST_ROWS, small
from scanloom.operators.tiles import radius_sums  # noqa: F401  (one of the joins of this module)

_AROUND = neighbours._AROUND
#: Rows of a cell that one task of a radius join has at most, in the mean.
CROWD = 512


def _cells(size: float) -> dict[str, Column]:
    return {f"_k{c}": F.floor(F.col(c) / size).cast("long") for c in "xyz"}


def radius_join(a: DataFrame, b: DataFrame, radius: float, keys: Sequence[str] = (), crowd: int = CROWD) -> DataFrame:
    """All pairs within the radius (included): columns of a, those of b with a suffix _b, and the distance d.

    The smaller side should be a; it is the one whose rows go to 27 cells. Where these are few rows (`series.BROADCAST_ROWS`)
    they are broadcast and b is read once, where it lies. Else cells of b with more than crowd rows are dealt
    into parts by a hash of the row, and rows of a go to all parts of such a cell: what they are compared with stays the
    same, but the work of one cell is spread over many keys.
    """
    cell = [*keys, "_kx", "_ky", "_kz"]
    few = a.limit(BROADCAST_ROWS // len(_AROUND) + 1).count() <= BROADCAST_ROWS // len(_AROUND)
    left = neighbours.around(a.withColumns(_cells(radius)), ("_kx", "_ky", "_kz"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys])
    right = right.withColumns({f"_k{c}": F.floor(F.col(f"{c}_b") / radius).cast("long") for c in "xyz"})
    if few:
        return _within(right.join(F.broadcast(left), cell), radius).select(*[c for c in a.columns], *[c for c in right.columns if c not in cell], "d")
    counts = right.groupBy(*cell).agg(F.count("*").alias("_n")).where(F.col("_n") > crowd)
    counts = checkpoint(counts.select(*cell, F.ceil(F.col("_n") / crowd).cast("int").alias("_parts")))  # a row for crowd rows of b, at most
    if counts.isEmpty():
        met = left.join(right, cell)
    else:
        own = F.pmod(F.xxhash64(*[c for c in right.columns if not c.startswith("_k")]), F.coalesce("_parts", F.lit(1))).cast("int")
        right = right.join(counts, cell, "left").withColumn("_part", own).drop("_parts")
        left = left.join(counts, cell, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        met = left.join(right, [*cell, "_part"]).drop("_part")
    return _within(met, radius)


def _within(met: DataFrame, radius: float) -> DataFrame:
    d2 = sum((F.pow(F.col(c) - F.col(f"{c}_b"), 2) for c in "xyz"), F.lit(0.0))
    return met.withColumn("_d2", d2).where(F.col("_d2") <= radius * radius).withColumn("d", F.sqrt("_d2")).drop("_kx", "_ky", "_kz", "_d2")


def nn_join(source: DataFrame, target: DataFrame, gate: float, keys: Sequence[str] = (), key: str = "point_id") -> DataFrame:
    """The nearest target within the gate of each source row (ties: least key): columns of source, those of target with a suffix _b, and d.

    Source rows at one place are searched once. Further columns of the target are joined by its key and place.
    """
    place = [*keys, "x", "y", "z"]
    near = neighbours.nearest(source, target, 1, key, gate=gate, keys=keys)
    near = near.select(*place, *[F.get("near", F.lit(0))[f].alias(n) for f, n in (("d", "d"), ("id", f"{key}_b"), ("x_b", "x_b"), ("y_b", "y_b"), ("z_b", "z_b"))])
    more = [c for c in target.columns if c not in (*keys, key, "x", "y", "z")]
    if more:
        rows = target.groupBy(*keys, F.col(key).alias(f"{key}_b"), *[F.col(c).cast("double").alias(f"{c}_b") for c in "xyz"]).agg(F.min(F.struct(*[F.col(c).alias(f"{c}_b") for c in more])).alias("_m"))
        near = near.join(rows, [*keys, f"{key}_b", "x_b", "y_b", "z_b"]).select(*near.columns, "_m.*")
    return source.join(near, place)


def knn_join(rows: DataFrame, k: int, radius: float, key: str = "point_id") -> DataFrame:
    """The k nearest other rows of each row, however far they are: key, key_b, d, rank. Ties go to the lesser key.

    The radius is a guess of their distance: the edge of the cells with which the search begins. Fewer than k come only where
    there are no more rows. Keys must be unique.
    """
    near = neighbours.nearest(rows, rows, k, key, unit=radius, extra=1)
    own = rows.select(key, *[F.col(c).cast("double").alias(c) for c in "xyz"]).join(near, ["x", "y", "z"])
    best = F.slice(F.filter("near", lambda n: n["id"] != F.col(key)), 1, k)
    return own.select(key, F.posexplode(best).alias("_r", "_n")).select(key, F.col("_n.id").alias(f"{key}_b"), F.col("_n.d").alias("d"), (F.col("_r") + 1).alias("rank"))


# Planes


def cov_sums(*values: Column | str) -> list[Column]:
    """count, means and second moments as mergeable aggregates of three columns; shift them to a near origin first."""
    x, y, z = (F.col(v) if isinstance(v, str) else v for v in values)
    named = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum(y), "sz": F.sum(z), "sxx": F.sum(x * x), "sxy": F.sum(x * y), "sxz": F.sum(x * z), "syy": F.sum(y * y), "syz": F.sum(y * z), "szz": F.sum(z * z)}
    return [c.alias(k) for k, c in named.items()]


def plane_fit(rows: DataFrame, keys: Sequence[str], names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Centroid, eigenvalues l0 <= l1 <= l2 of the covariance (over n) and the normal of each group.

    One aggregation: Spark's covariances update and merge about running means, so that map coordinates cost no precision.
    """
    moments = [F.covar_pop(names[i], names[j]).alias(f"_{k}") for k, (i, j) in zip("abcdef", ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)), strict=True)]
    held = rows.where(" and ".join(f"`{c}` is not null" for c in names))
    named = held.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"c{k}") for c, k in zip(names, "xyz", strict=True)], *moments)
    kinds = dict(named.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "n", "cx", "cy", "cz")) + ", " + ", ".join(f"{c} double" for c in ("l0", "l1", "l2", "nx", "ny", "nz"))
    return named.mapInPandas(_eigen, schema)


def _eigen(batches):
    """Eigenvalues, ascending, and the least one's vector (its largest part positive) of a batch of covariances at once."""
    for rows in batches:
        a, b, c, d, e, f = (rows.pop(f"_{k}").to_numpy(float) for k in "abcdef")
        values, vectors = np.linalg.eigh(np.stack([np.stack([a, b, c], 1), np.stack([b, d, e], 1), np.stack([c, e, f], 1)], 1))
        normal = vectors[:, :, 0]
        normal = normal * np.where(np.take_along_axis(normal, np.abs(normal).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
        yield rows.assign(**{f"l{k}": np.maximum(values[:, k], 0.0) for k in range(3)}, nx=normal[:, 0], ny=normal[:, 1], nz=normal[:, 2])


def octree_planes(points: DataFrame, size: float, layers: int, least: int, threshold: float) -> DataFrame:
    """Planar cells: those of the coarsest layer whose least eigenvalue is below the threshold, else their parts, down to the last layer."""
    left, out = points, None
    for layer in range(layers + 1):
        cell = size / 2**layer
        keyed = left.withColumns({f"k{c}": F.floor(F.col(c) / cell).cast("long") for c in "xyz"})
        fit = plane_fit(keyed, ("kx", "ky", "kz")).where((F.col("n") >= least) & (F.col("l0") < threshold))
        found = fit.withColumn("layer", F.lit(layer).cast("long"))
        out = found if out is None else out.unionByName(found)
        if layer < layers:
            left = keyed.join(fit.select("kx", "ky", "kz"), ["kx", "ky", "kz"], "left_anti").select(*points.columns)
    return out


def normals(points: DataFrame, k: int = 20, radius: float = 1.0) -> DataFrame:
    """Normal and planarity of each point from its k nearest neighbours and itself.

    The k + 1 nearest rows of a place are the neighbours and the point itself for every point that is there (if they lack
    it, they all are at its place), so a fit takes one row and no neighbour is shuffled. Points without three finite coordinates are left out.
    """
    near = neighbours.nearest(points, points, k, unit=radius, extra=1)
    names = ["x", "y", "z", "n", *[f"_{c}" for c in ("cx", "cy", "cz", *"abcdef")]]
    moments = near.mapInArrow(_moments, ", ".join(f"{c} {'long' if c == 'n' else 'double'}" for c in names))
    schema = "x double, y double, z double, n long, " + ", ".join(f"{c} double" for c in ("cx", "cy", "cz", "l0", "l1", "l2", "nx", "ny", "nz"))
    fit = moments.withColumnsRenamed({f"_c{c}": f"c{c}" for c in "xyz"}).mapInPandas(_eigen, schema)
    fit = points.select("point_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).join(fit, ["x", "y", "z"]).drop("x", "y", "z")
    return fit.withColumn("planar", F.col("l0") < 0.18 * (F.col("l0") + F.col("l1") + F.col("l2")))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x, y, z, then number, mean and covariance (over n) of the rows in near, taken about the place itself."""
    for batch in batches:
        near = batch.column("near")
        held, n = near.flatten(), near.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        place = np.stack([batch.column(c).to_numpy() for c in "xyz"], 1)
        off = np.stack([held.field(f"{c}_b").to_numpy() for c in "xyz"], 1) - place[row]
        mean = np.stack([np.bincount(row, off[:, i], len(n)) for i in range(3)], 1) / n[:, None]
        off -= mean[row]
        parts = [np.bincount(row, off[:, i] * off[:, j], len(n)) / n for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]
        columns = [*place.T, n.astype(np.int64), *(place + mean).T, *parts]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["x", "y", "z", "n", *[f"_{c}" for c in ("cx", "cy", "cz", *"abcdef")]])


def point_to_plane(points: DataFrame, planes: DataFrame, size: float, sigma: float = 3.0) -> DataFrame:
    """Each point with the most probable plane of its own voxel; only points that have none there look in the six beside it.

    planes: kx ky kz, centre, normal, radius and variance. A plane counts if the point lies within three radii along it, and three sigma off it.
    """
    keyed = points.withColumns({f"k{c}": F.floor(F.col(c) / size).cast("long") for c in "xyz"})

    def scored(rows: DataFrame) -> DataFrame:
        d = sum((F.col(f"n{c}") * (F.col(c) - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0))
        d2 = sum((F.pow(F.col(c) - F.col(f"c{c}"), 2) for c in "xyz"), F.lit(0.0))
        held = rows.join(planes, ["kx", "ky", "kz"]).withColumns({"dist": d, "along": F.sqrt(F.greatest(d2 - d * d, F.lit(0.0)))})
        held = held.where((F.col("along") <= 3 * F.col("radius")) & (F.abs("dist") < sigma * F.sqrt("variance")))
        prob = F.exp(-F.col("dist") * F.col("dist") / (2 * F.col("variance"))) / F.sqrt("variance")
        best = F.max(F.struct(prob.alias("prob"), F.abs("dist").alias("dist"), "kx", "ky", "kz")).alias("_b")
        return held.groupBy("point_id").agg(best).select("point_id", "_b.*")

    own = scored(keyed)
    steps = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(s, "ijk", strict=True)]) for s in _AROUND if sum(map(abs, s)) == 1])
    missed = keyed.join(own.select("point_id"), "point_id", "left_anti").withColumn("_s", F.explode(steps))
    missed = missed.withColumns({"kx": F.col("kx") + F.col("_s.i"), "ky": F.col("ky") + F.col("_s.j"), "kz": F.col("kz") + F.col("_s.k")}).drop("_s")
    return own.unionByName(scored(missed))


# Overlap and held-out quality


def overlap_metrics(source: DataFrame, target: DataFrame, gate: float) -> DataFrame:
    """Rows, share within the gate, root mean square of those, and of all with distances capped at the gate; one direction."""
    near = nn_join(source.select("point_id", "x", "y", "z"), target.select("point_id", "x", "y", "z"), gate).select("point_id", "d")
    rows = source.select("point_id").join(near, "point_id", "left")
    capped = F.coalesce("d", F.lit(gate))
    return rows.agg(F.count("*").alias("n"), (F.count("d") / F.count("*")).alias("overlap"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"), F.sqrt(F.avg(capped * capped)).alias("capped_rms"))


def symmetric_overlap(a: DataFrame, b: DataFrame, gate: float) -> DataFrame:
    return overlap_metrics(a, b, gate).withColumn("direction", F.lit("forward")).unionByName(overlap_metrics(b, a, gate).withColumn("direction", F.lit("backward")))


def select_patches(points: DataFrame, radius: float, limit: int = 200, least: int = 80, l1: float = 0.003, flat: float = 0.015) -> DataFrame:
    """Planar patches: centres are first records of cells twice the radius wide, with enough neighbours on a plane, centres apart.

    Of centres closer than two radii the one with the least mixed key stays, by rounds of local minima: no global order.
    """
    from scanloom.operators.clouds import first_per_cell, mixed

    firsts = checkpoint(first_per_cell(points, 2 * radius).select("point_id"))
    centres = checkpoint(points.join(small(firsts), "point_id", "left_semi").select("point_id", "x", "y", "z"))
    around = radius_join(centres, points.select("point_id", "x", "y", "z"), radius).select(F.col("point_id").alias("patch"), F.col("x_b").alias("x"), F.col("y_b").alias("y"), F.col("z_b").alias("z"))
    fit = plane_fit(around, ("patch",)).where((F.col("n") >= least) & (F.col("l1") >= l1) & (F.col("l0") <= flat * F.col("l1")))
    good = checkpoint(centres.join(fit.select(F.col("patch").alias("point_id")), "point_id", "left_semi").withColumn("turn", mixed("point_id", 5)))
    crowd = radius_join(good, good, 2 * radius).where("point_id <> point_id_b and d < %r" % (2 * radius))
    ahead = crowd.where((F.col("turn_b") < F.col("turn")) | ((F.col("turn_b") == F.col("turn")) & (F.col("point_id_b") < F.col("point_id")))).select("point_id").distinct()
    return good.join(ahead, "point_id", "left_anti").orderBy("turn", "point_id").limit(limit).drop("turn")


def score_patches(train: DataFrame, test: DataFrame, centres: DataFrame, radius: float, least: int = 40) -> DataFrame:
    """Plane of the training points about each centre, and how far all held-out points lie from it: rmse and 90th percentile in mm."""
    small = centres.select(F.col("point_id").alias("patch"), "x", "y", "z")
    fit = plane_fit(radius_join(small, train.select("point_id", "x", "y", "z"), radius).select("patch", F.col("x_b").alias("x"), F.col("y_b").alias("y"), F.col("z_b").alias("z")), ("patch",))
    held = radius_join(small, test.select("point_id", "x", "y", "z"), radius).select("patch", *[F.col(f"{c}_b").alias(c) for c in "xyz"]).join(fit.where(F.col("n") >= least).withColumnRenamed("n", "n_train"), "patch")
    d = F.abs(sum((F.col(f"n{c}") * (F.col(c) - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0))) * 1000
    out = held.withColumn("_d", d).groupBy("patch").agg(F.first("n_train").alias("n_train"), F.count("*").alias("n_test"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmse_mm"), F.percentile("_d", F.lit(0.9)).alias("p90_mm"), *[F.first(f"n{c}").alias(f"n{c}") for c in "xyz"])
    return out.where(F.col("n_test") >= least)


def summarize_pairs(reference: DataFrame, candidate: DataFrame, angle: float = 15.0) -> DataFrame:
    """Paired patches by orientation and overall: coverage, both errors, reduction, win share, agreement of normals, improved."""
    import math

    a = reference.select("patch", F.col("rmse_mm").alias("ra"), F.col("p90_mm").alias("pa"), *[F.col(f"n{c}").alias(f"a{c}") for c in "xyz"])
    b = candidate.select("patch", F.col("rmse_mm").alias("rb"), F.col("p90_mm").alias("pb"), *[F.col(f"n{c}").alias(f"b{c}") for c in "xyz"])
    same = F.abs(sum((F.col(f"a{c}") * F.col(f"b{c}") for c in "xyz"), F.lit(0.0))) >= math.cos(math.radians(angle))
    kind = F.when(F.abs("az") > 0.8, "horizontal").when(F.abs("az") < 0.35, "vertical").otherwise("oblique")
    both = a.join(b, "patch", "left").withColumns({"same": same, "orientation": kind})
    root = lambda c: F.sqrt(F.avg(F.when(F.col("rb").isNotNull(), F.col(c) * F.col(c))))
    out = both.rollup("orientation").agg(
        F.count("*").alias("patches"), (F.count("rb") / F.count("*")).alias("coverage"), root("ra").alias("rmse_before"), root("rb").alias("rmse_after"),
        F.percentile(F.when(F.col("rb").isNotNull(), F.col("pa")), F.lit(0.9)).alias("p90_before"), F.percentile("pb", F.lit(0.9)).alias("p90_after"),
        F.avg((F.col("rb") < F.col("ra")).cast("double")).alias("wins"), F.avg(F.col("same").cast("double")).alias("consistent"),
    )
    out = out.withColumn("reduction", 1 - F.col("rmse_after") / F.col("rmse_before"))
    return out.withColumn("improved", F.coalesce((F.col("coverage") >= 0.9) & (F.col("rmse_after") < F.col("rmse_before")) & (F.col("wins") > 0.5) & (F.col("consistent") >= 0.9), F.lit(False)))


def validate_same_records(before: DataFrame, after: DataFrame, centres: DataFrame, radius: float, seed: int = 0) -> DataFrame:
    """Pairs of both geometries with memberships frozen: patches and halves come from the records as they were before."""
    from scanloom.operators.clouds import split_halves

    small = centres.select(F.col("point_id").alias("patch"), "x", "y", "z")
    held = split_halves(radius_join(small, before.select("point_id", "x", "y", "z"), radius).select("patch", F.col("point_id_b").alias("point_id")), seed)
    own = lambda cloud: _score_members(held.join(cloud.select("point_id", "x", "y", "z"), "point_id"))
    return summarize_pairs(own(before), own(after))


def _score_members(rows: DataFrame) -> DataFrame:
    fit = plane_fit(rows.where("split = 'train'"), ("patch",)).drop("n")
    d = F.abs(sum((F.col(f"n{c}") * (F.col(c) - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0))) * 1000
    held = rows.where("split = 'test'").join(fit, "patch").withColumn("_d", d)
    return held.groupBy("patch").agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmse_mm"), F.percentile("_d", F.lit(0.9)).alias("p90_mm"), *[F.first(f"n{c}").alias(f"n{c}") for c in "xyz"])


def promote(results: DataFrame) -> DataFrame:
    """The candidate of least error among those that improved."""
    return results.where("improved").agg(F.min_by("candidate", "rmse_after").alias("candidate"), F.min("rmse_after").alias("rmse_after"))


def loop_candidates(nodes: DataFrame, seconds: float = 25.0, distance: float = 16.0, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Pairs of nodes i < j of a session that lie near each other but not in time."""
    pairs = radius_join(nodes, nodes, distance, keys)
    return pairs.where((F.col("node_b") > F.col("node")) & (F.col("t_b") - F.col("t") >= seconds)).select(*keys, F.col("node").alias("i"), F.col("node_b").alias("j"), F.col("d").alias("distance"), (F.col("t_b") - F.col("t")).alias("dt"))


#: Open pairs of a series that are decided in order in one task (some 100 bytes each); longer series are thinned by rounds first.
IN_ORDER = 50_000


def greedy_cap(pairs: DataFrame, cap: int, keys: Sequence[str] = ("session",), in_order: int = IN_ORDER) -> DataFrame:
    """Pairs of two nodes in order of distance, then longest apart in time; one is accepted while both its nodes have fewer than cap.

    A series with at most in_order open pairs is walked in that order by one task, so chains of pairs that wait for each
    other cost no rounds. Of longer series, a round accepts a pair once, at both nodes, no more pairs before it are open
    than the node has room for; then nothing that is still open can stop it. Open pairs of full nodes are not accepted.
    The first open pair is always decided. Each round ranks the pairs of one node, never those of a whole series.
    """
    order = ["distance", "_l", "i", "j", "_id"]
    left = checkpoint(pairs.withColumns({"_id": F.monotonically_increasing_id(), "_l": -F.col("dt"), "_ri": F.lit(cap), "_rj": F.lit(cap)}))
    group, names = list(keys) or [F.lit(0).alias("_all")], pairs.columns
    out = None

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        room: dict = {}
        for end in "ij":
            room |= dict(zip(rows[end].tolist(), rows[f"_r{end}"].tolist(), strict=True))
        taken = []
        for i, j in zip(rows["i"].tolist(), rows["j"].tolist(), strict=True):
            good = room[i] > 0 and room[j] > 0
            if good:
                room[i] -= 1
                room[j] -= 1
            taken.append(good)
        return rows[names].assign(accepted=taken)

    while not left.isEmpty():
        few = left.groupBy(*group).agg(F.count("*").alias("_few")).where(F.col("_few") <= in_order)
        if keys:
            now = left.join(few, list(keys), "left_semi")
        else:
            now = left.crossJoin(F.broadcast(few.select("_few"))).drop("_few")  # one row, or none
        done = checkpoint(now.groupBy(*group).applyInPandas(walk, T.StructType([*pairs.schema.fields, T.StructField("accepted", T.BooleanType())])))
        out = done if out is None else out.unionByName(done)
        left = left.join(few, list(keys), "left_anti") if keys else (left if few.isEmpty() else left.limit(0))
        if left.isEmpty():
            break
        ends = left.select(*keys, *order, F.explode(F.array(F.struct(F.col("i").alias("node"), F.col("_ri").alias("room")), F.struct(F.col("j").alias("node"), F.col("_rj").alias("room")))).alias("_e")).select(*keys, *order, "_e.*")
        place = F.row_number().over(Window.partitionBy(*keys, "node").orderBy(*order))
        free = ends.withColumn("_ok", place <= F.col("room")).groupBy("_id").agg(F.min("_ok").alias("_free"), F.min("room").alias("_room"))
        now = checkpoint(left.join(free, "_id").withColumn("accepted", F.when(F.col("_room") <= 0, False).when(F.col("_free"), True)))
        out = out.unionByName(now.where("accepted is not null").select(*pairs.columns, "accepted"))
        taken = now.where("accepted").select(*keys, F.explode(F.array("i", "j")).alias("_n")).groupBy(*keys, "_n").agg(F.count("*").alias("_t"))
        left = now.where("accepted is null").drop("accepted", "_free", "_room")
        for end in "ij":
            own = taken.select(*keys, F.col("_n").alias(end), "_t")
            left = left.join(own, [*keys, end], "left").withColumn(f"_r{end}", (F.col(f"_r{end}") - F.coalesce("_t", F.lit(0))).cast("int")).drop("_t")
        left = checkpoint(left)
    return pairs.limit(0).withColumn("accepted", F.lit(False)) if out is None else out
