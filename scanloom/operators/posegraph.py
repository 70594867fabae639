"""Pose graphs with turns and shifts, edges between nodes and surfaces seen from several nodes.

A step is one sparse system over all sessions. A node has six unknowns, a turn and a shift in its own frame; a surface patch has
three, its plane's height and two slopes. The planes stay unknowns of the system, which gives the nodes what projecting
them out would, without a block for every two nodes that see one patch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions import geometry as geo
from scanloom.operators.lineage import checkpoint
from scanloom.operators.registration import edge_residuals
from scanloom.operators.solve import HELD, conjugate_gradient
from scanloom.operators.spatial import plane_fit

_POSE = ("px", "py", "pz", "qx", "qy", "qz", "qw")
#: Standard deviations of an edge's shift (m) and turn (rad): by odometry, and by a loop.
SIGMAS = {"odometry": (0.10, np.radians(0.8)), "loop": (0.02, np.radians(0.2))}


def _matrices(q: np.ndarray) -> np.ndarray:
    x, y, z, w = (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    flat = [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]
    return np.stack(flat, 1).reshape(-1, 3, 3)


def _cross(v: np.ndarray) -> np.ndarray:
    """The matrices that take the cross product with each vector."""
    x, y, z = v.T
    o = np.zeros(len(v))
    return np.stack([o, -z, y, z, o, -x, -y, x, o], 1).reshape(-1, 3, 3)


def _vectors(r: np.ndarray) -> np.ndarray:
    """Rotation vectors of matrices, by their quaternions' largest part."""
    t = np.trace(r, axis1=1, axis2=2)
    own = np.stack([r[:, 0, 0], r[:, 1, 1], r[:, 2, 2], t], 1)
    table = np.zeros((len(r), 4, 4))
    for k in range(3):
        table[:, k, k] = 1 + 2 * r[:, k, k] - t
        table[:, k, 3] = table[:, 3, k] = r[:, (k + 2) % 3, (k + 1) % 3] - r[:, (k + 1) % 3, (k + 2) % 3]
        table[:, k, (k + 1) % 3] = table[:, (k + 1) % 3, k] = r[:, k, (k + 1) % 3] + r[:, (k + 1) % 3, k]
    table[:, 3, 3] = 1 + t
    q = np.take_along_axis(table, own.argmax(1)[:, None, None], 1)[:, 0]
    q = q / np.linalg.norm(q, axis=1, keepdims=True) * np.where(q[:, 3:] < 0, -1, 1)
    sine = np.linalg.norm(q[:, :3], axis=1)
    return q[:, :3] * np.where(sine > 1e-12, 2 * np.arctan2(sine, q[:, 3]) / np.maximum(sine, 1e-12), 2.0)[:, None]


def _unroll(v: np.ndarray) -> np.ndarray:
    """How a rotation vector grows with a turn that is put on its right."""
    angle, cross = np.linalg.norm(v, axis=1), _cross(v)
    half = np.maximum(angle, 1e-4) / 2
    second = np.where(angle < 1e-4, 1 / 12, (1 - half / np.tan(half)) / (2 * half) ** 2)
    return np.eye(3) + cross / 2 + second[:, None, None] * (cross @ cross)


def edge_blocks(a: np.ndarray, b: np.ndarray, measured: np.ndarray, sigmas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals (6 each: shift, turn) over their deviations, and their derivatives by the unknowns of both nodes. Poses: px .. qw."""
    ra, rb, rm = (_matrices(p[:, 3:]) for p in (a, b, measured))
    back = ra.transpose(0, 2, 1)
    apart = np.einsum("mij,mj->mi", back, b[:, :3] - a[:, :3])
    between = back @ rb
    turn = _vectors(rm.transpose(0, 2, 1) @ between)
    grown = _unroll(turn)
    ja, jb = np.zeros((2, len(a), 6, 6))
    ja[:, :3, :3], ja[:, :3, 3:], ja[:, 3:, :3] = _cross(apart), -np.eye(3), -grown @ between.transpose(0, 2, 1)
    jb[:, :3, 3:], jb[:, 3:, :3] = between, grown
    scale = np.repeat(1 / sigmas, 3, 1)
    return np.concatenate([apart - measured[:, :3], turn], 1) * scale, ja * scale[:, :, None], jb * scale[:, :, None]


def _sides(rows: DataFrame, nodes: DataFrame, keys: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """rows with the poses (a_*, b_*) of two nodes and whether each is its session's first, which is held."""
    first = nodes.groupBy(*keys).agg(F.min("node").alias("_first"))
    marked = nodes.join(first, list(keys))
    for prefix, name in zip("ab", names, strict=True):
        own = marked.select(*keys, F.col("node").alias(name), *[F.col(c).cast("double").alias(f"{prefix}_{c}") for c in _POSE], (F.col("node") == F.col("_first")).alias(f"{prefix}_held"))
        rows = rows.join(own, [*keys, name])
    return rows


def _emit(rows: pd.DataFrame, keys: Sequence[str], parts: list[tuple[str, str, int, np.ndarray | None]], products: np.ndarray, right: np.ndarray) -> Iterator[pd.DataFrame]:
    """The cells of products (a matrix a row of rows) and right sides by unknown; parts: kind, id column, width and which rows hold it fixed."""
    at = np.cumsum([0, *[w for _, _, w, _ in parts]])

    def table(cells: np.ndarray, k: int, other: int | None) -> pd.DataFrame:
        kind, name, width, held = parts[k]
        free = np.ones(len(rows), bool) if held is None else ~held
        if other is not None and parts[other][3] is not None:
            free = free & ~parts[other][3]
        own, size = rows[free], width * (1 if other is None else parts[other][2])
        out = {c: own[c].repeat(size).to_numpy() for c in keys} | {"ik": kind, "i": own[name].repeat(size).to_numpy()}
        if other is None:
            out |= {"ia": np.tile(np.arange(width), len(own)), "jk": None, "j": 0, "ja": 0}
        else:
            out |= {"ia": np.tile(np.repeat(np.arange(width), parts[other][2]), len(own)), "jk": parts[other][0], "j": own[parts[other][1]].repeat(size).to_numpy(), "ja": np.tile(np.tile(np.arange(parts[other][2]), width), len(own))}
        return pd.DataFrame(out | {"a": cells[free].ravel()})

    for k in range(len(parts)):
        yield table(right[:, at[k] : at[k + 1]], k, None)
        for other in range(len(parts)):
            yield table(products[:, at[k] : at[k + 1], at[other] : at[other + 1]], k, other)


def _schema(nodes: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(nodes.dtypes)
    return "".join(f"`{k}` {kinds[k]}, " for k in keys) + "ik string, i long, ia int, jk string, j long, ja int, a double"


def edge_system(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ("session",), sigmas: dict[str, tuple[float, float]] = SIGMAS) -> DataFrame:
    """Cells (jk not null) and right sides of the edges' normal equations."""
    both = _sides(edges.select(*keys, "i", "j", "kind", *_POSE), nodes, keys, ("i", "j"))

    def cells(batches):
        for rows in batches:
            a, b = (rows[[f"{p}_{c}" for c in _POSE]].to_numpy(float) for p in "ab")
            of = np.array([sigmas["loop" if kind == "loop" else "odometry"] for kind in rows["kind"]]).reshape(-1, 2)
            r, ja, jb = edge_blocks(a, b, rows[list(_POSE)].to_numpy(float), of)
            j = np.concatenate([ja, jb], 2)
            yield from _emit(rows, keys, [("n", "i", 6, rows["a_held"].to_numpy(bool)), ("n", "j", 6, rows["b_held"].to_numpy(bool))], j.transpose(0, 2, 1) @ j, -np.einsum("mri,mr->mi", j, r))

    return both.mapInPandas(cells, _schema(nodes, keys))


def plane_system(nodes: DataFrame, points: DataFrame, keys: Sequence[str] = ("session",), sigma: float = 0.02) -> DataFrame:
    """Likewise of the patches: points (patch, x, y, z in the world, lo, hi, u) move with the nodes lo and hi by the shares 1 - u and u.

    A patch's rows weigh 1 / sigma squared together. Batches are summed by patch and nodes before they leave their task.
    """
    fit = plane_fit(points, (*keys, "patch")).where("n >= 4")
    both = _sides(points.select(*keys, "patch", "x", "y", "z", "lo", "hi", "u").join(fit.select(*keys, "patch", "n", "cx", "cy", "cz", "nx", "ny", "nz"), [*keys, "patch"]), nodes, keys, ("lo", "hi"))

    def cells(batches):
        for rows in batches:
            n, p = rows[["nx", "ny", "nz"]].to_numpy(float), rows[["x", "y", "z"]].to_numpy(float)
            off, share = p - rows[["cx", "cy", "cz"]].to_numpy(float), rows["u"].to_numpy(float)
            side = np.cross(n, np.eye(3)[np.abs(n).argmin(1)])
            side /= np.linalg.norm(side, axis=1, keepdims=True)
            j = []
            for prefix, weight in (("a", 1 - share), ("b", share)):
                r = _matrices(rows[[f"{prefix}_q{c}" for c in "xyzw"]].to_numpy(float))
                arm = np.cross(p - rows[[f"{prefix}_p{c}" for c in "xyz"]].to_numpy(float), n)
                j += [np.einsum("mi,mij->mj", arm, r) * weight[:, None], np.einsum("mi,mij->mj", n, r) * weight[:, None]]
            j = np.concatenate([*j, np.ones((len(n), 1)), (off * side).sum(1)[:, None], (off * np.cross(n, side)).sum(1)[:, None]], 1)
            scale = 1 / (sigma * np.sqrt(rows["n"].to_numpy(float)))
            j, e = j * scale[:, None], (off * n).sum(1) * scale
            group = rows.groupby([*keys, "patch", "lo", "hi"], sort=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.diff(group[order], prepend=-1))
            j, e, held = j[order], e[order], rows.iloc[order[edges]].reset_index(drop=True)
            right = np.add.reduceat(-j * e[:, None], edges) if len(edges) else np.zeros((0, 15))
            ends = [*edges[1:], len(order)]
            products = np.stack([j[a:b].T @ j[a:b] for a, b in zip(edges, ends, strict=True)]) if len(edges) else np.zeros((0, 15, 15))
            yield from _emit(held, keys, [("n", "lo", 6, held["a_held"].to_numpy(bool)), ("n", "hi", 6, held["b_held"].to_numpy(bool)), ("p", "patch", 3, None)], products, right)

    return both.mapInPandas(cells, _schema(nodes, keys))


def graph_step(nodes: DataFrame, edges: DataFrame, points: DataFrame | None = None, damping: DataFrame | None = None, keys: Sequence[str] = ("session",), sigma: float = 0.02, held: int = HELD) -> DataFrame:
    """keys, node, w0 .. w2 (turn) and u0 .. u2 (shift), in the node's own frame: one damped Gauss-Newton step of all sessions.

    damping: keys and lam, the share by which a session's diagonal grows. The first node of each session, nodes that nothing
    names, and edges or points without their nodes have no part.
    """
    cells = edge_system(nodes, edges, keys)
    cells = checkpoint(cells if points is None else cells.unionByName(plane_system(nodes, points, keys, sigma)))
    name = lambda c: F.struct(*keys, F.col(f"{c}k").alias("kind"), F.col(c).alias("id"), F.col(f"{c}a").alias("axis"))
    entries = cells.where("jk is not null").groupBy(*keys, "ik", "i", "ia", "jk", "j", "ja").agg(F.sum("a").alias("a"))
    own = (F.col("ik") == "n") & (F.col("jk") == "n") & (F.col("i") == F.col("j")) & (F.col("ia") == F.col("ja"))
    grow = F.lit(0.0)
    if damping is not None:
        entries, grow = entries.join(damping.select(*keys, "lam"), list(keys), "left"), F.coalesce("lam", F.lit(0.0))
    entries = entries.select(name("i").alias("_i"), name("j").alias("_j"), F.when(own, F.col("a") * (1 + grow) + 1e-9).otherwise(F.col("a")).alias("a")).withColumnsRenamed({"_i": "i", "_j": "j"})
    right = cells.where("jk is null").select(name("i").alias("_i"), F.col("a").alias("b")).withColumnRenamed("_i", "i")
    found = conjugate_gradient(entries, right, held=held).where("i.kind = 'n'")
    return found.groupBy(*[F.col(f"i.{k}").alias(k) for k in keys], F.col("i.id").alias("node")).agg(*[F.max(F.when(F.col("i.axis") == k, F.col("x"))).alias(c) for k, c in enumerate(("w0", "w1", "w2", "u0", "u1", "u2"))])


def move_nodes(nodes: DataFrame, step: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Nodes after a step; those without one stay."""
    met = nodes.join(step, [*keys, "node"], "left").fillna(0.0, ["w0", "w1", "w2", "u0", "u1", "u2"])
    angle = F.sqrt(F.col("w0") * F.col("w0") + F.col("w1") * F.col("w1") + F.col("w2") * F.col("w2"))
    sine = F.when(angle > 1e-12, F.sin(angle / 2) / angle).otherwise(0.5)
    q = geo.quaternion("qx", "qy", "qz", "qw")
    x, y, z = geo.quat_rotate(q, "u0", "u1", "u2")
    turned = geo.quat_mul(q, geo.quaternion(F.col("w0") * sine, F.col("w1") * sine, F.col("w2") * sine, F.cos(angle / 2)))
    out = {"px": F.col("px") + x, "py": F.col("py") + y, "pz": F.col("pz") + z}
    return met.withColumns({"_q": turned, **{f"_{c}": v for c, v in out.items()}}).select(*[F.col(f"_{c}").alias(c) if c in out else F.col(f"_q.{c[1]}").alias(c) if c in _POSE else F.col(c) for c in nodes.columns])


def place_points(points: DataFrame, before: DataFrame, after: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """points moved as their two nodes moved, each by its share."""
    out, sums = points, [F.lit(0.0)] * 3
    for name, weight in (("lo", 1 - F.col("u")), ("hi", F.col("u"))):
        both = before.select(*keys, F.col("node").alias(name), F.struct(*_POSE).alias(f"_{name}0")).join(after.select(*keys, F.col("node").alias(name), F.struct(*_POSE).alias(f"_{name}1")), [*keys, name])
        out = out.join(both, [*keys, name])
        old, new = (geo.quaternion(*[F.col(f"_{name}{k}.q{c}") for c in "xyzw"]) for k in (0, 1))
        turn = geo.quat_mul(new, geo.quat_inv(old))
        moved = geo.quat_rotate(turn, *[F.col(c) - F.col(f"_{name}0.p{c}") for c in "xyz"])
        sums = [s + weight * (m + F.col(f"_{name}1.p{c}")) for s, m, c in zip(sums, moved, "xyz", strict=True)]
    return out.select(*[s.alias(c) for s, c in zip(sums, "xyz", strict=True)], *[c for c in points.columns if c not in "xyz"])


def graph_cost(nodes: DataFrame, edges: DataFrame, points: DataFrame | None = None, keys: Sequence[str] = ("session",), sigma: float = 0.02) -> DataFrame:
    """keys and cost: squared residuals of the edges, and of the points off their patches' best planes."""
    parts = edge_residuals(nodes, edges, keys).select(*keys, "cost")
    if points is not None:
        parts = parts.unionByName(plane_fit(points, (*keys, "patch")).where("n >= 4").select(*keys, (F.col("l0") / sigma**2).alias("cost")))
    return parts.groupBy(*keys).agg(F.sum("cost").alias("cost"))


def refine_graph(nodes: DataFrame, edges: DataFrame, points: DataFrame | None = None, keys: Sequence[str] = ("session",), sigma: float = 0.02, rounds: int = 20, least: float = 1e-5, reach: float = 8.0, degrees: float = 20.0, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """Nodes after damped steps, and by session: cost before and after, the largest shift and turn, and whether it was accepted.

    Each session has its own damping: a tenth after a step that lowers its cost, tenfold (and the step undone) after one that
    doesn't. Ends when no session gains the share least any more. A session that a node would leave by more than reach metres
    or so many degrees stays as it was.
    """
    nodes = checkpoint(nodes.select(*keys, "node", *_POSE))
    now, at = nodes, points
    state = checkpoint(graph_cost(nodes, edges, points, keys, sigma).select(*keys, F.col("cost").alias("first"), "cost", F.lit(1e-4).alias("lam"), F.lit(True).alias("open")))
    for _ in range(rounds):
        going = state.where("open")
        live = now.join(going.select(*keys), list(keys), "left_semi")
        step = graph_step(live, edges, at, going, keys, sigma, held)
        tried = checkpoint(move_nodes(now, step, keys))
        then = None if points is None else checkpoint(place_points(points, nodes, tried, keys))
        cost = graph_cost(tried, edges, then, keys, sigma).select(*keys, F.col("cost").alias("_new"))
        better = F.col("_new") < F.col("cost")
        gain = (F.col("cost") - F.col("_new")) / F.greatest(F.col("cost"), F.lit(1e-300))
        judged = checkpoint(state.join(cost, list(keys)).withColumns({"_good": F.col("open") & better, "_gain": gain}))
        chosen = judged.select(*keys, "_good")
        new = tried.select(*keys, "node", F.struct(*_POSE).alias("_n"))
        now = checkpoint(now.join(new, [*keys, "node"]).join(chosen, list(keys), "left").select(*keys, "node", *[F.when(F.coalesce("_good", F.lit(False)), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) for c in _POSE]))
        at = None if points is None else checkpoint(place_points(points, nodes, now, keys))
        still = F.col("open") & F.when(better, (F.col("_gain") > least) & (F.col("_new") > 1e-12)).otherwise(F.col("lam") < 1e8)
        state = checkpoint(judged.select(*keys, "first", F.when(F.col("_good"), F.col("_new")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.greatest(F.col("lam") / 10, F.lit(1e-8))).otherwise(F.col("lam") * 10).alias("lam"), still.alias("open")))
        if state.where("open").isEmpty():
            break
    old = nodes.select(*keys, "node", *[F.col(c).alias(f"_{c}") for c in _POSE])
    turn = geo.quat_mul(geo.quat_inv(geo.quaternion("_qx", "_qy", "_qz", "_qw")), geo.quaternion("qx", "qy", "qz", "qw"))
    far = now.join(old, [*keys, "node"]).withColumn("_t", turn)
    far = far.groupBy(*keys).agg(F.max(F.sqrt(sum((F.pow(F.col(f"p{c}") - F.col(f"_p{c}"), 2) for c in "xyz"), F.lit(0.0)))).alias("shift_m"), F.max(F.degrees(geo.quat_angle(F.col("_t")))).alias("turn_deg"))
    report = checkpoint(state.join(far, list(keys)).select(*keys, F.col("first").alias("cost_before"), F.col("cost").alias("cost_after"), "shift_m", "turn_deg", ((F.col("shift_m") <= reach) & (F.col("turn_deg") <= degrees)).alias("accepted")))
    ok = report.where("accepted").select(*keys, F.lit(True).alias("_ok"))
    final = now.select(*keys, "node", F.struct(*_POSE).alias("_n"))
    out = nodes.join(final, [*keys, "node"]).join(ok, list(keys), "left").select(*keys, "node", *[F.when(F.coalesce("_ok", F.lit(False)), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) for c in _POSE])
    return out, report
