"""Exact nearest neighbours by blocks of the target that follow its density.

Points at one place are one entry. Cells of the target that hold more than BLOCK places are parted into halves of their edge, again
and again; what is left are blocks (where places crowd beyond the last level, a cell's places are dealt into several by a hash).
A place of the source is compared with the block that it lies in. What it finds there bounds how far it must look: mostly no farther
than the block, else it goes, with that bound, to those other blocks whose tight boxes are within it. So a place of either side is
shuffled once, and those near the edges of blocks a few times more; no block travels to the places that ask it.

Places that find too little there descend in leaves of LEAF places through the target's cells: at each level, counts and boxes
bound the distance within which all places of a leaf must have found enough, and cells farther off go before they are
opened. Then they ask the blocks that are left. Without a gate, a leaf starts at the least ring of cells that provably
holds enough points, however far that is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scanloom.operators.lineage import checkpoint
from scanloom.operators.series import BROADCAST_ROWS, small

#: Places of a leaf of those that descend, of a block, and of a group that is compared at once, at most; rounds of parting at most; places that ask one block in a task, in the mean.
LEAF, BLOCK, GROUP, ROUNDS, ASKED = 64, 1024, 64, 16, 4096
#: Blocks that a place asks beside its own at most; where more lie within its bound, it descends.
BESIDE = 64
_CELL = ["l", "cx", "cy", "cz"]
_BLOCK = [*_CELL, "tp"]
_BOX = [f"{c}{e}" for c in "xyz" for e in (0, 1)]
_AROUND = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def around(df: DataFrame, names: Sequence[str] = ("cx", "cy", "cz")) -> DataFrame:
    """Each row 27 times, with its cell's numbers replaced by those of the cell and its neighbours."""
    steps = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(s, "ijk", strict=True)]) for s in _AROUND])
    out = df.withColumn("_s", F.explode(steps))
    return out.withColumns({c: F.col(c) + F.col(f"_s.{n}") for c, n in zip(names, "ijk", strict=True)}).drop("_s")


def _places(points: DataFrame, keys: Sequence[str], key: str, keep: int) -> DataFrame:
    """keys, x, y, z and the least so many ids (ids) that are there."""
    rows = points.select(*keys, key, *[F.col(c).cast("double").alias(c) for c in "xyz"]).where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in "xyz"))
    by = [*keys, "x", "y", "z"]
    if keep == 1:
        return rows.groupBy(*by).agg(F.array(F.min(key)).alias("ids"))
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(key))).where(F.col("_k") <= keep)
    return first.groupBy(*by).agg(F.array_sort(F.collect_list(key)).alias("ids"))


def _cell_of(level: int, unit: float) -> dict[str, Column]:
    """Cells of edge unit 2 ** level. Powers of two scale exactly, so the cells of one level nest in those of the next."""
    return {f"c{c}": F.floor(F.col(c) / unit * 2.0**-level).cast("long") for c in "xyz"}


class Tree:
    """Cells from level 0 (edges of a unit) down, and leaves of any level, with counts and boxes.

    A round parts crowded cells at half their edge, of which only leaves are kept, and what is crowded still at a quarter,
    or at once at about half of its widest box where that is smaller. Which leaf a place lies in follows from the crowded cells,
    so places are written again only where these are too many to be broadcast.
    """

    def __init__(self, places: DataFrame, unit: float, keys: Sequence[str], leaf: int = LEAF):
        self.places, self.keys, self.unit, self.leaf, self.by = places, list(keys), unit, leaf, [*keys, "cx", "cy", "cz"]
        box = [f(c).alias(f"{c}{e}") for c in "xyz" for e, f in enumerate((F.min, F.max))]
        left, self.levels, self.crowded, level, parent = places, {}, [], 0, 0
        for turn in range(2 * ROUNDS):
            half, last = turn % 2 == 1, turn == 2 * ROUNDS - 2
            keyed = left.withColumns(_cell_of(level, unit))
            cells = keyed.groupBy(*self.by).agg(F.count("*").alias("places"), F.sum(F.size("ids")).alias("n"), *box)
            cells = checkpoint(cells.withColumns({"leaf": (F.col("places") <= leaf) | F.lit(last), "l": F.lit(level), "pl": F.lit(parent if turn else 2)}))
            self.levels[level] = cells.where("leaf") if half else cells
            wide = cells.where("not leaf").agg(F.max(F.greatest(*[F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"]))).first()[0]
            if wide is None:
                break
            crowd = cells.where("not leaf").select(*self.by)
            few = crowd.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
            self.crowded.append((level, F.broadcast(crowd) if few else crowd))
            left = keyed.join(self.crowded[-1][1], self.by, "left_semi").select(*places.columns)
            left = left if few else checkpoint(left)
            if half:
                level = min(level - 1, math.frexp(wide / unit)[1] - 1)
            else:
                parent, level = level, level - 1
        self.last, self.cuts = level, list(self.levels)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with x, y and z and the cell (l, cx, cy, cz) that is a leaf there, or would be one."""
        out = rows.withColumn("l", F.lit(None).cast("int"))
        for level, crowd in self.crowded:
            out = out.withColumns(_cell_of(level, self.unit)).join(crowd.withColumn("_in", F.lit(True)), self.by, "left")
            out = out.withColumn("l", F.coalesce("l", F.when(F.col("_in").isNull(), F.lit(level)))).drop("_in", "cx", "cy", "cz")
        out = out.withColumn("l", F.coalesce("l", F.lit(self.last)))
        return out.withColumns({f"c{c}": F.floor(F.col(c) / self.unit * F.pow(F.lit(2.0), -F.col("l"))).cast("long") for c in "xyz"})

    def nodes(self) -> DataFrame:
        """All cells that have been built, with the level of the cell that each is a part of (pl)."""
        out = None
        for cells in self.levels.values():
            rows = cells.select(*self.keys, *_CELL, "pl", "places", "n", *_BOX, "leaf")
            out = rows if out is None else out.unionByName(rows)
        return out

    def blocks(self) -> DataFrame:
        """The leaves' parts (tp) with the leaf's box."""
        return self.nodes().where("leaf").select(*self.keys, *_CELL, F.explode(F.sequence(F.lit(0), F.ceil(F.col("places") / self.leaf).cast("int") - 1)).alias("tp"), *_BOX)

    def held(self) -> DataFrame:
        """The places with their block."""
        rows = self.dealt(self.places)
        over = self.levels[self.last].where((F.col("places") > self.leaf) & F.col("leaf")).select(*self.by, "l", F.ceil(F.col("places") / self.leaf).alias("_parts"))
        if over.isEmpty():
            return rows.withColumn("tp", F.lit(0))
        part = F.pmod(F.xxhash64("x", "y", "z"), F.coalesce("_parts", F.lit(1))).cast("int")
        return rows.join(small(over), [*self.by, "l"], "left").withColumn("tp", part).drop("_parts")

    def beside(self) -> DataFrame:
        """The blocks whose boxes are no farther from a leaf's cell (tp 0) than its edge, the other's number in o and its box in box."""
        own = self.nodes().where("leaf").select(*self.keys, *_CELL)
        other = self.blocks().select(*self.keys, F.struct(*_BLOCK).alias("o"), F.array(*_BOX).alias("box"))
        mine = own.withColumns({f"m{c}": F.col(c) for c in _CELL})
        at = [*self.keys, "l", "cx", "cy", "cz"]
        cuts = F.explode(F.array(*map(F.lit, self.cuts)))
        finer = other.withColumn("l", cuts).where("l >= o.l").withColumns({c: F.expr(f"shiftright(o.{c}, l - o.l)") for c in ("cx", "cy", "cz")})
        wider = mine.withColumn("l", cuts).where("l > ml")
        for c in ("cx", "cy", "cz"):
            wider = wider.withColumn(c, F.explode(F.expr(f"sequence(shiftright(m{c} - 1, l - ml), shiftright(m{c} + 1, l - ml))")))
        met = around(mine).join(finer, at).unionByName(wider.join(other.withColumns({c: F.col(f"o.{c}") for c in _CELL}), at))
        edge = self.unit * F.pow(F.lit(2.0), F.col("ml"))
        gap = [F.greatest(F.lit(0.0), F.col("box")[2 * k] - (F.col(f"mc{c}") + 1) * edge, F.col(f"mc{c}") * edge - F.col("box")[2 * k + 1]) for k, c in enumerate("xyz")]
        same = (F.col("o.tp") == 0) & (F.col("o.l") == F.col("ml"))
        for c in ("cx", "cy", "cz"):
            same = same & (F.col(f"o.{c}") == F.col(f"m{c}"))
        return met.where((F.sqrt(sum((v * v for v in gap), F.lit(0.0))) <= edge) & ~same).select(*self.keys, *[F.col(f"m{c}").alias(c) for c in _CELL], F.lit(0).alias("tp"), "o", "box")

    def up(self, level: int) -> DataFrame:
        """The cells of an even level above 0, from those two levels below."""
        if level not in self.levels:
            parts = self.up(level - 2).withColumns({c: F.shiftright(c, 2) for c in ("cx", "cy", "cz")})
            cells = parts.groupBy(*self.keys, "cx", "cy", "cz").agg(F.sum("places").alias("places"), F.sum("n").alias("n"), *[(F.min if c[1] == "0" else F.max)(c).alias(c) for c in _BOX])
            self.levels[level] = checkpoint(cells.withColumn("leaf", F.lit(False)).withColumns({"l": F.lit(level), "pl": F.lit(level + 2)}))
        return self.levels[level]


def plant(target: DataFrame, unit: float, keep: int = 1, key: str = "point_id", keys: Sequence[str] = ()) -> Tree:
    """A tree that serves several searches; places keep so many ids."""
    return Tree(checkpoint(_places(target, keys, key, keep)), unit, keys, BLOCK)


def _at_level(level: int) -> dict[str, Column]:
    """The cell of a level that holds a leaf's cell."""
    return {c: F.expr(f"shiftright(q{c}, {level} - ql)") for c in ("cx", "cy", "cz")}


def _start(asked: DataFrame, target: Tree, need: int, unit: float) -> DataFrame:
    """Leaves of the source with the cells about them that hold all that they may need, and a first bound of its distance (u).

    If the 27 cells about a leaf hold enough points, these lie within two cells' diagonals; the 27 cells of the level of
    four times that edge reach farther than that. The last level is the one whose cells all touch each other.
    """
    keys, out, level = target.keys, None, 0
    while True:
        cells = target.up(level)
        least, most = cells.agg(F.least(*[F.min(c) for c in ("cx", "cy", "cz")]), F.greatest(*[F.max(c) for c in ("cx", "cy", "cz")])).first()
        last = least is None or (least >= -1 and most <= 0)
        own = asked.withColumns(_at_level(level))
        if last:
            found, level_up, bound = own, level, F.lit(math.inf)
        else:
            seen = around(own.select(*keys, "cx", "cy", "cz").distinct().withColumns({f"o{c}": F.col(f"c{c}") for c in "xyz"}))
            held = seen.join(cells.select(*keys, "cx", "cy", "cz", "n"), [*keys, "cx", "cy", "cz"]).groupBy(*keys, *[F.col(f"o{c}").alias(f"c{c}") for c in "xyz"]).agg(F.sum("n").alias("_n"))
            own = checkpoint(own.join(held, [*keys, "cx", "cy", "cz"], "left").withColumn("_ok", F.coalesce(F.col("_n") >= need, F.lit(False))))
            found, level_up, bound = own.where("_ok"), level + 2, F.lit(2 * math.sqrt(3) * unit * 2.0**level)
        above = target.up(level_up)
        rows = around(found.select(*asked.columns).withColumns(_at_level(level_up))).join(above.select(*keys, *_CELL, "n", *_BOX, "leaf"), [*keys, "cx", "cy", "cz"]).withColumn("u", bound)
        out = rows if out is None else out.unionByName(rows)
        if last:
            return out
        asked = own.where("not _ok").select(*asked.columns)
        if asked.isEmpty():
            return out
        level += 2


def _near_far() -> tuple[Column, Column]:
    """Least and greatest distance of the boxes of a leaf (q) and a cell."""
    gap = [F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(f"q{c}1"), F.col(f"q{c}0") - F.col(f"{c}1")) for c in "xyz"]
    span = [F.greatest(F.col(f"{c}1") - F.col(f"q{c}0"), F.col(f"q{c}1") - F.col(f"{c}0")) for c in "xyz"]
    return tuple(F.sqrt(sum((v * v for v in side), F.lit(0.0))) for side in (gap, span))


def _pruned(rows: DataFrame, q: Sequence[str], need: int) -> DataFrame:
    """The cells that may hold what a leaf needs. All its points have found enough within the reach of the nearest cell that has enough."""
    near, far = _near_far()
    reach = F.min(F.when(F.col("n") >= need, far)).over(Window.partitionBy(*q))  # the cells about one leaf
    held = rows.withColumn("u", F.least("u", reach))
    return held.where(near <= F.col("u") * (1 + 1e-9)).select(*q, "u", *_CELL, "n", *_BOX, "leaf")


class _Best:
    """What the places of one group have found so far: kth is the distance of the need-th best of each, or its bound."""

    def __init__(self, places: np.ndarray, limit: np.ndarray, need: int):
        self.places, self.need = places, need
        self.best, self.kth = np.repeat(limit[:, None], need, 1), limit.copy()
        self.entries: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def look(self, other: np.ndarray, ids: np.ndarray, edges: np.ndarray) -> None:
        """edges: where the ids of each of the other places begin in ids."""
        gap = self.places[:, None, :] - other[None, :, :]
        gap *= gap
        d = np.sqrt(gap[:, :, 0] + gap[:, :, 1] + gap[:, :, 2])
        x, y = np.nonzero(d <= self.kth[:, None])
        if not len(x):
            return
        sizes = np.diff(edges)[y]
        at = np.repeat(np.arange(len(x)), sizes)
        held = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(edges[:-1][y], sizes)
        self.entries.append((x[at], d[x, y][at], ids[held], other[y][at]))
        self.best = np.partition(np.concatenate([self.best, d], 1), self.need - 1, axis=1)[:, : self.need]
        self.kth = self.best.max(1)

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """place, distance, id and coordinates of the need nearest of each place, by distance, then id."""
        if not self.entries:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object), np.zeros((0, 3))
        x, d, ids, xyz = (np.concatenate([e[k] for e in self.entries]) for k in range(4))
        keep = d <= self.kth[x]
        x, d, ids, xyz = x[keep], d[keep], ids[keep], xyz[keep]
        order = np.lexsort((ids, d, x)) if ids.dtype != object else np.array(sorted(range(len(x)), key=lambda i: (x[i], d[i], ids[i])), np.int64)
        mine = x[order]
        first = np.arange(len(mine)) - np.searchsorted(mine, mine) < self.need
        return mine[first], d[order][first], ids[order][first], xyz[order][first]


def _groups(places: np.ndarray) -> list[np.ndarray]:
    """Rows of places in groups of GROUP at most, cut in halves along the widest side."""
    left, out = [np.arange(len(places))] if len(places) else [], []
    while left:
        rows = left.pop()
        if len(rows) <= GROUP:
            out.append(rows)
            continue
        own = places[rows]
        order = np.argpartition(own[:, np.ptp(own, 0).argmax()], len(rows) // 2)
        left += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def _look(names: list[str], kinds: list[pa.DataType], asks: pa.DataType, near: pa.DataType, need: int, unit: float, told: str):
    """What the places that ask a block (kind 0, with their bound u) find among its own (kind 1).

    told: "asks" gives those that must ask other blocks (kind 2), with their bound and blocks, its own too, or with no block where they
    must descend; "inner" what the others find; "all" what all find here.
    """

    def emit(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        kind = table.column("kind").to_numpy()
        asked, own, beside = (np.flatnonzero(kind == k) for k in range(3))
        if told == "asks":
            fields = [*zip(names, kinds, strict=True), *((c, pa.float64()) for c in "xyzu"), ("asks", asks)]
        else:
            fields = [*zip(names, kinds, strict=True), *((c, pa.float64()) for c in "xyz"), ("near", near)]
        schema = pa.schema(fields)
        if not len(asked):
            return schema.empty_table()
        xyz = np.stack([table.column(c).to_numpy() for c in "xyz"], 1)
        parts = _groups(xyz[own])
        own = own[np.concatenate(parts)] if parts else own
        a, b, limit = xyz[asked], xyz[own], table.column("u").to_numpy()[asked]
        edges = np.cumsum([0, *map(len, parts)])
        low, high = (np.array([f(b[i:j], 0) for i, j in zip(edges, edges[1:])]).reshape(-1, 3) for f in (np.min, np.max))
        held = table.column("ids").take(pa.array(own)).combine_chunks()
        ids, id_edges = held.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())])
        if told == "asks":
            ids, id_edges = ids[:0], np.zeros(len(own) + 1, np.int64)  # only distances count
        kth, states = limit.copy(), []
        for mine in _groups(a):
            state = _Best(a[mine], limit[mine], need)
            gap = np.maximum(0.0, np.maximum(low - a[mine].max(0), a[mine].min(0) - high))
            gap = np.sqrt((gap * gap).sum(1))
            for g in np.argsort(gap, kind="stable"):
                if gap[g] > state.kth.max() * (1 + 1e-9):
                    break
                i, j = edges[g], edges[g + 1]
                state.look(b[i:j], ids[id_edges[i] : id_edges[j]], id_edges[i : j + 1] - id_edges[i])
            kth[mine] = state.kth
            states.append((mine, state))
        keys = [table.column(c)[0].as_py() for c in names]

        def rows(of: np.ndarray, *more: pa.Array) -> pa.Table:
            return pa.Table.from_arrays([*(pa.array([k] * len(of), t) for k, t in zip(keys, kinds, strict=True)), *(pa.array(a[of, k]) for k in range(3)), *more], schema=schema)

        reach = unit * 2.0 ** table.column("l")[0].as_py() * 0.999 if len(own) else 0.0  # all blocks within it are listed; a thousandth is for rounding
        far = ~(kth <= reach)
        if told != "all":
            boxes = table.column("box").take(pa.array(beside)).combine_chunks().flatten().to_numpy().reshape(-1, 6)
            over = np.zeros((len(a), len(boxes)), bool)
            for at in range(0, len(a), 256):
                part = a[at : at + 256, None, :]
                gap = np.maximum(0.0, np.maximum(boxes[None, :, 0::2] - part, part - boxes[None, :, 1::2]))
                over[at : at + 256] = np.sqrt((gap * gap).sum(2)) <= kth[at : at + 256, None] * (1 + 1e-9)
            far |= over.sum(1) > BESIDE
            over[far] = False
            wait = far | over.any(1)
        if told == "asks":
            of = np.flatnonzero(wait)
            at, which = np.nonzero(over[of])
            mine = np.flatnonzero(~far[of])
            listed = pa.concat_arrays([table.column("o").take(pa.array(beside[which])).combine_chunks().cast(asks.value_type), pa.StructArray.from_arrays([table.column(c).take(pa.array(np.repeat(0, len(mine)))).combine_chunks().cast(asks.value_type.field(k).type) for k, c in enumerate(_BLOCK)], fields=list(asks.value_type))])
            order = np.argsort(np.concatenate([at, mine]), kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate([at, mine]), minlength=len(of)))])
            return rows(of, pa.array(kth[of]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed.take(pa.array(order)), type=asks))
        found = [(mine, *state.close()) for mine, state in states]
        x, d, listed, place = (np.concatenate(f) for f in ([mine[x] for mine, x, *_ in found], *([f[k] for f in found if len(f[1])] or [f[k] for f in found] for k in (2, 3, 4))))
        if told == "inner":
            keep = ~wait[x]
            x, d, listed, place = x[keep], d[keep], listed[keep], place[keep]
        order = np.argsort(x, kind="stable")
        entries = pa.StructArray.from_arrays([pa.array(d[order]), pa.array(listed[order], near.value_type.field(1).type), *(pa.array(place[order, k]) for k in range(3))], fields=list(near.value_type))
        counts = np.bincount(x, minlength=len(a))
        of = np.flatnonzero(counts)
        return rows(of, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[of])]), pa.int32()), entries, type=near))

    return emit


def _meet(asked: DataFrame, tree: Tree, beside: DataFrame | None) -> DataFrame:
    """Rows of places that ask (x, y, z and u, and their block), of the places of these blocks, and of the blocks beside them, by block and _part.

    Where many ask one block they are dealt into parts, which all get what they ask.
    """
    by, columns = [*tree.keys, *_BLOCK], [*tree.keys, *_BLOCK, "kind", "x", "y", "z", "u", "ids", "o", "box"]
    blank = {"x": "double", "y": "double", "z": "double", "u": "double", "ids": tree.places.schema["ids"].dataType.simpleString(), "o": "struct<l:int,cx:bigint,cy:bigint,cz:bigint,tp:int>", "box": "array<double>"}

    def wide(rows: DataFrame, kind: int) -> DataFrame:
        return rows.withColumns({c: F.lit(None).cast(t) for c, t in blank.items() if c not in rows.columns}).withColumn("kind", F.lit(kind)).select(*columns)

    counts = checkpoint(asked.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > ASKED).select(*by, F.ceil(F.col("_n") / ASKED).cast("int").alias("_parts")))
    rest = wide(tree.held(), 1)
    if beside is not None:
        rest = rest.unionByName(wide(beside, 2))
    first = wide(asked, 0)
    if counts.isEmpty():
        out = first.unionByName(rest).withColumn("_part", F.lit(0))
    else:
        first = first.join(small(counts), by, "left").withColumn("_part", F.pmod(F.xxhash64("x", "y", "z"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
        rest = rest.join(small(counts), by, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        out = first.unionByName(rest)
    return out.repartition(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_part")  # by number: the work is in Python, and few bytes must not become one task


def nearest(source: DataFrame, target: DataFrame, k: int, key: str = "point_id", gate: float | None = None, unit: float | None = None, keys: Sequence[str] = (), extra: int = 0, tree: Tree | None = None) -> DataFrame:
    """keys, x, y, z of each place of the source, and near: its k + extra nearest target rows (d, id, x, y, z) by distance, then id.

    With a gate, only rows within it (included). The unit, by default the gate, is a guess of the distance at which enough is
    found: the tree begins with cells of four times that edge. It decides how many levels are built, not what is found.
    A tree of the target (`plant`) can be used again, for gates up to its unit, and for its own places as the source.
    Rows without three finite coordinates are left out. One place keeps its least k + extra ids. Repeated rows count each.
    """
    need, keys = k + extra, list(keys)
    unit = unit or gate
    if need < 1 or not unit or unit <= 0:
        raise ValueError("at least one neighbour, and a gate or unit above 0")
    target_tree = tree or plant(target, 4 * unit, need, key, keys)
    unit = target_tree.unit
    if gate is not None and gate > unit:
        raise ValueError("the tree's cells are smaller than the gate")
    named = " and ".join(f"`{c}` is not null" for c in keys) or "true"
    places = target_tree.places if source is target else checkpoint(_places(source, keys, key, 1))
    places = places.where(named).select(*keys, *"xyz")
    limit = F.lit(math.inf if gate is None else float(gate))
    by = [*keys, *_BLOCK, "_part"]
    kinds = [to_arrow_type(source.schema[c].dataType) for c in keys]
    entry = T.StructType().add("d", T.DoubleType()).add("id", target.schema[key].dataType).add("x_b", T.DoubleType()).add("y_b", T.DoubleType()).add("z_b", T.DoubleType())
    block = T.StructType().add("l", T.IntegerType()).add("cx", T.LongType()).add("cy", T.LongType()).add("cz", T.LongType()).add("tp", T.IntegerType())
    place = T.StructType([source.schema[c] for c in keys])
    for c in "xyz":
        place = place.add(c, T.DoubleType())
    near = T.StructType(list(place.fields)).add("near", T.ArrayType(entry))
    waits = T.StructType(list(place.fields)).add("u", T.DoubleType()).add("asks", T.ArrayType(block))
    look = lambda told: _look(keys, kinds, to_arrow_type(T.ArrayType(block)), to_arrow_type(T.ArrayType(entry)), need, unit, told)

    own = _meet(target_tree.dealt(places).withColumns({"tp": F.lit(0), "u": limit}), target_tree, target_tree.beside())
    waiting = checkpoint(own.groupBy(*by).applyInArrow(look("asks"), waits))
    asks = waiting.where(F.size("asks") > 0).select(*keys, *"xyz", "u", F.explode("asks").alias("_o")).select(*keys, *"xyz", "u", "_o.*")
    far = waiting.where(F.size("asks") == 0).drop("asks")
    if not far.isEmpty():
        asks = asks.unionByName(_descend(checkpoint(far), target_tree, need, gate))
    met = _meet(asks, target_tree, None).groupBy(*by).applyInArrow(look("all"), near)
    met = met.groupBy(*keys, *"xyz").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, need).alias("near"))  # need rows a block at most
    return own.groupBy(*by).applyInArrow(look("inner"), near).unionByName(met)


def _descend(places: DataFrame, target: Tree, need: int, gate: float | None) -> DataFrame:
    """The places (with a bound u) with each block that may hold what they need."""
    keys, unit = target.keys, target.unit
    source = Tree(places.withColumn("ids", F.array(F.lit(0))), unit, keys)
    q = [*keys, *[f"q{c}" for c in (*_CELL, *_BOX)]]
    asked = source.nodes().where("leaf").select(*keys, *[F.col(c).alias(f"q{c}") for c in (*_CELL, *_BOX)])
    if gate is not None:
        first = around(asked.withColumns(_at_level(0))).join(target.levels[0].select(*keys, *_CELL, "n", *_BOX, "leaf"), [*keys, "cx", "cy", "cz"]).withColumn("u", F.lit(float(gate)))
    else:
        first = _start(asked, target, need, unit)
    front = checkpoint(_pruned(first, q, need))
    parts = target.nodes().select(*keys, F.col("pl").alias("l"), *[F.expr(f"shiftright({c}, pl - l)").alias(c) for c in ("cx", "cy", "cz")], F.struct(*_CELL, "n", *_BOX, "leaf").alias("_part"))
    while not front.where("not leaf").isEmpty():
        opened = front.where("not leaf").select(*q, "u", *_CELL).join(parts, [*keys, *_CELL]).select(*q, "u", "_part.*")
        front = checkpoint(_pruned(front.where("leaf").unionByName(opened, allowMissingColumns=False), q, need))
    held = source.dealt(places).withColumnsRenamed({c: f"q{c}" for c in _CELL}).withColumnRenamed("u", "_u")
    met = held.join(front.select(*keys, *[f"q{c}" for c in _CELL], *_CELL, *_BOX, "u"), [*keys, *[f"q{c}" for c in _CELL]]).withColumn("u", F.least("u", "_u") * (1 + 1e-9))
    gap = [F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1")) for c in "xyz"]
    met = met.where(F.sqrt(sum((v * v for v in gap), F.lit(0.0))) <= F.col("u"))
    if gate is not None:
        met = met.withColumn("u", F.least("u", F.lit(float(gate))))
    return checkpoint(met.select(*keys, *"xyz", "u", *_CELL)).join(target.blocks().select(*keys, *_BLOCK), [*keys, *_CELL]).select(*keys, *"xyz", "u", *_BLOCK)
