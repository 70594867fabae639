"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 points, neighbouring cells probed, cosine verified.

In each of several tables a unit vector is projected to eight numbers and decoded to the nearest point of the E8 lattice;
that point is its cell. Besides its own cell a vector probes the nearest of the 240 neighbouring cells, and meets the
vectors whose own cell that is. Pairs that meet are sifted by 128 signs of random projections, then verified in doubles.

Equal vectors are one class. Classes that lie, on the sphere, within half the greatest angle of a link around one of them
form a ball, in which all are linked by the triangle inequality; balls are compared by their centres and radii, and only
where these leave it open are members compared, block against block, with counts as the only output. So a large group of
copies or of tight near copies costs rows by its size, not by its square, and still every vector has its number of links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm import neardup
from scanloom.llm import text as tx

#: Least cosine of a link.
COSINE = 0.93
#: Tables, neighbouring cells that are probed in each, and the width of a cell in standard deviations of a projected unit
#: vector. A pair at a cosine of 0.93 meets in a table with 0.59, one at 0.95 with 0.74, one at 0.98 with 0.95; two
#: unlike vectors with 0.002.
TABLES, PROBES, WIDTH = 10, 4, 1.3
#: Cell width of the table whose cells propose the balls.
BALL_WIDTH = 2.0
#: Lattice points that make up a key. Keys of more points part larger label groups finer; they need more tables and probes.
POINTS = 1
#: Signs of a sketch, and standard deviations that a pair's differing signs may exceed their mean by.
SIGNS, SPREAD = 128, 6
#: Members of a ball in a block, in the mean.
BLOCK = 64
#: Slack of angles in radians: within it, members are compared themselves.
SLACK = 1e-6


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2)
    rest = x[odd] - near[odd]
    worst = np.abs(rest).argmax(1)
    near[odd, worst] += np.where(rest[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: integers or halves of odd integers in all places, with even sum."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


def _neighbours() -> np.ndarray:
    """The 240 points of E8 next to the origin."""
    grid = np.stack(np.meshgrid(*[[-1.0, 0.0, 1.0]] * 8, indexing="ij"), -1).reshape(-1, 8)
    whole = grid[(grid**2).sum(1) == 2]
    signs = np.stack(np.meshgrid(*[[-0.5, 0.5]] * 8, indexing="ij"), -1).reshape(-1, 8)
    return np.concatenate([whole, signs[signs.sum(1) % 2 == 0]])


NEIGHBOURS = _neighbours()


def _random(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(count, dim))


def _name_cells(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Cells by number: rows x (8 numbers a lattice point), twice over so that they are whole."""
    out = salt.copy()
    for column in (2 * points).astype(np.int64).view(np.uint64).T:
        out = tx.mix(out ^ (column * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)))
    return tx.signed(out)


def cells(unit: np.ndarray, salt: np.ndarray, table: int, width: float, points: int, probes: int) -> np.ndarray:
    """rows x (1 + probes): the own cell of each unit vector and the nearest neighbouring ones, in one table."""
    dim = unit.shape[1]
    shift = np.random.default_rng([31, table]).uniform(0, 2, 8 * points)
    at = (unit @ _random(dim, 8 * points, 1000 + table).T / width + shift).reshape(-1, 8)
    own = nearest_e8(at)
    key = tx.mix(salt ^ np.uint64(0xD1342543DE82EF95 * (table + 1) & (1 << 64) - 1))
    whole = own.reshape(len(unit), 8 * points)
    out = [_name_cells(whole, key)]
    if probes:
        nearness = ((at - own) @ NEIGHBOURS.T).reshape(len(unit), -1)
        order = np.argpartition(-nearness, probes, axis=1)[:, :probes]
        for k in range(probes):
            point, which = order[:, k] // len(NEIGHBOURS), order[:, k] % len(NEIGHBOURS)
            other = whole.reshape(len(unit), points, 8).copy()
            other[np.arange(len(unit)), point] += NEIGHBOURS[which]
            out.append(_name_cells(other.reshape(len(unit), -1), key))
    return np.stack(out, 1)


def _unit(column: pa.Array | list[bytes], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each length of vectors. Each is scaled by its largest component first, so that no square overflows."""
    raw = column if isinstance(column, list) else column.to_pylist()
    sizes = np.array([len(x) for x in raw], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), -1).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        yield at, x / np.sqrt((x * x).sum(1, keepdims=True))


def _salt(labels: pa.Array, dim: int) -> np.ndarray:
    named = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in labels.to_pylist()]
    return tx.mix(np.array(named, np.uint64) + np.uint64(dim))


def _read(kind: str):
    """id, name (of label and vector; null where the vector links with nothing), label, vec."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, column = batch.column(1).to_pylist(), batch.column(2)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            filled = np.concatenate([[0], np.cumsum(values != 0)])
            good = (bad[edges[1:]] == bad[edges[:-1]]) & (filled[edges[1:]] > filled[edges[:-1]])
            vec = [values[a:b].tobytes() if ok and label is not None else None for a, b, ok, label in zip(edges[:-1], edges[1:], good, labels, strict=True)]
            name = [None if v is None else hashlib.blake2b(v, digest_size=16, key=hashlib.sha256(label.encode()).digest()).digest() for v, label in zip(vec, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.binary()), batch.column(1), pa.array(vec, pa.binary())], ["id", "name", "label", "vec"])

    return emit


def _parts(batches: Iterator[pa.RecordBatch], size: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), size):
            yield batch.slice(low, size)


def _ball_cells(kind: str):
    """Adds the cell that proposes a ball, and the 128 signs of the vector."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            cell, signs = np.zeros(len(batch), np.int64), np.zeros((len(batch), 2), np.int64)
            for at, unit in _unit(batch.column(2), kind):
                cell[at] = cells(unit, _salt(batch.column(1).take(pa.array(at)), unit.shape[1]), 99, BALL_WIDTH, 1, 0)[:, 0]
                signs[at] = np.packbits(unit @ _random(unit.shape[1], SIGNS, 7).T > 0, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(signs[:, 0]), pa.array(signs[:, 1])], [*batch.schema.names, "cell", "s1", "s2"])

    return emit


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between unit vectors, row by row, precise for small ones too."""
    return 2 * np.arctan2(np.sqrt(((a - b) ** 2).sum(1)), np.sqrt(((a + b) ** 2).sum(1)))


def _pairwise(left: pa.Array, right: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Angle and cosine of the vectors of each row; vectors of different lengths are as far apart as can be."""
    a, b = left.to_pylist(), right.to_pylist()
    angle, cosine = np.full(len(a), math.pi), np.full(len(a), -1.0)
    same = np.array([i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None and len(x) == len(y)], np.int64)
    for (at, u), (_, v) in zip(_unit([a[i] for i in same], kind), _unit([b[i] for i in same], kind), strict=True):
        angle[same[at]], cosine[same[at]] = _angles(u, v), (u * v).sum(1)
    return angle, cosine


def _assign(kind: str, reach: float):
    """The ball of each class: that of its cell's first class if it is near enough to it, else its own."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            angle, _ = _pairwise(batch.column(2), batch.column(8), kind)
            inside = angle <= reach / 2 - SLACK
            own = batch.column(0).to_pylist()
            ball = [p if ok else n for n, p, ok in zip(own, batch.column(7).to_pylist(), inside.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(ball, pa.binary()), pa.array(np.where(inside, angle, 0.0))], ["name", "label", "vec", "weight", "least", "s1", "s2", "ball", "angle"])

    return emit


def _meet(kind: str, tables: int, width: float, points: int, probes: int):
    """(cell, ball, own): the cells of each class and, where own is false, those that it probes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            for at, unit in _unit(batch.column(1), kind):
                rows = batch.take(pa.array(at))
                salt = _salt(rows.column(0), unit.shape[1])
                found = np.stack([cells(unit, salt, k, width, points, probes) for k in range(tables)], 1)
                own = np.zeros(found.shape, bool)
                own[:, :, 0] = True
                balls = rows.column(2).take(pa.array(np.repeat(np.arange(len(at)), tables * (1 + probes))))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), balls, pa.array(own.ravel())], ["cell", "ball", "own"])

    return emit


def _decide(kind: str, least: float):
    """Of two balls: linked (all members of one with all of the other), open (members must tell), or neither."""
    reach = math.acos(least)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            angle, cosine = _pairwise(batch.column(2), batch.column(5), kind)
            around = batch.column(3).to_numpy() + batch.column(6).to_numpy()
            alone = around == 0
            linked = np.where(alone, cosine >= least, angle + around <= reach - SLACK)
            unsure = ~alone & ~linked & (angle - around <= reach + SLACK)
            same = np.array([x == y for x, y in zip(batch.column(4).to_pylist(), batch.column(7).to_pylist(), strict=True)], bool)
            keep = pa.array((linked | unsure) & same)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(linked).filter(keep)], ["a", "b", "linked"])

    return emit


def _members(kind: str, least: float):
    """Of two blocks of members: how many vectors of the other block each member is linked with, if any; a and b are the balls."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 16):
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (_, u), (_, v) = (next(_unit([m["vec"] for m in side], kind)) for side in (x, y))
                near = u @ v.T >= least
                for own, other, hits in ((x, y, near), (y, x, near.T)):
                    counts = hits @ np.array([m["weight"] for m in other], np.int64)
                    out += [(a, b, own[i]["name"], int(counts[i])) for i in np.flatnonzero(counts).tolist()]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["a", "b", "name", "n"])

    return emit


def near_vectors(vectors: DataFrame, least: float = COSINE, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, points: int = POINTS, key: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links (other vectors linked directly), component_id (least key reachable over links) and kept (whether that is the key).

    Vectors are linked if their labels are equal and not null, their lengths are equal, and their cosine is least at
    least; pairs that meet in no table are not found (one in some 8,000 at a cosine of 0.93, far fewer above it). Null or
    zero vectors, and those with null or non-finite components, are linked with nothing and kept. Rows with equal keys
    are vectors of their own, and equal vectors are linked; a null key counts as a link but names no component. An empty
    table gives an empty one, further columns are not read.
    """
    if not 0 < least < 1 or probes >= len(NEIGHBOURS):
        raise ValueError("a cosine between 0 and 1, and fewer probes than neighbouring cells")
    kind = "<f4" if isinstance(vectors.schema[vec].dataType.elementType, T.FloatType) else "<f8"
    reach = math.acos(least)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vec).cast(T.ArrayType(T.FloatType() if kind == "<f4" else T.DoubleType())).alias("vec"))
    read = rows.mapInArrow(tx.lean(_read(kind)), "id long, name binary, label string, vec binary")
    classes = read.where("name is not null").groupBy("name").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("id").alias("least"))
    fields = "name binary, label string, vec binary, weight long, least long"
    classes = tx.stored(classes.mapInArrow(tx.lean(_ball_cells(kind)), f"{fields}, cell long, s1 long, s2 long"))

    first = classes.groupBy("cell").agg(F.min(F.struct("name", "vec")).alias("first"), F.count("*").alias("size")).where("size > 1")
    asked = classes.join(first, "cell", "left").select("name", "label", "vec", "weight", "least", "s1", "s2", F.col("first.name").alias("p"), F.col("first.vec").alias("q"))
    members = tx.stored(asked.mapInArrow(tx.lean(_assign(kind, reach)), f"{fields}, s1 long, s2 long, ball binary, angle double"))
    centre = lambda c: F.max(F.when(F.col("name") == F.col("ball"), F.col(c))).alias(c)
    balls = tx.stored(members.groupBy("ball").agg(*map(centre, ("vec", "label", "s1", "s2")), F.max("angle").alias("radius"), F.sum("weight").alias("weight"), F.count("*").alias("size"), F.min("least").alias("least")))

    met = members.select("label", "vec", "ball").mapInArrow(tx.lean(_meet(kind, tables, width, points, probes)), "cell long, ball binary, own boolean").distinct()
    met = tx.stored(met.join(balls.select("ball", "s1", "s2", "radius"), "ball"))
    side = lambda k: met.select("cell", *[F.col(c).alias(f"{c}_{k}") for c in ("ball", "own", "s1", "s2", "radius")])
    apart = sum(F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in ("s1", "s2"))
    share = F.least((reach + F.col("radius_a") + F.col("radius_b")) / math.pi, F.lit(0.5))
    close = apart <= SIGNS * share + SPREAD * F.sqrt(SIGNS * share * (1 - share))
    both = side("a").where("own_a").join(side("b"), "cell").where("ball_a < ball_b or (not own_b and ball_a <> ball_b)").where(close)
    pairs = both.select(F.least("ball_a", "ball_b").alias("a"), F.greatest("ball_a", "ball_b").alias("b")).distinct()

    of = lambda k: balls.select(F.col("ball").alias(k), F.col("vec").alias(f"v_{k}"), F.col("radius").alias(f"r_{k}"), F.col("label").alias(f"l_{k}"))
    seen = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "v_a", "r_a", "l_a", "v_b", "r_b", "l_b")
    seen = tx.stored(seen.mapInArrow(tx.lean(_decide(kind, least)), "a binary, b binary, linked boolean"))
    linked, unsure = seen.where("linked").select("a", "b"), seen.where("not linked").select("a", "b")

    torn = unsure.select(F.col("a").alias("ball")).unionByName(unsure.select(F.col("b").alias("ball"))).distinct()
    torn = members.join(torn, "ball", "left_semi").join(balls.select("ball", "size"), "ball")
    torn = torn.withColumn("block", F.pmod(F.xxhash64("name"), F.ceil(F.col("size") / BLOCK)))
    torn = torn.groupBy("ball", "block").agg(F.collect_list(F.struct("name", "vec", "weight")).alias("members"))
    torn = tx.stored(torn)
    held = unsure.join(torn.select(F.col("ball").alias("a"), F.col("members").alias("m_a")), "a").join(torn.select(F.col("ball").alias("b"), F.col("members").alias("m_b")), "b")
    hits = tx.stored(held.select("a", "b", "m_a", "m_b").mapInArrow(tx.lean(_members(kind, least)), "a binary, b binary, name binary, n long"))

    found = neardup.components(linked.unionByName(hits.select("a", "b").distinct()))
    placed = balls.join(found.withColumnRenamed("id", "ball"), "ball", "left").select("ball", F.coalesce("component", "ball").alias("component"), "least", "weight")
    lowest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    weigh = balls.select(F.col("ball").alias("b"), "weight")
    more = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(weigh, "b").groupBy(F.col("a").alias("ball")).agg(F.sum("weight").alias("more"))
    placed = placed.join(lowest, "component").join(more, "ball", "left").select("ball", "component_id", (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("common"))
    own = hits.groupBy("name").agg(F.sum("n").alias("own"))
    placed = members.select("name", "ball").join(placed, "ball").join(own, "name", "left").select("name", "component_id", (F.col("common") + F.coalesce("own", F.lit(0))).alias("n_links"))
    out = read.select("id", "name").join(placed, "name", "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(key), F.lit(True)))
