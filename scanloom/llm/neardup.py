"""Near-duplicate texts by HyperMinHash sketches, banded, estimated, then confirmed on whole shingle sets.

A sketch has REGISTERS buckets; each keeps, of its least hash, the number of leading zeros and some bits
of the mantissa. Texts whose compressed registers agree in a band are candidates; the collision-corrected
Jaccard estimate of the sketches sifts them, and exact set sizes confirm them. Equal sets are one class
with one representative, so copies add no work beyond their sketch.

Within a band's bucket, members are first compared with two pivots, so a large group of copies costs as
many comparisons as it has members. Where a bucket still spans several components, its members of different
components are compared by finer sketches at once, up to a size; larger buckets are first split by more
selective bands of the finer sketch, and only a part that is too large even then is cut in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import text as tx

#: Buckets of a sketch (a power of two), bands of it, bits of mantissa.
REGISTERS, BANDS, MANTISSA = 128, 32, 10
#: Buckets of the finer sketch that texts get whose buckets still span several components after the pivots; its registers in
#: a band where such a bucket is split: of pairs at a similarity of 0.8, one in 130,000 shares none of the 64 bands.
FINE, FINE_WIDTH = 512, 8
#: Defaults of stages on word shingles: words of a shingle, and the similarity of a link in hundredths.
WORDS, PERCENT = 5, 80
#: Ids (24 bytes each) up to which texts are picked by a broadcast of the ids; beyond, by a shuffle.
PICKED = 500_000
#: Members of a bucket that are compared at once; a larger one is split by bands of the finer sketch, what is larger even then in blocks.
BLOCK = 2048


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row of a slice); fewer words than n are one shingle."""
    for low, high, data, offsets in tx.slices(column):
        data = tx.lower(data)
        starts, ends, first = tx.words(data, offsets, tx.NOT_SPACE)
        hashes = tx.Hashes(data, 9).of(starts, ends)
        grams, where = tx.shingles(hashes, tx.owners(first), n, 4)
        bounds = np.searchsorted(where, first)
        out = []
        for row in range(high - low):
            a, b = first[row], first[row + 1]
            if 0 < b - a < n:
                out.append(tx.shingles(hashes[a:b], np.zeros(b - a, np.int64), int(b - a), 4)[0])
            else:
                out.append(np.unique(grams[bounds[row] : bounds[row + 1]]))
        yield low, out


def registers(shingles: np.ndarray, size: int = REGISTERS) -> np.ndarray:
    """The sketch of a sorted set of hashes: 0 where a bucket is empty, else leading zeros and mantissa, and 1."""
    out = np.zeros(size, np.uint16)
    bits = size.bit_length() - 1
    bucket = (shingles >> np.uint64(64 - bits)).astype(np.int64)
    filled, at = np.unique(bucket, return_index=True)
    value = shingles[at] << np.uint64(bits)
    zeros = 64 - np.frexp(value.astype(np.float64))[1]
    zeros = np.clip(zeros, 0, 61).astype(np.uint64)
    mantissa = (value << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out[filled] = (zeros << np.uint64(MANTISSA)) + mantissa + np.uint64(1)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of sketches (rows), less the expected number of chance collisions, and the buckets they rest on."""
    equal = ((a == b) & (a > 0)).sum(-1)
    used = np.maximum(((a > 0) | (b > 0)).sum(-1), 1)
    ratio = n_a / np.maximum(n_b, 1)
    chance = 0.169919487159739 * a.shape[-1] * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (equal - chance) / used, used


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, share: float) -> np.ndarray:
    """Pairs of fitting sizes whose estimate is not five standard deviations below the share.

    The buckets used are a sample of the union without replacement; the larger its part of the union, the less it strays.
    """
    found, used = estimate(a, b, n_a, n_b)
    left = np.clip(1 - used * (1 + share) / np.maximum(n_a + n_b, 1), 0, 1)
    sizes = np.minimum(n_a, n_b) >= share * np.maximum(n_a, n_b) - 1e-9
    return sizes & (found >= share - 5 * np.sqrt(share * (1 - share) / used * left) - 2 / used)


def band_keys(sketches: np.ndarray, width: int = REGISTERS // BANDS) -> np.ndarray:
    """rows x bands: hashes of the registers of each band; an empty register borrows another by a fixed search order."""
    size = sketches.shape[1]
    probes = (tx.seeded(size * 64, 21) % np.uint64(size)).astype(np.int64).reshape(size, 64)
    full = sketches.astype(np.uint64)
    row, bucket = np.nonzero(full == 0)
    for turn in range(64 * 16):
        if not len(row):
            break
        probe = (probes[bucket, turn % 64] + turn // 64 * 37) % size
        value = sketches[row, probe]
        hit = value > 0
        full[row[hit], bucket[hit]] = value[hit] + np.uint64(probe[hit] << 16)  # what is borrowed also tells from where
        row, bucket = row[~hit], bucket[~hit]
    bands = size // width
    out = np.broadcast_to(tx.seeded(bands, 22), (len(full), bands)).copy()
    for k in range(width):
        out = tx.mix(out ^ full[:, k * bands : (k + 1) * bands]) * np.uint64(0x9E3779B97F4A7C15)
    return tx.signed(out)


def _sketch(n: int, width: int = REGISTERS):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, sets in shingle_sets(batch.column(1), n):
                size = np.array([len(s) for s in sets])
                whole = [np.array([x.sum(dtype=np.uint64), (tx.mix(x ^ np.uint64(0x5851F42D4C957F2D))).sum(dtype=np.uint64)]) for x in sets]
                pair = tx.signed(np.array(whole, np.uint64))
                yield pa.RecordBatch.from_arrays([batch.column(0)[low : low + len(sets)], batch.column(2)[low : low + len(sets)], pa.array(size), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array([registers(x, width).tobytes() if len(x) else None for x in sets], pa.binary())], ["id", "t", "n", "fa", "fb", "sketch"])

    return emit


def _matrix(column: pa.Array | list[bytes], width: int = REGISTERS) -> np.ndarray:
    return np.frombuffer(b"".join(column if isinstance(column, list) else column.to_pylist()), np.uint16).reshape(-1, width)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            keys = band_keys(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), BANDS)))], ["band", "rep"])


def _coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys in place of the sketch that they come from."""
    for batch in batches:
        if len(batch):
            keys = band_keys(_matrix(batch.column(3)))
            coarse = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], coarse], ["rep", "n", "sketch", "coarse"])


def _sift(share: float):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                n_a, n_b = (batch.column(k).to_numpy() for k in (2, 4))
                keep = plausible(_matrix(batch.column(3)), _matrix(batch.column(5)), n_a, n_b, share)
                yield batch.select([0, 1]).filter(pa.array(keep))

    return emit


def _verify(n: int, percent: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                a, b = ([s for _, sets in shingle_sets(part.column(k), n) for s in sets] for k in (2, 3))
                both = np.array([len(np.intersect1d(x, y, True)) for x, y in zip(a, b, strict=True)])
                union = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)]) - both
                yield part.select([0, 1]).filter(pa.array((100 * both >= percent * union) & (both > 0)))

    return emit


def _compare(share: float):
    """Plausible pairs of different components among the members of each group; the rows of a group come together.

    A group is a bucket, or the part of one that shares a band of the finer sketch, or two blocks of such a part. A pair
    that meets in several bands is looked at in the first of them alone, and of a group the members of its largest
    component are not held against each other's.
    """

    def pairs(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        band, part, low, high = rows[0][:4]
        own, comp, rep, n = (np.array([r[k] for r in rows]) for k in (4, 5, 6, 7))
        fine = _matrix([r[8] for r in rows], FINE)
        coarse, parts = np.array([r[9] for r in rows]), band_keys(fine, FINE_WIDTH) if part is not None else None
        _, label, size = np.unique(comp, return_inverse=True, return_counts=True)
        asks = np.flatnonzero((own == low) & (label != size.argmax())) if low == high else np.flatnonzero(own == low)
        for x in asks:
            others = np.flatnonzero((own == high) & (comp != comp[x]))
            others = others[coarse[x][(coarse[others] == coarse[x]).argmax(1)] == band]
            if parts is not None:
                others = others[parts[x][(parts[others] == parts[x]).argmax(1)] == part]
            for y in others[plausible(fine[x], fine[others], n[x], n[others], share)]:
                yield min(int(rep[x]), int(rep[y])), max(int(rep[x]), int(rep[y]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[tuple] = []

        def close() -> pa.RecordBatch:
            found = list(set(pairs(now)))
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and row[:4] != now[-1][:4]:
                    yield close()
                    now = []
                now.append(row)
        if now:
            yield close()

    return emit


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band of the finer sketch of each member of a bucket that is split."""
    for batch in batches:
        for low in range(0, len(batch), 512):
            rows = batch.slice(low, 512)
            keys = band_keys(_matrix(rows.column(3), FINE), FINE_WIDTH)
            at = pa.array(np.repeat(np.arange(len(rows)), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([rows.column(0).take(at), pa.array(keys.ravel()), rows.column(1).take(at), rows.column(2).take(at)], ["band", "part", "rep", "comp"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every linked id: the least id that can be reached. Alternating large and small stars.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest chain. The
    last is the one that leaves stars: each id on one edge, to an id that is on no edge as the larger one.
    """
    edges = tx.checkpoint(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = tx.checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("lower")), F.struct(F.col("v").alias("id"), F.lit(0).alias("lower")))).alias("e")).groupBy("e.id").agg(F.sum("e.lower").alias("n"), F.min("e.lower").alias("least"))
        if ends.agg(F.count_if((F.col("n") > 1) | ((F.col("n") == 1) & (F.col("least") == 0)))).first()[0] == 0:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text", block: int = BLOCK, named: bool = False) -> DataFrame:
    """key, n_shingles, component_id (least key reachable over links) and kept (whether that is the key itself).

    Texts are linked if their sets of shingles of so many words (A-Z lower-cased, split at white space) have at
    least so many hundredths of their union in common. A text of fewer words is one shingle; without words or
    null it is linked with nothing and kept. Copies, and repeated rows, are one class: of rows with the least
    key all are kept. Rows with one key and different texts are texts of their own: classes are named by one of their
    rows' key, or where that names several classes by a hash of their set. Ties can't occur; an empty table gives an
    empty one; further columns are not read. With named there are also t, a hash of the text (which with the key tells
    different rows apart), and group, the same number for all texts that reach each other (null without words).
    """
    share = percent / 100
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("t"))
    fields = "id long, t long, n long, fa long, fb long, sketch binary"
    sketches = tx.checkpoint(rows.mapInArrow(tx.lean(_sketch(words)), fields))
    classes = sketches.where("n > 0 and id is not null").groupBy("fa", "fb").agg(F.min(F.struct("id", "t")).alias("m")).select("fa", "fb", F.col("m.id").alias("least"), F.col("m.t").alias("t"))
    shared = tx.checkpoint(classes.groupBy("least").agg(F.count("*").alias("_n")).where("_n > 1").select("least", F.lit(True).alias("_shared")))
    alone = shared.isEmpty()  # no key has several classes
    own_name = F.when(F.col("_shared"), -1 - F.pmod(F.xxhash64("fa", "fb"), F.lit(1 << 62))).otherwise(F.col("least"))
    classes = classes.withColumn("rep", F.col("least")) if alone else tx.checkpoint(classes.join(shared, "least", "left").withColumn("rep", own_name).drop("_shared"))
    held = sketches.join(classes.select(F.col("least").alias("id"), "t", "rep"), ["id", "t"])
    reps = tx.checkpoint(held.dropDuplicates(["rep"]).select("rep", "n", "sketch"))

    def sifted(pairs: DataFrame) -> DataFrame:
        side = lambda k: reps.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(tx.lean(_sift(share)), "a long, b long")

    def only(ids: DataFrame) -> DataFrame:
        """id, text, t: texts of the classes, before any text is shuffled if the classes are few."""
        ids = tx.checkpoint(ids.distinct().join(classes.select(F.col("rep").alias("id"), "least", "t"), "id").select(F.col("id").alias("rep"), F.col("least").alias("id"), "t"))
        return rows.join(F.broadcast(ids) if ids.count() <= PICKED else ids, ["id", "t"]).select(F.col("rep").alias("id"), "text", "t")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = tx.checkpoint(pairs)
        own = only(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))
        side = lambda k: own.select(F.col("id").alias(k), F.col("text").alias(f"t_{k}"))
        return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "t_a", "t_b").mapInArrow(tx.lean(_verify(words, percent)), "a long, b long")

    bands = reps.select("rep", "sketch").mapInArrow(tx.lean(_bands), "band long, rep long")
    buckets = bands.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("size")).where("low < high")
    buckets = tx.checkpoint(buckets)
    crowded = tx.maybe_in(bands, buckets, "band").where("maybe").select("band", "rep")
    crowded = tx.checkpoint(crowded.join(buckets.hint("shuffle_merge"), "band"))
    pairs = crowded.where("rep > low").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    pairs = pairs.unionByName(crowded.where("rep < high").select(F.col("rep").alias("a"), F.col("high").alias("b"))).distinct()
    links = tx.checkpoint(confirmed(sifted(pairs)))
    found = components(links)

    def still_open(members: DataFrame, *by: str) -> DataFrame:
        """Groups whose members are of several components, with their size."""
        return members.groupBy(*by).agg(F.count("*").alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select(*by, "size")

    apart = crowded.where("size > 3 and rep > low and rep < high").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    apart = apart.select("band", "rep", F.coalesce("component", "rep").alias("comp"))
    placed = tx.checkpoint(apart.join(still_open(apart, "band"), "band"))
    fine = only(placed.select(F.col("rep").alias("id"))).mapInArrow(tx.lean(_sketch(words, FINE)), fields)
    fine = fine.dropDuplicates(["id"]).select(F.col("id").alias("rep"), "sketch")
    fine = tx.checkpoint(fine.join(reps.select("rep", "n", F.col("sketch").alias("coarse")), "rep").select("rep", "n", "sketch", "coarse").mapInArrow(tx.lean(_coarse), "rep long, n long, sketch binary, coarse array<long>"))
    whole = placed.where(F.col("size") <= block).select("band", F.lit(None).cast("long").alias("part"), "rep", "comp", "size")
    split = placed.where(F.col("size") > block).join(fine, "rep").select("band", "rep", "comp", "sketch")
    split = split.mapInArrow(tx.lean(_parts), "band long, part long, rep long, comp long")
    split = split.join(still_open(split, "band", "part"), ["band", "part"]).select("band", "part", "rep", "comp", "size")
    groups = whole.unionByName(split).withColumn("chunks", F.ceil(F.col("size") / block).cast("int"))
    groups = groups.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    groups = groups.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    groups = groups.select("band", "part", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "comp", "rep").join(fine, "rep")
    groups = groups.select("band", "part", "lo", "hi", "own", "comp", "rep", "n", "sketch", "coarse").repartition("band", "part", "lo", "hi").sortWithinPartitions("band", "part", "lo", "hi")
    more = groups.mapInArrow(tx.lean(_compare(share)), "a long, b long")
    more = tx.checkpoint(more.distinct())
    if not more.isEmpty():
        late = tx.checkpoint(confirmed(more))
        if not late.isEmpty():
            found = components(found.where("id > component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(late))

    placed_class = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("fa", "fb", "least", F.coalesce("component", "rep").alias("group"))
    if alone:
        placed_class = placed_class.withColumn("component", F.col("group"))
    else:
        placed_class = placed_class.join(placed_class.groupBy("group").agg(F.min("least").alias("component")), "group")
    out = sketches.select("id", "t", "n", "fa", "fb").join(placed_class.select("fa", "fb", "group", "component"), ["fa", "fb"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    more = ["t", F.when(F.col("n") > 0, F.col("group")).alias("group")] if named else []
    out = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), *more)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(key), F.lit(True)))
