"""Exact removal of repeated 50-word windows by super-k-mer partitioning.

A window's minimiser is the least hash among its runs of MINIMISER words. Consecutive windows that share
it form a super-k-mer, which travels as one packed string of words to the bucket of the minimiser; equal
windows of any two texts meet there, and sorting the bucket's windows counts them. Minimisers that occur
in one text only are dropped before any string travels, as none of their windows can repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import text as tx

WINDOW = 50
#: Words of a run whose hash can be a minimiser.
MINIMISER = 7
#: Bytes of packed strings whose windows are sorted in memory at once; larger buckets are sorted by Spark.
BUCKET_BYTES = 8 << 20
#: Large buckets up to which their minimisers (8 bytes each) are broadcast; beyond, they are shuffled.
PICKED = 500_000
#: Bytes that a place of a string counts for in a batch.
PLACE_BYTES = 64


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have :]) if have < width else out


def super_kmers(hashes: np.ndarray, owner: np.ndarray, window: int = WINDOW, m: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of each run of windows of one row that share their minimiser.

    A window is named by the index of its first word.
    """
    none = np.zeros(0, np.int64)
    m = min(m, window)
    if len(hashes) < window:
        return np.zeros(0, np.uint64), none, none
    count = len(hashes) - m + 1
    grams = np.zeros(count, np.uint64)
    for k in range(m):
        grams = grams * np.uint64(0xF1357AEA2E62A9C5) + hashes[k : k + count]
    least = _sliding_min(tx.mix(grams), window - m + 1)
    valid = owner[window - 1 :] == owner[: len(hashes) - window + 1]
    at = np.flatnonzero(valid)
    if not len(at):
        return np.zeros(0, np.uint64), none, none
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
    begins = np.flatnonzero(new)
    return value[begins], at[begins], np.diff(np.append(begins, len(at)))


def _split(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for low, high, data, offsets in tx.slices(column):
        starts, ends, first = tx.words(data, offsets, tx.NOT_SPACE)
        yield low, high, data, starts, ends, first, tx.owners(first), tx.Hashes(data, 3).of(starts, ends)


def _minimisers(window: int, m: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for low, _, _, _, _, _, owner, hashes in _split(batch.column(1)):
                value, begin, _ = super_kmers(hashes, owner, window, m)
                row = low + owner[begin]
                pairs = np.unique(np.stack([tx.signed(value), keys[row], names[row]], 1), axis=0) if len(begin) else np.zeros((0, 3), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(3)], ["minimiser", "id", "t"])

    return emit


def _pack(window: int, m: int):
    """Packed strings of the super-k-mers whose minimiser is among those of their row that repeat, with their places.

    Equal strings of a batch travel once, so copies of a text cost their places only; both count towards a batch's size.
    A string is named by a hash of its words.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        size = 0

        def batch_of() -> pa.RecordBatch:
            names = [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little", signed=True) for _, p in held]
            places = [[{"id": i, "t": t, "start": s} for i, t, s in at] for at in held.values()]
            least, most = ([f(at)[0] for at in held.values()] for f in (min, max))
            columns = [pa.array([v for v, _ in held], pa.int64()), pa.array(names, pa.int64()), pa.array([p for _, p in held], pa.binary()), pa.array(least, pa.int64()), pa.array(most, pa.int64()), pa.array(places, _PLACES)]
            return pa.RecordBatch.from_arrays(columns, ["minimiser", "name", "packed", "least", "most", "places"])

        for batch in batches:
            keys, names = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 3))
            wanted = batch.column(2)
            flags, bounds = wanted.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(wanted.value_lengths().to_numpy(zero_copy_only=False))])
            for low, high, data, starts, ends, first, owner, hashes in _split(batch.column(1)):
                value, begin, count = super_kmers(hashes, owner, window, m)
                value, row = tx.signed(value), owner[begin]
                keep = np.zeros(len(begin), bool)
                edges = np.searchsorted(row, np.arange(high - low + 1))
                for r in range(high - low):
                    a, b = edges[r], edges[r + 1]
                    keep[a:b] = np.isin(value[a:b], flags[bounds[low + r] : bounds[low + r + 1]])
                raw = data.tobytes()
                for v, b, c, r in zip(value[keep].tolist(), begin[keep].tolist(), count[keep].tolist(), row[keep].tolist(), strict=True):
                    last = b + c + window - 1
                    packed = b" ".join([raw[x:y] for x, y in zip(starts[b:last].tolist(), ends[b:last].tolist(), strict=True)])
                    if (v, packed) not in held:
                        held[v, packed] = []
                        size += len(packed)
                    held[v, packed].append((int(keys[low + r]), int(names[low + r]), b - int(first[r])))
                    size += PLACE_BYTES
                    if size > BUCKET_BYTES:
                        yield batch_of()
                        held, size = {}, 0
        if held:
            yield batch_of()

    return emit


_PLACES = pa.list_(pa.struct([("id", pa.int64()), ("t", pa.int64()), ("start", pa.int64())]))


def _window_keys(packed: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits of the words of each window of the strings, in two numbers, and the string of each window."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in packed])]).astype(np.int64)
    data = np.frombuffer(b"".join(packed), np.uint8)
    starts, ends, first = tx.words(data, offsets, tx.NOT_SPACE)
    owner = tx.owners(first)
    a, where = tx.shingles(tx.Hashes(data, 5).of(starts, ends), owner, window, 5)
    b, _ = tx.shingles(tx.Hashes(data, 6).of(starts, ends), owner, window, 6)
    return a, b, owner[where]


def first_seen(packed: list[bytes], least: list[int], window: int) -> list[np.ndarray]:
    """For each string, window by window, the least id of the strings that hold the same window.

    The windows of a bucket are sorted by 128 bits of their words, so that equal ones are neighbours.
    """
    a, b, string = _window_keys(packed, window)
    own = np.array(least, np.int64)[string]
    order = np.lexsort((own, b, a))
    a, b = a[order], b[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = own[order][new][np.cumsum(new) - 1]
    return np.split(out, np.cumsum(np.bincount(string, minlength=len(packed)))[:-1])


def _count(window: int):
    """Strings of a bucket come together; some buckets are sorted at once, up to a size.

    Yields, of each string some window of which an earlier text than its last holds, the least id that holds each window.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[tuple[int, int, bytes, int, int]] = []

        def close() -> pa.RecordBatch:
            seen = first_seen([x[2] for x in now], [x[3] for x in now], window)
            out = [(x[0], x[1], y) for x, y in zip(now, seen, strict=True) if int(y.min()) < x[4]]
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["minimiser", "name", "seen"])

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and row[0] != now[-1][0] and size > BUCKET_BYTES // 8:
                    yield close()
                    now, size = [], 0
                now.append(row)
                size += len(row[2])
        if now:
            yield close()

    return emit


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t, start, marks): the windows of each place, counted from its start, that an earlier text holds."""
    for batch in batches:
        out = []
        for at, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            least = np.array(seen, np.int64)
            for p in at:
                marks = np.flatnonzero(least < p["id"])
                if len(marks):
                    out.append((p["id"], p["t"], p["start"], marks.astype(np.int32)))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["id", "t", "start", "marks"])


def _windows(window: int):
    """Single windows of the strings of large buckets, for Spark to sort."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 2000):
                part = batch.slice(low, 2000)
                a, b, string = _window_keys(part.column(2).to_pylist(), window)
                place = np.arange(len(string)) - np.searchsorted(string, string)
                yield pa.RecordBatch.from_arrays([pa.array(tx.signed(a)), pa.array(tx.signed(b)), part.column(0).take(pa.array(string)), part.column(1).take(pa.array(string)), pa.array(place), part.column(3).take(pa.array(string))], ["a", "b", "minimiser", "name", "place", "least"])

    return emit


def _keep(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column(2).to_pylist()
            for low, high, data, starts, ends, first, _, _ in _split(batch.column(1)):
                raw, out = data.tobytes(), []
                for row in range(high - low):
                    a, b = int(first[row]), int(first[row + 1])
                    gone = np.zeros(b - a + 1, np.int64)
                    for cut in cuts[low + row] or ():
                        at = cut["start"] + np.array(cut["marks"], np.int64)
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1)
                    keep = np.cumsum(gone)[:-1] == 0
                    kept = b" ".join([raw[x:y] for x, y in zip(starts[a:b][keep].tolist(), ends[a:b][keep].tolist(), strict=True)])
                    out.append((b - a, int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    return emit


def drop_repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: n_words, n_removed, kept_sha256 and kept (the words that stay, joined by spaces).

    A word goes if a window that covers it also starts in a text with a smaller key; windows are judged on
    the input. A null text has no words; shorter texts than a window keep all. Rows with equal keys never
    remove from each other, whatever their texts; a null key removes and loses nothing, further columns are not read.
    A row is named by its key and a hash of its text (t), so that each text loses its own words only.

    Whole texts are shuffled only where a bitmap of the ids says that they may share a minimiser, and again where they
    may lose words. Equal strings are one row before buckets form, and places are joined back by the strings' names: so a
    passage that a third of all texts share costs a row of each task, and its places are dealt by Spark's skew joins.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("t"))
    pairs = tx.stored(rows.where("id is not null").mapInArrow(tx.lean(_minimisers(window, minimiser)), "minimiser long, id long, t long"))
    repeat = pairs.groupBy("minimiser").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("minimiser")
    wanted = tx.stored(pairs.join(repeat, "minimiser").groupBy("id", "t").agg(F.collect_set("minimiser").alias("wanted")))
    asked = tx.maybe_in(rows, wanted).where("maybe").select("id", "text", "t")
    packed = asked.join(wanted.hint("shuffle_merge"), ["id", "t"]).select("id", "text", "wanted", "t").mapInArrow(tx.lean(_pack(window, minimiser)), "minimiser long, name long, packed binary, least long, most long, places array<struct<id:long,t:long,start:long>>")
    stored = tx.stored(packed)

    strings = stored.groupBy("minimiser", "name").agg(F.first("packed").alias("packed"), F.min("least").alias("least"), F.max("most").alias("most"))
    sizes = stored.groupBy("minimiser", "name").agg(F.first(F.length("packed")).alias("size")).groupBy("minimiser").agg(F.sum("size").alias("size"))
    large = tx.checkpoint(sizes.where(F.col("size") > bucket_bytes).select("minimiser"))  # a byte or less for each 1 MB of strings
    large = F.broadcast(large) if large.count() <= PICKED else large.hint("shuffle_merge")
    usual = strings.join(large, "minimiser", "left_anti").repartition("minimiser").sortWithinPartitions("minimiser")
    seen = usual.select("minimiser", "name", "packed", "least", "most").mapInArrow(tx.lean(_count(window)), "minimiser long, name long, seen array<long>")
    single = strings.join(large, "minimiser", "left_semi").select("minimiser", "name", "packed", "least").mapInArrow(tx.lean(_windows(window)), "a long, b long, minimiser long, name long, place long, least long")
    held = single.groupBy("a", "b").agg(F.min("least").alias("seen"))
    rest = single.join(held, ["a", "b"]).groupBy("minimiser", "name").agg(F.array_sort(F.collect_list(F.struct("place", "seen"))).alias("all"))
    seen = seen.unionByName(rest.select("minimiser", "name", F.col("all.seen").alias("seen")))

    found = stored.select("minimiser", "name", "places").join(seen, ["minimiser", "name"]).select("places", "seen")
    cuts = tx.stored(found.mapInArrow(tx.lean(_cuts), "id long, t long, start long, marks array<int>").groupBy("id", "t").agg(F.collect_list(F.struct("start", "marks")).alias("cuts")))
    asked = tx.maybe_in(rows, cuts)
    none = asked.where("not maybe").select("id", "text", F.lit(None).cast(cuts.schema["cuts"].dataType).alias("cuts"))
    some = asked.where("maybe").select("id", "text", "t").join(cuts.hint("shuffle_merge"), ["id", "t"], "left").select("id", "text", "cuts")
    out = [x.mapInArrow(tx.lean(_keep(window)), "id long, n_words long, n_removed long, kept_sha256 string, kept string") for x in (none, some)]
    return out[0].unionByName(out[1]).withColumnRenamed("id", key)
