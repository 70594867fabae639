"""Words and fingerprints of whole UTF-8 texts, taken from Arrow buffers without a Python object per word.

A batch of texts is read as one byte array with the offset of each row. Words are runs of bytes of a
class; as every UTF-8 byte of a non-ASCII character is at least 0x80, classes that hold all non-ASCII
characters or none can be told byte by byte.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE = 1 << 19

_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true inside the closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Digits, lower-case letters and everything beyond ASCII (texts are lower-cased first).
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Letters, with everything beyond ASCII.
LETTER = byte_class((0x61, 0x7A), (0x80, 0xFF))
DIGIT = byte_class((0x30, 0x39))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; all other bytes as they are."""
    return _LOWER[data]


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z and the capital letters of Latin-1 lower-cased, in UTF-8."""
    data = lower(data)
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    return np.where(after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), data + np.uint8(0x20), data)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, where, held = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        high = min(high, n)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word; the index of each row's first word, and their number at the end."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside & edge[:-1]
    begins[1:] |= inside[1:] & ~inside[:-1]
    closes = inside & edge[1:]
    closes[:-1] |= inside[:-1] & ~inside[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64((seed * 0xD1342543DE82EF95 + 1) & _MASK))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** n modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) <= n:
        out = np.full(max(n + 1, SLICE + 1), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base]


class Hashes:
    """Hashes of any ranges of a byte array in constant time each, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum(seeded(256, seed)[data] * _power(_BASE, n)[:n], out=self.sums[1:])
        self.back = _power(_INVERSE, n)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        out += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(out)


def owners(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(hashes: np.ndarray, owner: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one row, and the index of the first word of each."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(count, (seed * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) & _MASK, np.uint64)
    for k in range(n):
        out *= np.uint64(0xF1357AEA2E62A9C5)
        out += hashes[k : k + count]
    where = np.flatnonzero(owner[n - 1 :] == owner[:count])
    return mix(out[where]), where


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shared_dir(spark) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset a new local one, on a local master (as in tests) only."""
    context = spark.sparkContext
    if found := context._jsc.sc().getCheckpointDir():
        if found.isDefined():
            return found.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts the lineage: the rows go to the shared folder, so a lost executor costs none of them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder, read back. Cuts the lineage like checkpoint, at less disk."""
    path = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a filter for each id, and of a whole filter at most (64 MB): more ids than fit only make it let more rows through.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 29


def maybe_in(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows with a column maybe: true where the key is among the ids, and by chance for few others (a sixteenth at most
    until the filter is full). What is broadcast is a bitmap of bounded size, not the ids."""
    bits = min(MOST_FILTER_BITS, max(1 << 15, FILTER_BITS * ids.count()))
    slot = (F.pmod(F.xxhash64(key), F.lit(bits)) + 1).alias("slot")
    bucket, at = F.expr("bitmap_bucket_number(slot)").alias("bucket"), F.expr("bitmap_bit_position(slot)")
    maps = ids.select(slot).select(bucket, at.alias("at")).groupBy("bucket").agg(F.expr("bitmap_construct_agg(at)").alias("held"))
    asked = rows.select("*", slot).select("*", bucket).join(F.broadcast(maps), "bucket", "left")
    held = F.conv(F.hex(F.expr("substring(held, cast(bitmap_bit_position(slot) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce((held / F.expr("shiftleft(1, cast(bitmap_bit_position(slot) % 8 as int))")).cast("int") % 2 == 1, F.lit(False))
    return asked.select(*[F.col(f"`{c}`") for c in rows.columns], hit.alias("maybe"))


def sample_by_hash(df: DataFrame, key: str, seed: int, n: int, spare: int = 1) -> DataFrame:
    """Rows whose key's hash (column turn) is small: about spare n of them in the mean, all if there are fewer.

    The cut is a share of the number of rows, so that no task sends on more than its share of the sample.
    """
    total = df.select(key).count()
    share = min(1.0, 1.5 * spare * n / max(total, 1))
    turn = F.xxhash64(F.col(key), F.lit(seed))
    return df.withColumn("turn", turn).where(F.pmod("turn", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)


def carried(df: DataFrame, carry: bool, text: str) -> list:
    """The text, or the whole row as one struct (so that no name in it can clash) if it is to come along."""
    return [F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row")] if carry else [F.col(text).alias("text")]


def text_of(batch: pa.RecordBatch, column: int, place: int | None) -> pa.Array:
    """The texts of a batch: a column, or the field of the row that came along at this place."""
    held = batch.column(column)
    return held if place is None else held.field(place)


def with_row(schema: str, df: DataFrame, carry: bool) -> T.StructType:
    out = T.StructType.fromDDL(schema)
    return out.add("row", df.schema, False) if carry else out


def trim() -> None:
    """Gives freed memory back to the system, which a worker that is used again, or the driver, would otherwise keep."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The function, with freed memory given back at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        trim()

    return run


def arrow_map(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """mapInArrow over the given columns only, in batches that a worker's memory holds."""
    return df.mapInArrow(lean(function), schema)
