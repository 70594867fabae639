"""Periodic runs of words by online dyadic square catching.

Words are appended one by one; whenever a block of L words (L a power of two, blocks at multiples of L) is complete,
it becomes a catcher. A catcher waits for the block to come again between 2 L and 4 L words further on: after each
appended word, the suffix of L words is compared with the two catchers of each level that wait for it at that moment
(at L = 1 also with the word before). Of a stretch of period p with 2 L <= p < 4 L, the first half of every square
holds a whole block, so no square is missed. Catches of neighbouring blocks at one distance belong to one stretch;
its ends, less than a block further on, are found word by word, and the stretch is reported as one run.

Suffixes and blocks are compared by 64-bit names that double from level to level; what is reported is checked on the
words themselves. The comparisons that one level makes for all appended words of a slice are two array operations, so
a text of n words takes n log n of them, and no more than a few arrays of its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import text as tx

#: A run has this many words at least, and this many times its period.
LEAST_LENGTH, LEAST_EXPONENT = 24, 3


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Equal words have equal numbers; before each row and at the end stands a negative number that occurs once.

    Word k of row r (k counted over all rows) stands at k + r + 1.
    """
    out = np.empty(len(starts) + len(first), np.int64)
    borders = first + np.arange(len(first))
    out[borders] = -1 - np.arange(len(first))
    if len(starts):
        sizes = ends - starts
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside].tobytes())])
        taken = np.ones(len(out), bool)
        taken[borders] = False
        out[taken] = pc.dictionary_encode(words).indices.to_numpy()
    return out


class Catchers:
    """The runs of a row of numbers, level by level of the catchers; borders between texts are numbers that occur once."""

    def __init__(self, numbers: np.ndarray, least_length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT):
        if exponent < 3 or least_length < 1:
            raise ValueError("runs of three periods at least")
        self.numbers, self.least_length, self.exponent = numbers, least_length, exponent
        self.found: list[tuple[int, int, int]] = []

    def runs(self, longest: int) -> np.ndarray:
        """(start, end, period) of all runs, by start, then period; longest is the length of the longest text."""
        names, level = tx.mix(self.numbers.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
        self._report(1, 1, names[1:] == names[:-1])
        while 2 * level * self.exponent <= longest:
            blocks = np.repeat(names[::level], level)
            for gap in (2 * level, 3 * level):
                if gap * self.exponent <= longest:
                    self._report(level, gap, names[gap:] == blocks[: len(names) - gap])
            if len(names) <= level:
                break
            names = tx.mix(names[:-level] * np.uint64(0xF1357AEA2E62A9C5) + names[level:])
            level *= 2
        return np.array(sorted(self.found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)

    def _report(self, level: int, gap: int, caught: np.ndarray) -> None:
        """Takes what the catchers of one level caught; entry h is the block at h // level, found again gap + h % level words on."""
        hits = np.flatnonzero(caught)
        if not len(hits):
            return
        block, period = hits // level, gap + hits % level
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        new = np.ones(len(hits), bool)
        new[1:] = (period[1:] != period[:-1]) | (block[1:] != block[:-1] + 1)
        begins = np.flatnonzero(new)
        count, block, period = np.diff(np.append(begins, len(hits))), block[begins], period[begins]
        stretch = np.maximum(self.least_length, self.exponent * period) - period  # words that equal the one a period later, at least
        keep = count >= np.maximum(1, (stretch - level + 1) // level)
        low, high, period = block[keep] * level, (block + count)[keep] * level, period[keep]
        keep = ~self._covered(low, high + period)
        for a, b, p in zip(low[keep].tolist(), high[keep].tolist(), period[keep].tolist(), strict=True):
            self._extend(a, b, p, level)

    def _covered(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """What lies inside a run of a smaller period has that period, which divides its own (by length), so it is no run of its own."""
        if not self.found:
            return np.zeros(len(low), bool)
        known = np.array(sorted(self.found), np.int64)
        furthest = np.maximum.accumulate(known[:, 1])
        at = np.searchsorted(known[:, 0], low, "right") - 1
        return (at >= 0) & (furthest[np.maximum(at, 0)] >= high)

    def _extend(self, low: int, high: int, period: int, level: int) -> None:
        """Advances both ends of [low, high), whose words equal those a period later, over less than a block each."""
        x = self.numbers
        least = max(0, low - level)
        left = (x[least:low] == x[least + period : low + period])[::-1]
        low -= len(left) if left.all() else int(left.argmin())
        most = min(len(x) - period, high + level)
        right = x[high:most] == x[high + period : most + period]
        high += len(right) if right.all() else int(right.argmin())
        if high + period - low < max(self.least_length, self.exponent * period):
            return
        equal = np.concatenate([[False], x[low:high] == x[low + period : high + period], [False]])
        edges = np.flatnonzero(equal[1:] != equal[:-1])  # one stretch, unless two names agree by chance
        for a, b in zip((low + edges[::2]).tolist(), (low + edges[1::2]).tolist(), strict=True):
            if b + period - a >= max(self.least_length, self.exponent * period):
                self.found.append((a, b + period, period))


def best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The (start, length, period) with the greatest length / period, compared exactly; then the least start, then period."""
    top = None
    for r in runs:
        if top is None or (r[1] * top[2], -r[0], -r[2]) > (top[1] * r[2], -top[0], -top[2]):
            top = r
    return top


def _scan(least_length: int, exponent: int, keep_text: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tx.slices(batch.column(1)):
                starts, ends, first = tx.words(data, offsets, tx.NOT_SPACE)
                found = Catchers(word_numbers(data, starts, ends, first), least_length, exponent).runs(int(np.diff(first).max()))
                row = np.searchsorted(first[:-1] + np.arange(high - low), found[:, 0], "right") - 1
                edges = np.searchsorted(row, np.arange(high - low + 1))
                raw, out = data.tobytes(), []
                for r in range(high - low):
                    a, b = int(first[r]), int(first[r + 1])
                    own = [(s - a - r - 1, e - s, p) for s, e, p in found[edges[r] : edges[r + 1]].tolist()]
                    if own:
                        gone = np.zeros(b - a + 1, np.int64)
                        for s, n, p in own:
                            gone[s + p] += 1
                            gone[s + n] -= 1
                        stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + a
                    else:
                        stay = np.arange(a, b)
                    kept = b" ".join([raw[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)])
                    top = best(own) or (None, None, None)
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in own)
                    milli = 1000 * top[1] // top[2] if own else None
                    out.append((len(own), *top, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), b - a, b - a - len(stay), [{"start": s, "length": n, "period": p} for s, n, p in own] if keep_text else None, kept.decode() if keep_text else None))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], *columns], _NAMES)

    return emit


_NAMES = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words", "n_dropped", "runs", "collapsed"]
_TYPES = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])), pa.string()]
_SCHEMA = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT, keep_text: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: its runs (start, length, period in words, from word 0), the most repetitive one, and the text without the repeats.

    Words are split at white space. A run is a stretch of least_length words and exponent periods at least, that has no
    smaller period and can't be longer. collapsed is the text without all words that a run holds after its first period;
    runs and collapsed are null without keep_text, their sha256 are there always. Of runs with equal length / period the
    first by start, then period, is given; without runs the four numbers are null. A null or empty text has no words; rows
    with equal keys, or a null key, are rows of their own; an empty table gives an empty one, further columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(tx.lean(_scan(least_length, exponent, keep_text)), _SCHEMA).withColumnRenamed("id", key)
