"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

A random walk reads the words of an item-sized window: at each step it writes the word under its pointer and
moves on by a random bit that depends on step and word. Windows a few edits apart write strings at a small
Hamming distance, so hashes of a few sampled places collide; repeats over several walks reach the recall.
Candidates are then confirmed by their exact edit distance in words.

Most windows can't be within the allowed edits of any item: that takes a number of pairs of consecutive words
in common with items of that length. Only windows that have them are embedded, which loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import text as tx

#: Edits allowed, in hundredths of an item's words.
EDITS = 20
#: Walks, hashes sampled from each, and places in a hash.
WALKS, SAMPLES, PLACES = 4, 15, 3
#: UTF-8 bytes of benchmark items whose index is sent to the tasks at once; more items take more passes.
INDEX_BYTES = 8 << 20


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = tx.fold(data)
    starts, ends, first = tx.words(data, offsets, tx.ALNUM)
    return tx.Hashes(data, 17).of(starts, ends), first


def cgk(windows: np.ndarray, walk: int) -> np.ndarray:
    """rows x 3 length: the embedding of the windows (rows x length of word hashes); 0 when the pointer is past the end."""
    n, length = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], 1).ravel()
    at, end = np.arange(n) * (length + 1), np.arange(n) * (length + 1) + length
    bits = tx.mix(padded ^ tx.seeded(walk + 1, 18)[walk])  # one random bit a word and step, 64 steps to a hash
    out = np.empty((n, 3 * length), np.uint64)
    for step in range(3 * length):
        if step and step % 64 == 0:
            bits = tx.mix(bits)
        out[:, step] = padded[at]
        at = np.minimum(at + ((bits[at] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64), end)
    return out


def lsh_keys(windows: np.ndarray, length: int) -> np.ndarray:
    """rows x (WALKS SAMPLES): hashes of the places sampled from each walk's embedding."""
    out = []
    for walk in range(WALKS):
        embedded = cgk(windows, walk)
        places = (tx.seeded(SAMPLES * PLACES, 100 + walk) % np.uint64(3 * length)).astype(np.int64).reshape(SAMPLES, PLACES)
        for k in range(SAMPLES):
            key = np.full(len(windows), (walk * SAMPLES + k + 1) * 0x9E3779B97F4A7C15 & tx._MASK, np.uint64)
            for p in places[k]:
                key = tx.mix(key ^ embedded[:, p])
            out.append(key)
    return np.stack(out, 1)


def edit_distance(items: np.ndarray, texts: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the least edit distance between the item and any prefix of the text, and that prefix's length (the least).

    items: rows x length; texts: rows x width, of which the first valid places are words.
    """
    n, length = items.shape
    width = texts.shape[1]
    steps = np.arange(width + 1)
    row = np.broadcast_to(steps, (n, width + 1)).copy()
    for k in range(length):
        new = np.minimum(row[:, 1:] + 1, row[:, :-1] + (texts != items[:, k : k + 1]))
        new = np.concatenate([np.full((n, 1), k + 1), new], 1)
        row = np.minimum.accumulate(new - steps, 1) + steps  # words of the text left out
    row[steps[None, :] > valid[:, None]] = length + width
    return row.min(1), row.argmin(1)


class Index:
    """Items by length: words, LSH keys, and which pairs of consecutive words occur among items of which length."""

    def __init__(self, items: list[tuple[int, str]], edits: int):
        raw = [t.encode() for _, t in items]
        hashes, first = word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
        groups: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, (item, _) in enumerate(items):
            own = hashes[first[k] : first[k + 1]]
            if len(own):
                groups.setdefault(len(own), []).append((item, own))
        self.items, self.words, self.allowed, self.need, self.twice = {}, {}, {}, {}, {}
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        pairs, lengths = [], []
        for length, own in groups.items():
            self.items[length] = np.array([i for i, _ in own], np.int64)
            self.words[length] = np.stack([w for _, w in own])
            self.allowed[length] = length * edits // 100
            self.need[length] = max(1, length - 1 - 2 * self.allowed[length])
            keys = lsh_keys(self.words[length], length)
            order = np.argsort(keys.ravel(), kind="stable")
            self.keys[length] = keys.ravel()[order], np.repeat(np.arange(len(own)), keys.shape[1])[order]
            each = [np.unique(_pairs(w)) for _, w in own]
            self.twice[length] = max(max(length - 1, 1) - len(x) for x in each)  # pairs that an item has again
            found = np.unique(np.concatenate(each))
            pairs.append(found)
            lengths.append(np.full(len(found), length))
        pairs, lengths = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (pairs, lengths))
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.lengths = pairs[order], lengths[order].astype(np.int64)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.pairs >> np.uint64(48)).astype(np.int64)] = True

    def starts(self, hashes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each length, the words at which a passage within the allowed edits of such an item can start."""
        if not len(hashes):
            return
        own = _pairs(hashes)
        at = np.flatnonzero(self.sieve[(own >> np.uint64(48)).astype(np.int64)])
        low, high = np.searchsorted(self.pairs, own[at], "left"), np.searchsorted(self.pairs, own[at], "right")
        count = high - low
        where = np.repeat(at, count)
        length = self.lengths[np.arange(count.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)]
        order = np.lexsort((where, length))
        where, length = where[order], length[order]
        for size in np.unique(length).tolist():
            p = where[slice(*np.searchsorted(length, [size, size + 1]))]
            need, reach = self.need[size], size + self.allowed[size] - 1 - (size > 1)
            if len(p) < need:
                continue
            first, last = p[: len(p) - need + 1], p[need - 1 :]
            close = (last - first <= reach) & (owner[first] == owner[last])
            if not close.any():
                continue
            begin = np.maximum(last[close] - reach, np.searchsorted(owner, owner[first[close]]))
            mark = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(mark, begin, 1)
            np.add.at(mark, first[close] + 1, -1)
            found = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            held = np.zeros(len(hashes) + reach, np.uint64)
            held[p] = own[p]
            spread, keep = np.arange(reach + 1), []
            for k in range(0, len(found), 1024):  # a pair that comes again counts as often as an item can have it
                seen = np.sort(held[found[k : k + 1024, None] + spread], 1)
                keep.append(((seen[:, 1:] != seen[:, :-1]).sum(1) + (seen[:, 0] > 0)) >= need - self.twice[size])
            if len(found := found[np.concatenate(keep)]):
                yield size, found

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, distance, start, end) of the best place of each item found in each row."""
        owner = tx.owners(first)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for length, starts in self.starts(hashes, owner):
            allowed = self.allowed[length]
            for low in range(0, len(starts), 1024):
                at = starts[low : low + 1024]
                room = first[owner[at] + 1] - at
                width = length + allowed
                spread = np.minimum(at[:, None] + np.arange(width), len(hashes) - 1)
                text = np.where(np.arange(width) < room[:, None], hashes[spread], np.uint64(0))
                keys = lsh_keys(text[:, :length], length)
                known, item = self.keys[length]
                a, b = np.searchsorted(known, keys.ravel(), "left"), np.searchsorted(known, keys.ravel(), "right")
                count = b - a
                window = np.repeat(np.repeat(np.arange(len(at)), keys.shape[1]), count)
                chosen = item[np.arange(count.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(count)[:-1]]), count)]
                pairs = np.unique(np.stack([window, chosen], 1), axis=0)
                for part in range(0, len(pairs), 4096):
                    window, chosen = pairs[part : part + 4096].T
                    distance, size = edit_distance(self.words[length][chosen], text[window], np.minimum(room[window], width))
                    for k in np.flatnonzero(distance <= allowed).tolist():
                        place = int(owner[at[window[k]]]), int(self.items[length][chosen[k]])
                        start = int(at[window[k]] - first[place[0]])
                        best[place] = min(best.get(place, (1 << 40, 0, 0)), (int(distance[k]), start, start + int(size[k])))
        for (row, item), (distance, start, end) in sorted(best.items()):
            yield row, item, distance, start, end


def _pairs(words: np.ndarray) -> np.ndarray:
    """A hash of each word and the next; of a single word, of itself."""
    if len(words) == 1:
        return tx.mix(words.copy())
    return tx.mix(words[:-1] * np.uint64(0xF1357AEA2E62A9C5) + words[1:])


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: int = EDITS, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per text and benchmark item that it holds within the allowed edits: distance, start and end in words.

    Words are letters and digits, lower-cased; an item may take edits hundredths of its words, rounded down. Of
    several places the one with the least distance, then the first, is given. Null or empty texts and items without
    words match nothing; repeated rows each get their rows; empty tables give an empty one; further columns are not
    read. The index of the items is sent to all tasks, so it is built of at most index_bytes of text (by hash of
    the item's key); a larger benchmark takes a pass over the texts for each such part.
    """
    said = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    size = said.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // index_bytes) or 1
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "id long, item long, distance long, start long, end long"
    out = None
    for part in range(parts):
        own = said.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part) if parts > 1 else said
        index = Index([(r["item"], r["text"]) for r in own.collect()], edits)  # bounded by index_bytes
        found = rows.mapInArrow(tx.lean(_search(index)), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"id": key, "item": item})


def _search(index: Index):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, data, offsets in tx.slices(batch.column(1)):
                found = list(index.matches(*word_hashes(data, offsets)))
                columns = list(zip(*found, strict=True)) if found else [()] * 5
                ids = batch.column(0).take(pa.array([low + r for r in columns[0]], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns[1:])], ["id", "item", "distance", "start", "end"])

    return emit
