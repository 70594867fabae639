"""Packing by shortest-pack-first over the length histogram.

Documents are tokenised, closed by an end id and cut at the sequence length; the rests vary in length. Only
the histogram of lengths (at most one number a length) comes to the driver. There, lengths are placed
longest first, each piece into a pack with the most room left (the shortest pack), counts of packs of one
pattern being updated as a whole. Patterns are then joined back to pieces by each piece's rank among those of its length.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import text as tx

LENGTH, END_ID = 2048, 1
#: Pieces of words whose ids a task remembers.
REMEMBERED = 600_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts by a byte-level BPE vocabulary with word ends, merged for all new pieces of words at once.

    The tokenizer's own rules cut words into runs of letters, single digits and runs of marks; as white space is
    dropped, no token spans it. Words with anything beyond ASCII and the letters of Latin-1, or with an apostrophe,
    or very long pieces, go through the tokenizer itself, as do whole texts that hold one of its added tokens. A piece
    is merged once a task.
    """

    _open: dict[str, WordIds] = {}

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model = held["model"]
        self.added = [t["content"].encode() for t in held.get("added_tokens", ())]
        vocabulary = model["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255 in order
        rest = [b for b in range(256) if b not in plain]
        sign = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        end = model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocabulary[sign[b]] for b in range(256)], np.int64)
        self.final = np.array([vocabulary[sign[b] + end] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pairs, self.rank = keys[order], order
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self._forget()

    @classmethod
    def open(cls, path: str) -> WordIds:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _forget(self) -> None:
        self.known, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _merge(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (flat) and their number for each row of initial symbols: the pair of least rank, leftmost first, until none is left."""
        n = len(symbols)
        count = np.zeros(n, np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rows = np.arange(n)
        while len(rows):
            width = symbols.shape[1]
            if width > 1:
                key = symbols[:, :-1] << 20 | symbols[:, 1:]
                at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                rank = np.where(self.pairs[at] == key, self.rank[at], len(self.pairs))
                place = rank.argmin(1)
                best = rank[np.arange(len(rows)), place]
                more = best < len(self.pairs)
            else:
                more = np.zeros(len(rows), bool)
            count[rows[~more]] = width
            done.append((rows[~more], symbols[~more]))
            rows = rows[more]
            if len(rows):
                symbols, place = symbols[more], place[more]
                symbols[np.arange(len(rows)), place] = self.merged[best[more]]
                keep = np.arange(width) != (place + 1)[:, None]
                symbols = symbols[keep].reshape(len(rows), width - 1)
        bounds = np.concatenate([[0], np.cumsum(count)])
        flat = np.empty(bounds[-1], np.uint32)
        for at, held in done:
            if len(at):
                flat[bounds[at][:, None] + np.arange(held.shape[1])] = held
        return flat, count

    def _learn(self, hashes: np.ndarray, data: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> None:
        if len(self.known) + len(hashes) > REMEMBERED:
            self._forget()
        length = ends - starts
        odd = odd | (length > 40)
        order, flats, counts = [], [], []
        for size in np.unique(length[~odd]).tolist():
            own = np.flatnonzero(~odd & (length == size))
            letters = data[starts[own][:, None] + np.arange(size)]
            symbols = self.inner[letters]
            symbols[:, -1] = self.final[letters[:, -1]]
            flat, count = self._merge(symbols)
            order.append(own)
            flats.append(flat)
            counts.append(count)
        own = np.flatnonzero(odd)
        if len(own):
            text = [raw[a:b].tobytes().decode() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
            said = [e.ids for e in self.tokenizer.encode_batch_fast(text, add_special_tokens=False)]
            order.append(own)
            flats.append(np.array([i for x in said for i in x], np.uint32))
            counts.append(np.array([len(x) for x in said], np.int64))
        first = len(self.bounds) - 1
        at = np.concatenate(order)
        self.ids = np.concatenate([self.ids, *flats])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(counts))])
        known = np.concatenate([self.known, hashes[at]])
        entry = np.concatenate([self.entry, first + np.arange(len(at))])
        turn = np.argsort(known)
        self.known, self.entry = known[turn], entry[turn]

    def encode_bytes(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and the place of each text's first (with their number at the end)."""
        flat, bounds = self._encode_words(raw, offsets)
        held = raw.tobytes()
        if not any(t in held for t in self.added):
            return flat, bounds
        said = np.split(flat, bounds[1:-1])
        for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if any(held.find(t, a, b) >= 0 for t in self.added):
                said[row] = np.array(self.tokenizer.encode(held[a:b].decode(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(said), np.concatenate([[0], np.cumsum([len(x) for x in said])])

    def _encode_words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens."""
        starts, ends, first = tx.words(raw, offsets, tx.NOT_SPACE)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        data = tx.fold(raw)
        kind = _KIND[data]
        lead = np.zeros(len(data), bool)
        lead[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        kind[lead] = 1
        kind[1:][lead[:-1]] = 1
        bad = np.concatenate([[0], np.cumsum(kind == 0)])
        odd_word = bad[ends] > bad[starts]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[~odd_word]] += 1
        np.add.at(inside, ends[~odd_word], -1)
        cut = np.cumsum(inside[:-1]) > 0
        begins = cut.copy()
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begins[starts] = True
        begin = np.flatnonzero(begins)
        word = np.searchsorted(starts, begin, "right") - 1
        end = np.minimum(np.append(begin[1:], len(data)), ends[word])
        odd = odd_word[word]
        name = tx.Hashes(data, 19).of(begin, end)
        if odd.any():  # such words keep their case and are told apart from pieces
            name[odd] = tx.Hashes(raw, 20).of(begin[odd], end[odd])
        unique, at, back = np.unique(name, return_index=True, return_inverse=True)
        seen = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        new = self.known[seen] != unique if len(self.known) else np.ones(len(unique), bool)
        if new.any():
            if len(self.known) + new.sum() > REMEMBERED:
                self._forget()
                new[:] = True
            self._learn(unique[new], data, raw, begin[at[new]], end[at[new]], odd[at[new]])
        entry = self.entry[np.searchsorted(self.known, unique)][back]
        count = self.bounds[entry + 1] - self.bounds[entry]
        done = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids[np.arange(done[-1]) + np.repeat(self.bounds[entry] - done[:-1], count)]
        return flat, done[np.searchsorted(begin, np.append(starts, len(data)))][first]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        held = [t.encode() for t in texts]
        flat, bounds = self.encode_bytes(np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64))
        return np.split(flat, bounds[1:-1])


def _kinds() -> np.ndarray:
    """0 what the tokenizer itself must see, 1 letters, 2 digits, 3 marks, 4 white space."""
    out = np.zeros(256, np.int8)
    out[0x21:0x7F] = 3
    out[0x61:0x7B] = 1
    out[0x30:0x3A] = 2
    out[0x27] = 0
    out[[*range(0x09, 0x0E), 0x20]] = 4
    return out


_KIND = _kinds()


def token_ids(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    return lambda texts: WordIds.open(path).encode(texts)


def _pieces(encode: Callable[[list[str]], list[np.ndarray]] | str, length: int, end: int):
    """Rows of pieces; encode is a function of texts, or the path of a vocabulary."""

    def ids_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(encode, str):
            return WordIds.open(encode).encode_bytes(data, offsets)
        raw = data.tobytes()
        said = encode([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        return np.concatenate([np.zeros(0, np.uint32), *said]), np.concatenate([[0], np.cumsum([len(x) for x in said])])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = np.zeros(length + 1, np.int64)
        for batch in batches:
            for low, _, data, offsets in tx.slices(batch.column(1)):
                flat, bounds = ids_of(data, offsets)
                rows = []
                for row in range(len(offsets) - 1):
                    ids = np.append(flat[bounds[row] : bounds[row + 1]], end).astype("<u4")
                    for start in range(0, len(ids), length):
                        piece = ids[start : start + length]
                        rows.append((low + row, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), int(turn[len(piece)])))
                        turn[len(piece)] += 1
                at, *columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, pa.int64()) for c in columns)], ["id", "start", "length", "ids_crc32", "doc_tokens", "turn"])

    return emit


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[int, dict[int, int]]]:
    """(count, how often each length is in it) of each pattern; every length is placed as often as the histogram has it.

    A piece goes to one of the packs with the most room, which then have less; where the length has fewer occurrences
    left than such a pattern has packs, the pattern is divided. What finds no room opens new packs, filled one by one.
    """
    patterns: list[list] = []  # count, {length: times}
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []

    def put(count: int, pattern: dict[int, int], room: int) -> None:
        patterns.append([count, pattern])
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(len(patterns) - 1)

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if not rooms or rooms[-1] < size:
                times = length // size
                if left >= times:
                    put(left // times, {size: times}, length - times * size)
                if left % times:
                    put(1, {size: left % times}, length - left % times * size)
                break
            room = rooms[-1]
            k = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[-1]
            count, pattern = patterns[k]
            use = min(count, left)
            if use < count:
                patterns[k][0] = count - use
                if room not in by_room:
                    by_room[room] = []
                    insort(rooms, room)
                by_room[room].append(k)
            else:
                patterns[k] = [0, {}]
            put(use, pattern | {size: pattern.get(size, 0) + 1}, room - size)
            left -= use
    return [(count, pattern) for count, pattern in patterns if count]


def slots(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, count): pieces of the length with these ranks go to these sequences."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for size in sorted(pattern, reverse=True):
            for _ in range(pattern[size]):
                out.append((size, rank.get(size, 0), sequence, offset, count))
                rank[size] = rank.get(size, 0) + count
                offset += size
        sequence += count
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, encode: Callable[[list[str]], list[np.ndarray]] | str | None = None, length: int = LENGTH, end: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    encode is a function of texts, or the path of a vocabulary (default: words of 49,408 ids). A null or empty text is the end id alone. Repeated rows are packed each on their own; an empty table gives
    an empty one; further columns are not read. Ties between pieces of one length go by task and place in it.
    """
    encode = encode or default_tokenizer()
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    cut = rows.mapInArrow(tx.lean(_pieces(encode, length, end)), "id long, start long, length long, ids_crc32 long, doc_tokens long, turn long")
    # The task's number is kept with the rows, so that both uses below see the same ranks.
    pieces = tx.checkpoint(cut.withColumn("task", F.spark_partition_id()))
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row a length
    table = slots(shortest_pack_first(totals, length))
    before = _running(counts)
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("turn"))
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "rank"]
    bounds = np.searchsorted(table[:, 0], np.arange(length + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            cuts = np.flatnonzero(np.diff(size[order])) + 1
            for rows_ in np.split(order, cuts) if len(order) else ():
                own = table[bounds[size[rows_[0]]] : bounds[size[rows_[0]] + 1]]
                at = np.searchsorted(own[:, 1], rank[rows_], "right") - 1
                sequence[rows_] = own[at, 2] + rank[rows_] - own[at, 1]
                offset[rows_] = own[at, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*columns[:5], "sequence_id", "offset"])

    out = ranked.select(*columns).mapInArrow(tx.lean(place), "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", key)


def _running(counts: DataFrame) -> DataFrame:
    """Pieces of each length in earlier tasks. The window of a length holds one row a task."""
    from pyspark.sql import Window

    order = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("task", "length", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
