"""Masked pseudo-likelihood: a window network predicts every word from the words on both sides.

p(word | both sides) is a hierarchical softmax: the network (position-wise embeddings, one hidden layer) gives the
probability of a branch and of a class in it; a class is a frequent word, or all other words of an ending, each of which has
its share of the class by the counts of the whole corpus. The network is trained on all texts: groups of documents are
fitted apart in numpy and averaged in Spark after each pass. A text's score is the sum of log p over all its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import text as tx

#: Words with a class of their own, classes of all others; words on either side, hidden units.
FREQUENT, ENDINGS = 191, 64
REACH, HIDDEN = 2, 24
#: The class of what lies beyond the text, which is never predicted; branches of the softmax, classes of each.
EDGE = FREQUENT + ENDINGS
BRANCHES, LEAVES = 16, (EDGE + 1) // 16
#: Passes over all texts, positions of a step, words of a group that is fitted apart (in the mean).
PASSES, BATCH, GROUP = 2, 2048, 4_000_000
#: Most frequent words whose counts travel with the network (16 bytes each); those of all others are joined in Spark.
CARRIED = 1 << 17
#: Weights that travel in one row.
BLOCK = 1024
#: Logarithms are summed in Spark as whole millionths, so that the order of the sum can't matter.
MICRO = 1e6
#: Distinct words that a task counts before it hands them on.
FLUSH = 600_000
#: Bytes of text that are worked on at once: few enough for the hashes of their words to stay in a core's cache.
SLICE = 1 << 18


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending class of each word, and the index of each row's first."""
    data = tx.lower(data)
    starts, ends, first = tx.words(data, offsets, tx.NOT_SPACE)
    h = tx.Hashes(data, 13)
    ending = (h.of(np.maximum(starts, ends - 2), ends) % np.uint64(ENDINGS)).astype(np.int64)
    return tx.signed(h.of(starts, ends)), ending, first


def _distinct(word: np.ndarray, ending: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word once, in order, with the sum of its n."""
    by = np.argsort(word)
    word = word[by]
    begin = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
    return word[begin], ending[by[begin]], np.add.reduceat(n[by], begin) if len(begin) else n


def count_words(docs: DataFrame, text: str = "text", flush: int = FLUSH) -> DataFrame:
    """(word, ending, n) of every distinct word of all texts; words are named by their hash."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
        waiting = 0
        for batch in batches:
            for _, _, data, offsets in tx.slices(batch.column(0), SLICE):
                word, ending, _ = _words(data, offsets)
                held.append(_distinct(word, ending, np.ones(len(word), np.int64)))
                waiting += len(held[-1][0])
                if waiting > flush:  # only now are the slices' words brought together
                    held, waiting = [_distinct(*map(np.concatenate, zip(*held, strict=True)))], 0
                    if len(held[0][0]) > flush:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["word", "ending", "n"])
                        held = [(np.zeros(0, np.int64),) * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _distinct(*map(np.concatenate, zip(*held, strict=True)))], ["word", "ending", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(tx.lean(emit), "word long, ending long, n long")
    return found.groupBy("word", "ending").agg(F.sum("n").alias("n"))


class Network:
    def __init__(self, frequent: np.ndarray, mass: np.ndarray, seed: int = 3):
        """mass: for each ending the words counted in it, plus one for each type and one for what was never seen."""
        rng = np.random.default_rng(seed)
        self.frequent = np.sort(frequent)
        self.log_mass = np.zeros(EDGE + 1)  # log p(word | class) without the word's own count
        self.log_mass[FREQUENT:EDGE] = -np.log(np.maximum(mass, 1))
        self.embed = rng.normal(0, 0.1, (2 * REACH, EDGE + 1, HIDDEN)).astype(np.float32)
        self.hidden = np.zeros(HIDDEN, np.float32)
        self.branch, self.branch_bias = rng.normal(0, 0.1, (HIDDEN, BRANCHES)).astype(np.float32), np.zeros(BRANCHES, np.float32)
        self.leaf, self.leaf_bias = rng.normal(0, 0.1, (BRANCHES, HIDDEN, LEAVES)).astype(np.float32), np.zeros((BRANCHES, LEAVES), np.float32)
        self.leaf_bias[-1, -1] = -1e4  # EDGE is never predicted
        self.seen = [np.full(w.shape, 1e-4, np.float32) for w in self.weights()]

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.hidden, self.branch, self.branch_bias, self.leaf, self.leaf_bias]

    def flat(self) -> np.ndarray:
        """All weights and their sums of squared slopes in one row."""
        return np.concatenate([x.ravel() for x in (*self.weights(), *self.seen)])

    def put(self, flat: np.ndarray) -> np.ndarray:
        """Takes a copy of such a row, of which all weights and sums are views from now on. The copy."""
        flat, shapes = np.array(flat, np.float32), [w.shape for w in self.weights()]
        views = _views(flat, shapes * 2)
        self.embed, self.hidden, self.branch, self.branch_bias, self.leaf, self.leaf_bias = views[: len(shapes)]
        self.seen = views[len(shapes) :]
        return flat

    def classes(self, word: np.ndarray, ending: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return FREQUENT + ending
        at = np.minimum(np.searchsorted(self.frequent, word), len(self.frequent) - 1)
        return np.where(self.frequent[at] == word, at, FREQUENT + ending)

    def contexts(self, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """words x 2 REACH: the classes on both sides, EDGE beyond the text."""
        owner, n = tx.owners(first), len(classes)
        out = np.full((n, 2 * REACH), EDGE, np.uint8)
        for d in range(1, REACH + 1):
            if d < n:
                same = owner[d:] == owner[:-d]
                out[d:, REACH - d] = np.where(same, classes[:-d], EDGE)
                out[:-d, REACH + d - 1] = np.where(same, classes[d:], EDGE)
        return out

    def _units(self, context: np.ndarray) -> np.ndarray:
        x = np.take(self.embed[0], context[:, 0], axis=0)
        for k in range(1, 2 * REACH):
            x += np.take(self.embed[k], context[:, k], axis=0)
        x += self.hidden
        return np.tanh(x, out=x)

    def _leaves(self, h: np.ndarray, branch: np.ndarray, bounds: list[int]) -> np.ndarray:
        """Leaf logits of rows that come in the order of their branches."""
        out = np.empty((len(h), LEAVES), np.float32)
        for g in range(BRANCHES):
            a, b = bounds[g], bounds[g + 1]
            if a < b:
                np.matmul(h[a:b], self.leaf[g], out=out[a:b])
        out += np.take(self.leaf_bias, branch, axis=0)
        return out

    def fit(self, context: np.ndarray, target: np.ndarray, seed: int = 4, rate: float = 0.15) -> Network:
        """One pass of Adagrad on the conditional log-likelihood, on from the present weights."""
        order, place = np.random.default_rng(seed).permutation(len(target)), np.arange(2 * REACH, dtype=np.uint16)[:, None] * (EDGE + 1)
        target, flat = target.astype(np.uint8, copy=False), self.put(self.flat())
        value, seen = np.split(flat, 2)
        slope = np.empty_like(value)
        embed, hidden, above, above_bias, below, below_bias = _views(slope, [w.shape for w in self.weights()])
        embed = embed.reshape(-1, HIDDEN).view(np.complex64)  # of two units each
        for low in range(0, len(order), BATCH):
            at = order[low : low + BATCH]
            own = target[at]
            by = np.argsort(own, kind="stable")
            near, own, rows, ones = np.take(context, at[by], axis=0), own[by], np.arange(len(at)), np.ones(len(at), np.float32)
            branch, leaf, bounds = _of_branches(own)
            h = self._units(near)
            p = _softmax(h @ self.branch + self.branch_bias)
            q = _softmax(self._leaves(h, branch, bounds))
            p.ravel()[rows * BRANCHES + branch] -= 1
            q.ravel()[rows * LEAVES + leaf] -= 1
            slope[:] = 0
            back = np.empty_like(h)
            for g in range(BRANCHES):
                a, b = bounds[g], bounds[g + 1]
                if a < b:
                    np.matmul(q[a:b], self.leaf[g].T, out=back[a:b])
                    np.matmul(h[a:b].T, q[a:b], out=below[g])
                    np.matmul(ones[a:b], q[a:b], out=below_bias[g])
            np.matmul(h.T, p, out=above)
            np.matmul(ones, p, out=above_bias)
            back += p @ self.branch.T
            h *= h
            back *= np.subtract(1, h, out=h)
            np.matmul(ones, back, out=hidden)
            key = (near.T + place).ravel()
            by = np.argsort(key, kind="stable")
            key = key[by]
            begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            pairs = np.take(np.ascontiguousarray(back.view(np.complex64).T), np.tile(rows, 2 * REACH)[by], axis=1)
            embed[key[begins]] = np.add.reduceat(pairs, begins, axis=1).T
            slope /= len(at)
            seen += slope * slope
            slope *= rate
            value -= np.divide(slope, np.sqrt(seen), out=slope)
        return self

    def log_probs(self, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log p(class | both sides) of every word, and for classes by ending what log p(word | class) has besides the word's count."""
        context, out, classes = self.contexts(classes, first), np.empty(len(classes)), classes.astype(np.uint8)
        for low in range(0, len(classes), 4096):
            own = classes[low : low + 4096]
            by = np.argsort(own, kind="stable")
            own, rows = own[by], np.arange(len(own))
            branch, leaf, bounds = _of_branches(own)
            h = self._units(np.take(context[low : low + 4096], by, axis=0))
            z, y = h @ self.branch + self.branch_bias, self._leaves(h, branch, bounds)
            own_z, own_y = z.ravel()[rows * BRANCHES + branch], y.ravel()[rows * LEAVES + leaf]
            out[low + by] = own_z - _log_sum(z) + own_y - _log_sum(y) + self.log_mass[own]
        return out


def _views(flat: np.ndarray, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """The row cut into arrays of these shapes, which share its memory."""
    ends = np.cumsum([int(np.prod(shape)) for shape in shapes])
    return [x.reshape(shape) for x, shape in zip(np.split(flat, ends[:-1]), shapes, strict=True)]


def _of_branches(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Branch and leaf of each of these classes, which come in order; where each branch's rows begin."""
    branch = own // LEAVES
    return branch, own - branch * np.uint8(LEAVES), np.cumsum(np.append(0, np.bincount(branch, minlength=BRANCHES))).tolist()


def _softmax(z: np.ndarray) -> np.ndarray:
    np.exp(np.minimum(z, 60, out=z), out=z)
    z /= (z @ np.ones(z.shape[1], np.float32))[:, None]
    return z


def _log_sum(z: np.ndarray) -> np.ndarray:
    np.exp(np.minimum(z, 60, out=z), out=z)
    return np.log(z @ np.ones(z.shape[1], np.float32))


def _begins(words: np.ndarray) -> np.ndarray:
    """Where the words with each value of the first 18 bits begin among words in order."""
    return np.searchsorted(words >> 46, np.arange(-(1 << 17), (1 << 17) + 1)).astype(np.int32)


def _find(asked: np.ndarray, words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The place of each word among words in order, -1 for what is not among them."""
    at, part = np.full(len(asked), -1, np.int64), (asked >> 46) + (1 << 17)
    place, end = begins[part], begins[part + 1]
    left = np.flatnonzero(place < end)
    while len(left):  # the words of a part are few, since they are hashes
        hit = words[place[left]] == asked[left]
        at[left[hit]] = place[left[hit]]
        left = left[~hit]
        place[left] += 1
        left = left[place[left] < end[left]]
    return at


class Trained(NamedTuple):
    network: Network
    #: Words without a class of their own, in order, whose counts travel along, and millionths of log(count + 1) of each.
    carried: np.ndarray
    micro: np.ndarray
    #: (word, micro) of all others.
    counts: DataFrame


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", passes: int = PASSES) -> Trained:
    """Classes and shares from the counts of all words; weights from passes over all texts.

    Documents fall into groups by the hash of key and text, about GROUP words each, whatever the partitions. In each
    pass the groups go on from the same weights, and the next has the mean of theirs by words, summed in Spark.
    """
    counts = tx.checkpoint(count_words(docs, text))
    frequent = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    rest = counts.where(~F.col("word").isin(frequent)) if frequent else counts
    mass = np.ones(ENDINGS)
    for r in rest.groupBy("ending").agg(F.sum(F.col("n") + 1).alias("n")).collect():  # one row an ending
        mass[r["ending"]] += r["n"]
    model = Network(np.array(frequent, np.int64), mass)
    rank = F.floor(F.log2("n") * 8)
    room, cut = CARRIED, 0
    for r in rest.groupBy(rank.alias("rank")).agg(F.count("*").alias("words")).orderBy(F.desc("rank")).collect():  # eight rows an octave
        room -= r["words"]
        if room < 0:
            cut = r["rank"] + 1
            break
    micro = F.round(F.log(F.col("n") + 1) * MICRO).cast("long").alias("micro")
    held = np.array(sorted(rest.where(rank >= cut).select("word", micro).collect()), np.int64).reshape(-1, 2)  # CARRIED rows at most
    shares = rest.where(rank < cut).select("word", micro)
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tx.slices(batch.column(1), SLICE):
                word, ending, first = _words(data, offsets)
                held = model.classes(word, ending).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array([held[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())], ["turn", "classes"])

    turn = F.xxhash64(F.col(key), F.col(text), F.lit(41)).alias("turn")
    rows = docs.where(F.col(text).isNotNull()).select(turn, F.col(text).alias("text")).mapInArrow(tx.lean(classify), "turn long, classes binary")
    groups = tx.checkpoint(rows.repartition(-(-total // GROUP) or 1, "turn").sortWithinPartitions("turn", "classes"))
    for turn_ in range(passes if total else 0):
        model.put(_pass(groups, model, turn_))
    return Trained(model, held[:, 0].copy(), held[:, 1].copy(), shares)


def _pass(groups: DataFrame, model: Network, turn: int) -> np.ndarray:
    """The mean of the groups' weights after one pass each, by their words."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for batch in batches for x in batch.column(1).to_pylist()]
        classes = np.frombuffer(b"".join(held), np.uint8)
        if len(classes):
            first = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
            value = model.fit(model.contexts(classes, first), classes, 4 + turn).flat()
            parts = [value[low : low + BLOCK].tobytes() for low in range(0, len(value), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([len(classes)] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["block", "words", "value"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        words: dict[int, int] = {}
        for batch in batches:
            for block, n, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[block] = sums.get(block, 0.0) + np.frombuffer(value, np.float32).astype(np.float64) * n
                words[block] = words.get(block, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([(v / words[k]).tobytes() for k, v in sums.items()], pa.binary())], ["block", "value"])

    fitted = groups.mapInArrow(tx.lean(fit), "block long, words long, value binary").repartition("block")
    means = fitted.mapInArrow(tx.lean(add), "block long, value binary").collect()  # the weights once
    return np.concatenate([np.frombuffer(r["value"]) for r in sorted(means)])


def score(docs: DataFrame, model: Trained, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, log_prob (the sum over all words) and mean_log_prob of every whole text.

    A word without a class of its own has the share (its count + 1) of its class's mass, one that the corpus doesn't
    hold that of count 0; counts beyond the CARRIED most frequent words are joined in Spark. A null text or one without words has log_prob 0 and a null mean.
    Rows with equal texts score alike; an empty table gives an empty one; further columns are not read.
    """
    network, carried, micro, begins = model.network, model.carried, model.micro, _begins(model.carried)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for low, high, data, offsets in tx.slices(batch.column(1), SLICE):
                word, ending, first = _words(data, offsets)
                classes = network.classes(word, ending)
                value = np.rint(network.log_probs(classes, first) * MICRO).astype(np.int64)
                other = np.flatnonzero(classes >= FREQUENT)
                place = _find(word[other], carried, begins)
                known = place >= 0
                value[other[known]] += micro[place[known]]
                rare = other[~known]
                sums = np.concatenate([[0], np.cumsum(value)])
                n, total = np.diff(first), sums[first[1:]] - sums[first[:-1]]
                rows = task + done + np.arange(high - low)
                done += high - low
                # One row a text under a name that no word has but by chance, and then adds nothing to it (times is 0).
                names, none = tx.signed(tx.mix(rows.astype(np.uint64))), np.zeros(high - low, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(names), pa.array(none), batch.column(0)[low:high], pa.array(n), pa.array(total)], _PARTS)
                owner, said = tx.owners(first)[rare], word[rare]
                order = np.lexsort((said, owner))
                owner, said = owner[order], said[order]
                begin = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (said[1:] != said[:-1]))[: len(owner)])
                times = np.diff(np.append(begin, len(owner)))
                for a in range(0, len(begin), 100_000):
                    b = begin[a : a + 100_000]
                    nulls = pa.nulls(len(b), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(rows[owner[b]]), pa.array(said[b]), pa.array(times[a : a + 100_000]), nulls, nulls, nulls], _PARTS)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    parts = tx.arrow_map(rows, emit, ", ".join(f"{c} long" for c in _PARTS)).join(model.counts, "word", "left")
    whole = parts.groupBy("row").agg(F.max("key").alias("key"), F.max("n_words").alias("n_words"), (F.sum(F.coalesce("total", F.lit(0)) + F.coalesce(F.col("micro") * F.col("times"), F.lit(0))) / MICRO).alias("sum"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("sum") / F.col("n_words"), 4))
    return whole.select(F.col("key").alias(key), "n_words", F.round("sum", 2).alias("log_prob"), mean.alias("mean_log_prob"))


_PARTS = ["row", "word", "times", "key", "n_words", "total"]
