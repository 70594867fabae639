"""Language of each word by a linear-chain conditional random field, and of each text from its words.

Affixes, byte n-grams and a lexicon score every word; learned transitions couple neighbours, so that a
stretch in another language is labelled as such (code-switched text). Training maximises the likelihood
of labelled word sequences; prediction uses the forward-backward marginals of all words of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm import text as tx

#: Rows of the weight table that hashed features share.
TABLE = 1 << 15
#: Labelled documents that training takes, in equal numbers by language, and the bytes it takes of each.
TRAIN_DOCS, TRAIN_BYTES = 1600, 3000
#: Documents of each language that it takes however many languages there are, if there are so many.
LEAST_DOCS = 40
#: Words of a training sequence, sequences of a step, steps.
SEQUENCE, BATCH, STEPS = 48, 64, 240
#: Bytes of text whose features are held at once.
SLICE = 1 << 19
#: Words whose n-grams are placed at once.
WORDS = 1 << 15
#: Words that the lexicon holds for each language, at most.
LEXICON = 400


def held_out(key: Column) -> Column:
    """Documents that no fit may see: a fifth of them, by the checksum of the key."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: np.ndarray) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """Table rows of the features that each word has once, and for each n those of its n-grams with the bounds of each word."""
    h = tx.Hashes(data, 7)
    word = h.of(starts, ends)
    at = np.minimum(np.searchsorted(lexicon, word), max(len(lexicon) - 1, 0))
    known = lexicon[at] == word if len(lexicon) else np.zeros(len(word), bool)
    single = [np.where(known, word % np.uint64(TABLE - 1), np.uint64(TABLE - 1)).astype(np.int32)]
    for n in (2, 3, 4):
        for salt, (a, b) in ((n, (starts, np.minimum(starts + n, ends))), (n + 8, (np.maximum(starts, ends - n), ends))):
            single.append(((h.of(a, b) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & tx._MASK)) % np.uint64(TABLE - 1)).astype(np.int32))
    grams = []
    for n in (2, 3):
        count = np.maximum(ends - starts - n + 1, 0)
        bound = np.concatenate([[0], np.cumsum(count)])
        rows = np.empty(bound[-1], np.int32)
        for low in range(0, len(count), WORDS):  # places take far more room than rows
            own, some = slice(low, low + WORDS), count[low : low + WORDS]
            a, b = bound[low], bound[low + len(some)]
            place = np.arange(a, b) + np.repeat((starts - bound[:-1])[own], some)
            rows[a:b] = (h.of(place, place + n) ^ np.uint64(n * 0xC2B2AE3D27D4EB4F & tx._MASK)) % np.uint64(TABLE - 1)
        grams.append((rows, bound))
    return single, grams


def emissions(weights: np.ndarray, single: list[np.ndarray], grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """words x labels: the sum of the weights of each word's features; n-grams count by their mean."""
    out = weights[single[0]].copy()
    for rows in single[1:]:
        out += weights[rows]
    for rows, bound in grams:
        sums = np.zeros((len(rows) + 1, weights.shape[1]), np.float64)
        np.cumsum(weights[rows], axis=0, out=sums[1:])
        count = np.maximum(np.diff(bound), 1)[:, None]
        out += ((sums[bound[1:]] - sums[bound[:-1]]) / count).astype(np.float32)
    return out


def marginals(scores: np.ndarray, fresh: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Forward-backward over the concatenated sequences of a batch; fresh is true at each first word.

    A first word forgets what came before it, so that all words form one chain. The chain is cut into
    blocks: the matrix product of each block carries the messages across, and within blocks all of them
    advance together.
    """
    n, k = scores.shape
    if not n:
        return np.zeros((0, k))
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    pad = blocks * width - n
    emit = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
    emit = np.concatenate([emit, np.ones((pad, k))]).reshape(blocks, width, k)
    first = np.concatenate([fresh, np.ones(pad, bool)]).reshape(blocks, width)
    step, begin = np.exp(move), np.exp(start)

    def scaled(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
        return x / x.sum(axis=axes, keepdims=True)

    def enter(message: np.ndarray, at: int) -> np.ndarray:
        """Messages (blocks x ... x labels) over the transition into the words at this place."""
        moved = message @ step
        new = message.sum(-1, keepdims=True) * begin
        f = first[:, at].reshape(-1, *[1] * (message.ndim - 1))
        return np.where(f, new, moved)

    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for at in range(width):
        product = scaled(enter(product, at) * emit[:, at, None, :], (1, 2))
    into, out_of = np.empty((blocks, k)), np.empty((blocks, k))
    message = np.full(k, 1 / k)
    for b in range(blocks):
        into[b] = message
        message = message @ product[b]
        message /= message.sum()
    message = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        out_of[b] = message
        message = product[b] @ message
        message /= message.sum()
    ahead = np.empty((blocks, width, k))
    for at in range(width):
        into = scaled(enter(into, at) * emit[:, at], (1,))
        ahead[:, at] = into
    for at in range(width - 1, -1, -1):
        ahead[:, at] *= out_of
        back = emit[:, at] * out_of
        fresh_back = (back * begin).sum(-1, keepdims=True) * np.ones(k)
        out_of = scaled(np.where(first[:, at, None], fresh_back, back @ step.T), (1,))
    out = ahead.reshape(-1, k)[:n]
    return out / out.sum(1, keepdims=True)


class Model:
    """Labels, hashed weights, transitions and lexicon; a few hundred kilobytes."""

    def __init__(self, labels: list[str], seed: int = 1):
        k = len(labels)
        self.labels, self.lexicon = labels, np.zeros(0, np.uint64)
        self.weights = np.zeros((TABLE, k), np.float32)
        self.start, self.move = np.zeros(k), np.zeros((k, k))
        self.seed = seed

    def fit(self, texts: list[str], labels: list[str], steps: int = STEPS, rate: float = 0.3) -> Model:
        """Adagrad on the likelihood of sequences that join stretches of different texts, hence of different languages."""
        number = {x: i for i, x in enumerate(self.labels)}
        rng = np.random.default_rng(self.seed)
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        data = tx.lower(np.frombuffer(b"".join(raw), np.uint8))
        starts, ends, first = tx.words(data, offsets, tx.LETTER)
        if not len(starts) or len(self.labels) < 2:
            return self
        owner = tx.owners(first)
        truth = np.array([number[x] for x in labels])[owner]
        words = tx.Hashes(data, 7).of(starts, ends)
        kept = []
        for k in range(len(self.labels)):
            seen, count = np.unique(words[truth == k], return_counts=True)
            kept.append(seen[np.lexsort((seen, -count))][:LEXICON])
        self.lexicon = np.unique(np.concatenate(kept))
        single, grams = features(data, starts, ends, self.lexicon)
        usable = np.flatnonzero(np.diff(first) > 0)
        k, seen = len(self.labels), np.full(self.weights.shape, 1e-6)
        seen_start, seen_move = np.full(k, 1e-6), np.full((k, k), 1e-6)
        by_label = [usable[np.array([number[labels[d]] for d in usable]) == c] for c in range(k)]
        by_label = [x for x in by_label if len(x)]
        for _ in range(steps):
            picked = []
            for _ in range(BATCH):
                row: list[np.ndarray] = []
                while sum(map(len, row)) < SEQUENCE:  # another text each time, languages equally often
                    group = by_label[rng.integers(len(by_label))]
                    doc = group[rng.integers(len(group))]
                    a, b = first[doc], first[doc + 1]
                    at = a + rng.integers(b - a)
                    row.append(np.arange(at, min(b, at + rng.integers(6, SEQUENCE))))
                picked.append(np.concatenate(row)[:SEQUENCE])
            at = np.concatenate(picked)
            own = [x[at] for x in single]
            parts = []
            for rows, bound in grams:
                count = bound[at + 1] - bound[at]
                new = np.concatenate([[0], np.cumsum(count)])
                parts.append((rows[np.arange(new[-1]) + np.repeat(bound[at] - new[:-1], count)], new))
            score = emissions(self.weights, own, parts)
            fresh = np.arange(len(at)) % SEQUENCE == 0
            given = marginals(score, fresh, self.start, self.move)
            off = -given
            off[np.arange(len(at)), truth[at]] += 1
            slope = np.zeros(self.weights.shape)
            for rows in own:
                np.add.at(slope, rows, off)
            for rows, bound in parts:
                count = np.diff(bound)
                np.add.at(slope, rows, np.repeat(off / np.maximum(count, 1)[:, None], count, axis=0))
            pair = self._pairs(score, given, fresh)
            for value, gradient, total in ((self.weights, slope, seen), (self.start, off[fresh].sum(0), seen_start), (self.move, self._observed(truth[at], fresh) - pair, seen_move)):
                gradient = gradient / BATCH
                total += gradient**2
                value += rate * gradient / np.sqrt(total)
        return self

    def _observed(self, truth: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        out = np.zeros(self.move.shape)
        inner = np.flatnonzero(~fresh)
        np.add.at(out, (truth[inner - 1], truth[inner]), 1)
        return out

    def _pairs(self, score: np.ndarray, given: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Expected transitions, from the pairwise marginals of neighbours."""
        out = np.zeros(self.move.shape)
        step = np.exp(self.move)
        emit = np.exp(score - score.max(1, keepdims=True)).astype(np.float64).reshape(-1, SEQUENCE, len(self.labels))
        ahead = emit[:, 0] * np.exp(self.start)
        ahead /= ahead.sum(1, keepdims=True)
        given = given.reshape(emit.shape)
        for t in range(1, SEQUENCE):
            reach = ahead @ step
            # p(a, b | all) = forward(a) step(a, b) marginal(b) / sum over a of forward(a) step(a, b)
            out += np.einsum("na,ab,nb->ab", ahead, step, given[:, t] / reach)
            ahead = reach * emit[:, t]
            ahead /= ahead.sum(1, keepdims=True)
        return out

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words of a slice, and the index of each row's first word."""
        data = tx.lower(data)
        starts, ends, first = tx.words(data, offsets, tx.LETTER)
        fresh = np.zeros(len(starts), bool)
        fresh[first[:-1][np.diff(first) > 0]] = True
        return marginals(emissions(self.weights, *features(data, starts, ends, self.lexicon)), fresh, self.start, self.move), first


def sample(docs: DataFrame, key: str, text: str, lang: str, n: int = TRAIN_DOCS, size: int = TRAIN_BYTES) -> list[tuple[str, str]]:
    """(text, language) of documents that may be learned from, for each language its part of n, in the order of the texts' hashes.

    Each language gives n over the number of languages (LEAST_DOCS at least), or all its different texts if it has fewer;
    of each a stretch of size characters from a place that the hash gives. Copies of a text count once: the share of a
    language's hashes that is taken follows its number of different texts, and copies are merged before they are shuffled.
    """
    usable = docs.where(~held_out(F.col(key)) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    usable = usable.select(F.col(lang).alias("lang"), F.xxhash64(F.col(text), F.lit(11)).alias("turn"), F.col(text).alias("text"))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("turn").alias("n")).collect()  # one row a language
    if not counts:
        return []
    each = max(-(-n // len(counts)), LEAST_DOCS)
    cuts = [(r["lang"], int(min(1.0, 1.5 * each / max(r["n"], 1)) * (1 << 30)) + 1) for r in counts]
    cut = F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, cut long"))
    room = F.greatest(F.length("text") - size, F.lit(0)) + 1
    piece = F.substr(F.col("text"), F.pmod(F.xxhash64("turn", F.lit(12)), room).cast("int") + 1, F.lit(size))
    near = usable.join(cut, "lang").where(F.pmod("turn", F.lit(1 << 30)) < F.col("cut")).select("lang", "turn", piece.alias("piece"))
    out, taken = [], dict.fromkeys((r["lang"] for r in counts), 0)
    for r in sorted(near.groupBy("lang", "turn").agg(F.min("piece").alias("piece")).collect(), key=lambda r: (r["turn"], r["lang"])):
        if taken[r["lang"]] < each:
            taken[r["lang"]] += 1
            out.append((r["piece"], r["lang"]))
    return out


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_at_most: int = TRAIN_DOCS, steps: int = STEPS) -> Model:
    """A model of all languages that label documents which may be learned from."""
    rows = sample(docs, key, text, lang, docs_at_most)
    out = Model(sorted({x for _, x in rows})).fit([t for t, _ in rows], [x for _, x in rows], steps)
    tx.trim()
    return out


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """key, lang_pred, score and mix (each language's share of the words) of every whole text.

    lang_pred has the largest sum of word marginals (ties: the first label); score is its mean marginal. A
    null text or one without a letter is `und` with score 0, as is every text if no language was learned.
    Rows with equal texts get equal values; an empty table gives an empty one; further columns are not read,
    but with carry the whole input row comes along as a struct, row.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tx.slices(tx.text_of(batch, 1, place), SLICE):
                n, k = high - low, len(model.labels)
                score, said, shares = np.zeros(n), np.full(n, "und", object), [[]] * n
                if k:
                    given, first = model.words(data, offsets)
                    sums = np.zeros((len(given) + 1, k))
                    np.cumsum(given, axis=0, out=sums[1:])
                    total = sums[first[1:]] - sums[first[:-1]]
                    count = np.diff(first)
                    plain = np.concatenate([[0], np.cumsum(tx.lower(data) - 0x61 < 26)])
                    sure = plain[offsets[1:]] > plain[offsets[:-1]]
                    for row in range(n):
                        if count[row] and (sure[row] or any(c.isalpha() for c in data[offsets[row] : offsets[row + 1]].tobytes().decode())):
                            best = int(total[row].argmax())
                            said[row], score[row] = model.labels[best], round(min(1.0, total[row, best] / count[row]), 6)
                            shares[row] = np.round(total[row] / count[row], 4).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(said, pa.string()), pa.array(score), pa.array(shares, pa.list_(pa.float64())), *(c[low:high] for c in batch.columns[1:] if carry)], ["key", "lang_pred", "score", "mix", *["row"] * carry])

    place = docs.columns.index(text) if carry else None
    rows = docs.select(F.col(key).cast("long").alias("key"), *tx.carried(docs, carry, text))
    return tx.arrow_map(rows, label, tx.with_row("key long, lang_pred string, score double, mix array<double>", docs, carry)).withColumnRenamed("key", key)
