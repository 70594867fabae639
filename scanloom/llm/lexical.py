"""Ranked lexical search by sequential reads of impact-sorted lists (no random access), shard by shard.

What a term adds to a document's score is one integer, its impact. Each task builds, of the documents that it reads,
one list per term of the items, sorted by impact, and walks the lists of an item side by side: what has been read of a
document is the lower end of its score, and that plus the next impact of every list where it has not been seen is the
upper end. Reading goes on until no unseen document can enter, and the scores of all that could be among the best are
known to the last unit, ties included. The best of all shards are then ranked by Spark.

Postings never leave their task. Items travel in blocks of bounded size, each a broadcast of its own; a block costs
two passes over the texts (frequencies, then lists).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm import text as tx

#: Documents returned for each item.
TOP = 50
#: Terms of the items (16 bytes each) that are broadcast at once; more items than that are searched block by block.
BLOCK_TERMS = 1 << 19
#: Postings, and documents, that one shard holds in memory at most; a task with more walks several shards.
SHARD_POSTINGS, SHARD_DOCS = 1 << 21, 1 << 18
#: Entries of each list that are read in the first round; each round doubles it.
FIRST_READ = 64


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, lower-cased bytes, starts and ends of the terms, first term of each row)."""
    for low, high, data, offsets in tx.slices(column):
        data = tx.lower(data)
        yield low, high, data, *tx.words(data, offsets, tx.ALNUM)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each item, as two 64-bit names each."""
    for batch in batches:
        for low, high, data, starts, ends, first in _terms(batch.column(2)):
            names = np.stack([tx.signed(tx.Hashes(data, seed).of(starts, ends)) for seed in (11, 12)], 1)
            own = [np.unique(names[a:b], axis=0) for a, b in zip(first[:-1], first[1:], strict=True)]
            columns = [pa.array([x[:, k] for x in own], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], batch.column(1)[low:high], *columns], ["item", "item_id", "a", "b"])


class Block:
    """Items of one block: their vocabulary, sorted by name, and the places of each item's terms in it."""

    def __init__(self, rows: list):
        self.items, self.item_ids = [r["item"] for r in rows], [r["item_id"] for r in rows]
        names = np.array([x for r in rows for x in zip(r["a"], r["b"], strict=True)], np.int64).reshape(-1, 2)
        held, place = np.unique(names, axis=0, return_inverse=True)
        self.a, self.b = held[:, 0].copy(), held[:, 1].copy()
        self.terms = np.split(place.reshape(-1), np.cumsum([len(r["a"]) for r in rows])[:-1])
        self.weight, self.n_docs, self.n_terms = np.zeros(len(held), np.int64), 0, 0

    def count(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, terms of each row; row, term and occurrences of each posting)."""
        for low, high, data, starts, ends, first in _terms(column):
            names = tx.signed(tx.Hashes(data, 11).of(starts, ends))
            at = np.minimum(np.searchsorted(self.a, names), max(len(self.a) - 1, 0))
            hit = np.flatnonzero(self.a[at] == names) if len(self.a) else np.zeros(0, np.int64)
            at = at[hit]
            sure = tx.signed(tx.Hashes(data, 12).of(starts[hit], ends[hit])) == self.b[at]
            pair, tf = np.unique(tx.owners(first)[hit[sure]] * max(len(self.a), 1) + at[sure], return_counts=True)
            yield low, high, np.diff(first), pair // max(len(self.a), 1), pair % max(len(self.a), 1), tf


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What tf occurrences of a term add to the score of a document of n terms."""
    m = 50 + (50 * n.astype(np.int64) * n_docs) // n_terms
    return weight * ((1_000_000_000 * tf.astype(np.int64)) // (1000 * tf + 20 * m))


def no_random_access(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int, step: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, entries read): all documents whose score is among the k highest, ties of the last included.

    Lists are (documents, impacts above 0) by falling impact.
    """
    lower, read, entries = np.zeros(docs, np.int64), 0, 0
    while True:
        for held, impact in lists:
            lower[held[read : read + step]] += impact[read : read + step]
            entries += len(held[read : read + step])
        read, step = read + step, 2 * step
        bounds = [int(impact[read]) if read < len(impact) else 0 for _, impact in lists]
        rest = sum(bounds)  # no document that no list has shown yet can score more
        touched = np.flatnonzero(lower)
        score = lower[touched]
        least = int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 1
        if rest >= least:
            continue
        upper = np.full(docs, rest, np.int64)
        for (held, _), bound in zip(lists, bounds, strict=True):
            if bound:
                upper[held[:read]] -= bound
        open_ = touched[score + upper[touched] >= least]
        if not upper[open_].any():  # membership, ties and scores are settled
            return open_, lower[open_], entries


def _frequencies(held):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = held.value
        df, docs, terms = np.zeros(len(block.a), np.int64), 0, 0
        for batch in batches:
            for _, _, n, _, term, _ in block.count(batch.column(1)):
                df += np.bincount(term, minlength=len(df))
                docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at])), pa.array(np.concatenate([[docs, terms], df[at]]).astype(np.int64))], ["term", "n"])

    return emit


def _best(held, k: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = held.value
        ids, lengths, posted, docs, size = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            key = pa.chunked_array(ids).combine_chunks() if ids else pa.array([], pa.int64())
            order_id = np.where(key.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).max, key.fill_null(0).to_numpy())
            doc, term, tf = (np.concatenate([p[j] for p in posted]) for j in range(3))
            impact = impacts(block.weight[term], tf, np.concatenate(lengths)[doc], block.n_docs, block.n_terms)
            order = np.lexsort((-impact, term))
            order = order[impact[order] > 0]
            doc, term, impact = doc[order], term[order], impact[order]
            edges = np.searchsorted(term, np.arange(len(block.a) + 1))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for at, own in enumerate(block.terms):
                lists = [(doc[edges[t] : edges[t + 1]], impact[edges[t] : edges[t + 1]]) for t in own.tolist() if edges[t] < edges[t + 1]]
                if lists:
                    found, score, _ = no_random_access(lists, docs, k)
                    top = np.lexsort((order_id[found], -score))[:k]
                    out.append((np.full(len(top), at), found[top], score[top]))
            item, found, score = (np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3))
            columns = [pa.array([block.items[i] for i in item.tolist()], pa.int64()), pa.array([block.item_ids[i] for i in item.tolist()], pa.int64()), key.take(pa.array(found)), pa.array(score)]
            return pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

        for batch in batches:
            for low, high, n, row, term, tf in block.count(batch.column(1)):
                ids.append(batch.column(0)[low:high])
                lengths.append(n)
                posted.append((row + docs, term, tf))
                docs, size = docs + high - low, size + len(row)
                if size > SHARD_POSTINGS or docs > SHARD_DOCS:
                    yield close()
                    ids, lengths, posted, docs, size = [], [], [], 0, 0
        if docs:
            yield close()

    return emit


def search(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_key, rank, key and score of the k documents with the highest scores above 0 for each item, equal scores by key.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; a null or empty text has none. Every
    row of docs is a document: repeated rows count, and are returned, each; a null key ranks after all others of its
    score. Equal rows of items are one item, rows with equal keys and different texts are items of their own. Items
    without terms that documents hold give no row, nor do empty tables. Further columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).distinct()
    asked = asked.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    asked = tx.stored(asked.mapInArrow(tx.lean(_item_terms), "item long, item_id long, a array<long>, b array<long>"))
    total = asked.agg(F.sum(F.size("a"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    parts = []
    for at in range(blocks):
        own = asked.where((F.size("a") > 0) & (F.pmod("item", F.lit(blocks)) == at)).collect()  # about block_terms terms
        if not own:
            continue
        block = Block(own)
        held = spark.sparkContext.broadcast(block)
        counts = rows.mapInArrow(tx.lean(_frequencies(held)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        held.destroy()
        counts = {r["term"]: r["n"] for r in counts}
        block.n_docs, block.n_terms = counts.get(-2, 0), counts.get(-1, 0)
        block.weight = weights(np.array([counts.get(t, 0) for t in range(len(block.a))]), block.n_docs)
        held = spark.sparkContext.broadcast(block)
        parts.append(tx.stored(rows.mapInArrow(tx.lean(_best(held, k)), "item long, item_id long, doc_id long, score long")))
        held.destroy()
    best = parts[0] if parts else spark.createDataFrame([], "item long, item_id long, doc_id long, score long")
    for part in parts[1:]:
        best = best.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item_id").alias(item_key), "rank", F.col("doc_id").alias(key), "score")
