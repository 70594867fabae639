"""Ranked lexical search against a plain count over all documents."""

import math
import random
import re

import numpy as np
import pytest

from scanloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(UPPER))


def _ranked(docs, items, k):
    held = [(d, _terms(t)) for d, t in docs]
    n_docs, total = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    out = []
    for item, text in set(items):
        scores = []
        for d, words in held:
            score = 0
            for t in set(_terms(text)):
                tf, df = words.count(t), sum(t in set(w) for _, w in held)
                if tf:
                    m = 50 + (50 * len(words) * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcÉé1") for _ in range(r.randint(1, 3))) for _ in range(90)]
    text = lambda n: " ".join(min(r.choice(vocabulary), r.choice(vocabulary)) for _ in range(n))
    docs = [(k, text(r.randint(0, 40))) for k in range(150)]
    docs += docs[:30] + [(k + 500, t) for k, t in docs[40:80]] + [(900, None), (901, ""), (902, "?? --"), (None, docs[3][1]), (903, "abc " * 3000), (7, "another text Abc"), (904, "ÀB _x_ {y}")]
    items = [(k, text(r.randint(1, 12))) for k in range(12)] + [(3, "abc ab a"), (3, "abc ab a"), (50, None), (51, "..."), (52, "nowhere"), (None, docs[5][1]), (53, "y x Àb AB")]
    return docs, items


@pytest.mark.parametrize("k,block,shard", [(5, 1 << 19, 1 << 21), (50, 7, 40), (1, 1 << 19, 200)])
def test_ranks_equal_a_plain_count(spark, rows, monkeypatch, k, block, shard):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", shard)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows[0]], "doc_id long, text string, rank int, item_id int").repartition(3)
    items = spark.createDataFrame([(i, t, 0) for i, t in rows[1]], "item_id long, text string, doc_id int")
    got = [tuple(x) for x in lexical.search(docs, items, k, block_terms=block).collect()]
    assert sorted(got, key=str) == _ranked(*rows, k)


def test_empty_tables(spark, rows):
    docs, items = (spark.createDataFrame(x, f"{k} long, text string") for x, k in zip(rows, ("doc_id", "item_id"), strict=True))
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.where("doc_id > 899 and doc_id < 903"), items).count() == 0


@pytest.mark.parametrize("step", [1, 64])
def test_reads_stop_when_scores_are_settled(step):
    r = np.random.default_rng(0)
    for k in (1, 3, 20):
        lists, full = [], np.zeros(4000, np.int64)
        for size in (5, 300, 4000, 4000):
            held = r.choice(4000, size, False)
            impact = -np.sort(-r.integers(1, 30, size) ** (3 if size < 4000 else 1))
            full[held] += impact
            lists.append((held, impact))
        got, score, read = lexical.no_random_access(lists, 4000, k, step)
        least = np.sort(full)[-k]
        assert sorted(got.tolist()) == np.flatnonzero(full >= least).tolist() and (full[got] == score).all()
    one = [(np.arange(4000), np.arange(4000, 0, -1))]
    assert lexical.no_random_access(one, 4000, 3, step)[2] < 70
