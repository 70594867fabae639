"""Periodic runs against a walk over all periods and places."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from scanloom.llm import queries, runs


def _walk(words, least=24, exponent=3):
    """All runs by trying every period; of equal stretches the smallest period."""
    n, out = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            a = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - a >= max(least, exponent * p):
                out.setdefault((a, i + p), p)
    return sorted((a, b - a, p) for (a, b), p in out.items())


def _digest(words, found):
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    milli = 1000 * top[1] // top[2] if found else None
    listed = "".join(f"{a},{n},{p}\n" for a, n, p in found)
    return (len(found), *top, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def _texts():
    r = random.Random(4)
    word = lambda k: [r.choice("abcdefgh") for _ in range(k)]
    thue = [0]
    while len(thue) < 700:
        thue += [1 - x for x in thue]
    out = [["a"] * n for n in (1, 23, 24, 25, 300)] + [[], ["x"] * 11 + ["y"] + ["x"] * 40, [str(x) for x in thue], ["ab"[x] for x in thue[:200]] * 4]
    for _ in range(150):
        words = []
        for _ in range(r.randint(1, 5)):
            root = word(r.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 60]))
            if r.random() < 0.3:
                root = root * 3 + word(r.randint(0, 4))  # runs within runs
            words += (root * r.randint(2, 12))[: r.randint(1, 400)] + word(r.randint(0, 6))
        out.append(words)
    out += [[r.choice("ab") for _ in range(600)] for _ in range(20)]
    fib = [["a"], ["a", "b"]]
    while len(fib[-1]) < 800:
        fib.append(fib[-1] + fib[-2])
    return [*out, fib[-1]]


def test_runs_equal_a_walk(spark):
    texts = _texts()
    rows = [(k, " \n".join(t), "other", 1) for k, t in enumerate(texts)]
    rows += [(900, None, None, 2), (901, "", "", 3), (902, " \t ", "", 4), (None, "z " * 30, "", 5), (1, "z " * 30, "", 6), (1, "z " * 30, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int").repartition(3)
    got = runs.find_runs(docs).collect()
    assert len(got) == len(rows)
    want = {}
    for k, t, *_ in rows:
        found = _walk((t or "").split())
        want.setdefault(k, []).append((*_digest((t or "").split(), found), [tuple(x) for x in found]))
    have = {}
    for g in got:
        have.setdefault(g["doc_id"], []).append((*(g[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")), [tuple(x) for x in g["runs"]]))
    assert {k: sorted(v, key=str) for k, v in have.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert runs.find_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("least,exponent", [(1, 3), (5, 4), (40, 3)])
def test_other_limits(least, exponent):
    for words in _texts()[5:60]:
        numbers = np.concatenate([[-1], np.unique(words or ["a"], return_inverse=True)[1][: len(words)], [-2]]).astype(np.int64)
        got = runs.Catchers(numbers, least, exponent).runs(len(words))
        assert [(s - 1, e - s, p) for s, e, p in got.tolist()] == _walk(words, least, exponent)


def test_long_text_of_one_word():
    n = 300_000
    numbers = np.concatenate([[-1], np.zeros(n, np.int64), np.tile(np.arange(1000) + 5, 100), [-2]])
    assert runs.Catchers(numbers).runs(n).tolist() == [[1, n + 1, 1], [n + 1, n + 100_001, 1000]]


def test_query_plants_repeats_before_it_looks(spark, tmp_path):
    r = random.Random(9)
    rows = [(k, " ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 200)))) for k in range(120)] + [(500, None), (None, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    planted = 0
    got = {g["doc_id"]: tuple(g)[1:] for g in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    for k, t in rows:
        words = (t or "").split()
        h, n = zlib.crc32(str(k).encode()), len(words)
        if k is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            planted += 1
        assert got[k] == _digest(words, _walk(words)), k
    assert planted > 5
