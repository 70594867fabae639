"""Rows with one key and different texts: each text is judged on its own."""

import hashlib
import random

import corpus_pipeline
import pytest

from scanloom.llm import neardup, substrings


def _words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


P, CLEAN, OTHER = _words(1, 60), _words(2, 200), _words(3, 120)
ROWS = [(1, P), (5, P), (5, ["five", "clean", "words", "are", "here"]), (5, CLEAN), (5, [*P[:55], "x", *OTHER]), (2, OTHER), (5, P), (None, P), (7, [*CLEAN[:70], *P]), (5, None), (5, [])]


def _frame(spark, rows):
    return spark.createDataFrame([(k, None if w is None else " ".join(w), "s", 3) for k, w in rows], "doc_id long, text string, t string, id int").repartition(3)


@pytest.mark.parametrize("bucket", [8 << 20, 0])
def test_repeats_of_rows_with_one_key(spark, bucket):
    seen = {}
    for k, w in ROWS:
        for i in range(len(w or ()) - 49):
            if k is not None:
                seen[tuple(w[i : i + 50])] = min(k, seen.get(tuple(w[i : i + 50]), k))
    want = []
    for k, w in ROWS:
        w = w or []
        gone = {j for i in range(len(w) - 49) if k is not None and seen[tuple(w[i : i + 50])] < k for j in range(i, i + 50)}
        want.append((k, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    got = [(g["doc_id"], g["n_words"], g["n_removed"], g["kept_sha256"]) for g in substrings.drop_repeats(_frame(spark, ROWS), bucket_bytes=bucket).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def _near(rows, n, percent=80):
    """n_shingles and component of each row by all pairs."""
    sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()) for w in ((w or []) for _, w in rows)]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if sets[a] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    least = {c: min(rows[a][0] for a in range(len(rows)) if root[a] == c and rows[a][0] is not None) for c in set(root) if any(rows[a][0] is not None for a in range(len(rows)) if root[a] == c)}
    return [(k, len(s), least[c] if s and k is not None else k) for (k, _), s, c in zip(rows, sets, root, strict=True)]


def test_links_of_rows_with_one_key(spark):
    a, b, c = _words(4, 80), _words(5, 80), _words(6, 90)
    rows = [(5, a), (5, b), (9, [*b, "more"]), (3, [*a, "more"]), (5, [*a, "else"]), (9, c), (9, [*c, "tail"]), (9, None), (4, ["short"]), (9, ["short"]), (9, a[:3]), (5, a)]
    got = [(g["doc_id"], g["n_shingles"], g["component_id"]) for g in neardup.near_duplicates(_frame(spark, rows), words=4).collect()]
    assert sorted(got, key=str) == sorted(_near(rows, 4), key=str)


def test_stages_keep_unlike_texts_of_one_key(spark, sf):
    a, b, c = _words(7, 80), _words(8, 80), _words(9, 90)
    rows = [(1, a), (5, [*a, "x"]), (5, b), (6, [*b, "y"]), (8, c), (8, [*c, "z"]), (5, None), (None, c[:50])]
    docs = _frame(spark, rows)
    kept = sorted(((g["doc_id"], g["text"]) for g in corpus_pipeline.near_copies(spark, docs, sf).collect()), key=str)
    eight = [x for x in kept if x[0] == 8]
    assert len(eight) == 1 and [x for x in kept if x[0] != 8] == sorted([(1, " ".join(a)), (5, " ".join(b)), (5, None), (None, " ".join(c[:50]))], key=str)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    both = _frame(spark, [(1, ["before", item, "after"]), (1, b), (2, a), (2, None)])
    left = sorted(((g["doc_id"], g["text"]) for g in corpus_pipeline.benchmark_passages(spark, both, sf).collect()), key=str)
    assert left == sorted([(1, " ".join(b)), (2, " ".join(a)), (2, None)], key=str)
