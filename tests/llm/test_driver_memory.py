"""What training and the rounds of near copies ask of the driver."""

import tracemalloc

import numpy as np

from scanloom.llm import langid, neardup
from scanloom.llm import text as tx


def test_features_of_many_words_need_little_room():
    """Rows of n-grams are found for some words at a time: the training texts (some 5 MB) go through here whole, in the driver."""
    data = np.frombuffer(b"wandering " * 300_000, np.uint8)
    starts, ends, _ = tx.words(data, np.array([0, len(data)]), tx.LETTER)
    tracemalloc.start()
    single, grams = langid.features(data, starts, ends, np.zeros(0, np.uint64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    kept = sum(x.nbytes for x in single) + sum(x.nbytes + y.nbytes for x, y in grams)
    assert most < kept + len(data) * 40  # hashes of all characters among it
    few, parts = langid.features(data[:1000], starts[:100], ends[:100], np.zeros(0, np.uint64))
    assert all((x[:100] == y).all() for x, y in zip(single, few, strict=True))
    assert all((rows[: len(own)] == own).all() and (bound[:101] == at).all() for (rows, bound), (own, at) in zip(grams, parts, strict=True))


def test_components_end_with_the_round_that_leaves_stars(spark, monkeypatch):
    """Stars need one round, not another that finds nothing changed; other graphs still get their components."""
    written = []
    own = tx.checkpoint
    monkeypatch.setattr(tx, "checkpoint", lambda df, *a: written.append(1) or own(df, *a))
    stars = spark.createDataFrame([(5, 1), (1, 7), (9, 2), (2, 11), (2, 12)], "a long, b long")
    assert {tuple(r) for r in neardup.components(stars).collect()} == {(1, 1), (5, 1), (7, 1), (2, 2), (9, 2), (11, 2), (12, 2)}
    assert len(written) == 2
    pairs = [(int(a), int(b)) for a, b in np.random.default_rng(3).integers(0, 400, (330, 2))] + [(k, k + 1) for k in range(500, 560)]
    root = {k: k for p in pairs for k in p}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    linked = {k for a, b in pairs if a != b for k in (a, b)}
    assert {tuple(r) for r in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == {(k, root[k]) for k in linked}
    assert neardup.components(stars.limit(0)).count() == 0
