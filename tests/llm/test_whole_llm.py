"""What training and scoring must take from every row, and texts that earlier cuts of the job lost."""

import numpy as np
import pytest

from scanloom.llm import langid, lm, media, packing


@pytest.mark.parametrize("carried", [0, 40, 1 << 17])
def test_language_model_scores_are_sums_over_all_words(spark, monkeypatch, carried):
    monkeypatch.setattr(lm, "GROUP", 2000)
    monkeypatch.setattr(lm, "CARRIED", carried)
    r = np.random.default_rng(0)
    texts = [" ".join(f"v{int(k)}e{int(k) % 7}" for k in np.minimum(r.zipf(1.3, 90), 3000)) for _ in range(700)]
    texts += [None, "", "never seen", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm.train(docs.repartition(5), passes=1)
    again = lm.train(docs.repartition(2), passes=1)
    assert np.allclose(model.network.flat(), again.network.flat(), atol=1e-4)
    raw = [(t or "").encode() for t in texts]
    word, ending, first = lm._words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    net = model.network
    classes = net.classes(word, ending)
    seen_n = {int(w): int(c) for w, c in zip(*np.unique(word, return_counts=True))}
    probs = net.log_probs(classes, first)
    want = [sum(probs[i] + (np.log(seen_n[int(word[i])] + 1) if classes[i] >= lm.FREQUENT else 0) for i in range(a, b)) for a, b in zip(first[:-1], first[1:])]
    rows = {r["doc_id"]: r for r in lm.score(docs.repartition(4), model).collect()}
    assert len(rows) == len(texts)
    for k, total in enumerate(want):
        assert rows[k]["log_prob"] == pytest.approx(total, abs=0.02) and rows[k]["n_words"] == first[k + 1] - first[k]
    assert rows[0]["log_prob"] == rows[703]["log_prob"] and rows[700]["mean_log_prob"] is None


def test_language_model_probabilities():
    r = np.random.default_rng(1)
    net = lm.Network(np.arange(lm.FREQUENT), np.full(lm.ENDINGS, 50.0))
    classes = r.integers(0, lm.EDGE, 3000)
    first = np.array([0, 1, 900, 900, 3000])
    before = net.log_probs(classes, first).mean()
    net.fit(net.contexts(classes, first), classes)
    assert net.log_probs(classes, first).mean() > before
    context, at = net.contexts(classes, first), 1500
    assert context[0].tolist() == [lm.EDGE] * 4 and context[1].tolist() == [lm.EDGE, lm.EDGE, classes[2], classes[3]]
    logs = []
    for c in range(lm.EDGE):  # every class in the place of one word: the probabilities of all add up to one
        held = classes.copy()
        held[at] = c
        logs.append(net.log_probs(held[at - 2 : at + 3], np.array([0, 5]))[2] - net.log_mass[c])
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
    h = np.tanh(net.hidden + sum(net.embed[k][context[at, k]] for k in range(4)))
    z, g = h @ net.branch + net.branch_bias, classes[at] // lm.LEAVES
    y = h @ net.leaf[g] + net.leaf_bias[g]
    want = z[g] - np.log(np.exp(z).sum()) + y[classes[at] % lm.LEAVES] - np.log(np.exp(y).sum())
    assert logs[classes[at]] == pytest.approx(want, abs=1e-3)


def test_pieces_go_to_the_shortest_pack():
    assert sorted(packing.shortest_pack_first({7: 1, 5: 1, 2: 1}, 10), key=str) == [(1, {5: 1, 2: 1}), (1, {7: 1})]
    r = np.random.default_rng(3)
    histogram = {int(k): int(n) for k, n in zip(r.choice(np.arange(1, 65), 40, False), r.integers(1, 60, 40), strict=True)}
    packs: list[int] = []  # room of each, one piece at a time
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            at = max(range(len(packs)), key=packs.__getitem__, default=None)
            if at is None or packs[at] < size:
                packs.append(64 - size)
            else:
                packs[at] -= size
    got = packing.shortest_pack_first(histogram, 64)
    assert sorted(64 - sum(k * n for k, n in p.items()) for count, p in got for _ in range(count)) == sorted(packs)
    assert all(sum(count * p.get(k, 0) for count, p in got) == n for k, n in histogram.items())


def test_added_tokens_in_texts_keep_their_ids():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["plain text", "a<|endoftext|>b", "", "<|startoftext|>", "é <|endoftext|><|startoftext|> É's", "<|ENDOFTEXT|> <|endoftext |>", "b <|endoftext|"]
    for _ in range(2):
        for mine, text in zip(packing.WordIds.open(packing.default_tokenizer()).encode(texts), texts, strict=True):
            assert mine.tolist() == own.encode(text, add_special_tokens=False).ids
    assert 49407 in own.encode(texts[1], add_special_tokens=False).ids


def test_every_language_is_learned(spark):
    # 60,000 rows without a label, 20,000 of one language, 3,000 copies of one text in another and 12 more, 8 rows of a third
    docs = spark.range(83_020).selectExpr(
        "id AS doc_id", "CASE WHEN id < 60000 THEN NULL WHEN id < 80000 THEN 'aa' WHEN id < 83012 THEN 'bb' ELSE 'cc' END AS lang",
        "CASE WHEN id BETWEEN 80000 AND 82999 THEN 'one copy' ELSE concat('text of ', id) END AS text")
    found = langid.sample(docs, "doc_id", "text", "lang")
    learnable = docs.where(~langid.held_out(docs["doc_id"])).where("lang in ('bb', 'cc')").select("lang", "text").distinct().collect()
    assert sorted((t, x) for t, x in found if x != "aa") == sorted((r["text"], r["lang"]) for r in learnable)
    assert sum(x == "aa" for _, x in found) == -(-langid.TRAIN_DOCS // 3) and len(set(found)) == len(found)
    assert langid.train(docs, steps=1).labels == ["aa", "bb", "cc"]


@pytest.mark.parametrize("size", [64, 512, 704, 768, 832])
def test_features_take_every_sample(size):
    plain = bytes(65 + k % 20 for k in range(size))
    tail = plain[: size - 24] + bytes(90 - k % 7 for k in range(24))
    assert not np.array_equal(media.features(plain)[0], media.features(tail)[0])
    mel, _ = media.log_mel(np.ones(size, np.float32))
    assert (len(mel) - 1) * media.HOP + media.FRAME >= size > (len(mel) - 2) * media.HOP + media.FRAME or len(mel) == 1
