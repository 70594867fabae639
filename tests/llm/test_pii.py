"""Personal data: paths against a plain Viterbi, and forms that the patterns don't know in texts that were not trained on."""

import random

import numpy as np

from scanloom.llm import pii


def _texts(r, n):
    words = "the order was sent to our office and we will answer in two days with more details about it".split()

    def item():
        kind = r.randrange(5)
        if kind == 0:
            return f"{r.choice(words)}.{r.choice(words)}{r.randint(1, 99)}@{r.choice(words)}.{r.choice(['com', 'org', 'net'])}"
        if kind == 1:
            return ".".join(str(r.randint(0, 255)) for _ in range(4))
        if kind == 2:
            digits = [r.randint(1, 9) for _ in range(15)]
            rest = sum(sum(divmod(d * (2 - k % 2), 10)) for k, d in enumerate(digits)) % 10
            return "".join(map(str, [*digits, (10 - rest) % 10]))
        if kind == 3:
            return f"+{r.randint(1, 99)} ({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}"
        return r.choice([str(r.randint(1, 99999)), f"{r.randint(1, 12)}:{r.randint(10, 59)}", f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)}"])

    return [" ".join([*r.choices(words, k=r.randint(4, 40)), item(), *r.choices(words, k=r.randint(0, 30))]) for _ in range(n)]


def test_forms_that_no_pattern_knows(spark):
    docs = spark.createDataFrame(list(enumerate(_texts(random.Random(1), 700))), "doc_id long, text string")
    tagger = pii.train(docs)
    held_out = [pii.varied(t, k * 7919 + 3) for k, t in enumerate(_texts(random.Random(2), 500))]
    want, got = set(), set()
    for k, ((text, spans), found) in enumerate(zip(held_out, pii._spans_of([t for t, _ in held_out], tagger), strict=True)):
        base = pii.base_spans(text)
        want |= {(k, *x) for x in spans if not any(x[0] < e and s < x[1] for s, e, _ in base)}
        got |= {(k, *x[:3]) for x in found if not x[3]}
        assert [x[:3] for x in found if x[3]] == base
    assert len(want) > 60 and len(want & got) >= 0.75 * len(want) and len(want & got) >= 0.9 * len(got)
    clean = pii._spans_of([" ".join(["on 2024-01-02 at 12:30 we paid 1,250.00 for item 77 of 300 (page 12)"] * 9)] * 3, tagger)
    assert clean == [[], [], []]


def test_paths_match_a_plain_viterbi():
    r = np.random.default_rng(0)
    tagger = pii.Tagger()
    tagger.w["move"], tagger.w["start"] = r.normal(size=(pii.TAGS, pii.TAGS)), r.normal(size=pii.TAGS)
    score = r.normal(size=(7, pii.STEP, pii.TAGS))
    first = np.array([1, 0, 0, 1, 1, 0, 0], bool)
    got = tagger.decode(score, first)
    for low, high in ((0, 3), (3, 4), (4, 7)):
        flat = score[low:high].reshape(-1, pii.TAGS)
        best, back = tagger.w["start"] + flat[0], []
        for row in flat[1:]:
            reach = best[:, None] + tagger.w["move"]
            back.append(reach.argmax(0))
            best = reach.max(0) + row
        path = [int(best.argmax())]
        for came in reversed(back):
            path.append(int(came[path[-1]]))
        assert got[low:high].ravel().tolist() == path[::-1]


def test_stretches_of_one_text():
    r = random.Random(3)
    tagger = pii.Tagger().fit(np.array([pii.char_classes(("x" * 20 + "12.34.56.78" + " y" * 30)[: pii.WINDOW])] * 4), np.array([pii.tags_of(pii.WINDOW, [(20, 31, "ip")])] * 4), steps=30)
    texts = ["", "x", "1", "a" * 5000, "1" * 3000, "a " * 300 + "12.34.56.78" + " b" * 700 + "@", *(" ".join(r.choices(["ab", "12", "@", "."], k=200)) for _ in range(3))]
    for text, spans in zip(texts, tagger.spans([pii.char_classes(t) for t in texts]), strict=True):
        assert all(0 <= a < b <= len(text) for a, b, _ in spans)
        assert tagger.spans([pii.char_classes(text)]) == [spans]
