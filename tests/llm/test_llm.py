"""Training-data operators against brute force, round trips and held-out accuracy, on small tables and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from scanloom.llm import decontam, langid, licenses, lm, media, neardup, packing, pii, queries, substrings, urls

ODD = [None, "", " ", "a", "a " * 200, "Mit License", "é" * 30, "x" * 5000, "the mit license the mit license", "++ @ 1.2.3.4 a@b.co +1 (988) 555-2485 4539148803436467"]
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 160))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:10]] + texts[:5] + [f"{texts[3]} {texts[7]}", *ODD, *ODD]
    rows = [(k, t, 7, "en" if k % 2 else "fr") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id long, lang string").repartition(3)


def _texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("bucket", [8 << 20, 0])
def test_substrings(docs, bucket):
    texts = {k: SPACE.findall(t or "") for k, t in _texts(docs).items()}
    seen = {}
    for k in sorted(texts):
        for i in range(len(texts[k]) - 49):
            seen.setdefault(tuple(texts[k][i : i + 50]), k)
    for r in substrings.drop_repeats(docs, bucket_bytes=bucket).collect():
        w = texts[r["doc_id"]]
        gone = {j for i in range(len(w) - 49) if seen[tuple(w[i : i + 50])] < r["doc_id"] for j in range(i, i + 50)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def _families(spark):
    """Texts of one origin, so that a band's bucket holds many components with pairs on both sides of the threshold."""
    r = random.Random(5)
    origin = [f"w{k}" for k in range(120)]
    texts = [" ".join(w if r.random() > rate else f"x{r.randrange(10**6)}" for w in origin) for rate in (0.005, 0.01, 0.02, 0.03) for _ in range(40)]
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("block", [24, 3])
def test_open_buckets(spark, block):
    docs = _families(spark)
    sets = {k: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for k, w in ((k, t.split()) for k, t in _texts(docs).items())}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    root = {k: k for k in sets}
    for _ in range(20):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert 3 < len(set(root.values())) < len(sets) - 20
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 4, block=block).collect()}
    assert found == root


def test_near_duplicates(docs):
    sets = {}
    for k, t in _texts(docs).items():
        w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}
    for _ in range(8):
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    for r in neardup.near_duplicates(docs, 4).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]])


def test_licenses(docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = _texts(docs)
    for r in licenses.scan_licenses(docs).collect():
        w = word.findall((texts[r["doc_id"]] or "").lower())
        at = [i for i in range(len(w)) for p in licenses.PHRASES if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))


def test_tokenizer_and_packing(docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    own.encode_special_tokens = True
    r = random.Random(1)
    odd = ["".join(r.choice("abcXYZ  \n\t019.,!?'-_éÉÑß×÷àǽ\xa0ª漢🙂\x1c<|>") for _ in range(r.randint(0, 60))) for _ in range(300)]
    for mine, text in zip(packing.WordIds(packing.default_tokenizer()).encode(odd), odd, strict=True):
        assert mine.tolist() == own.encode(text, add_special_tokens=False).ids
    texts = _texts(docs)
    rows = packing.pack(docs, length=64).collect()
    for k, t in texts.items():
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted((x["start"], x["length"], x["ids_crc32"]) for x in rows if x["doc_id"] == k)
        assert sum(x[1] for x in pieces) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in pieces)
    by: dict[int, list] = {}
    for x in rows:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for own_ in by.values():
        at = 0
        for offset, n in sorted(own_):
            assert offset == at
            at += n
        assert at <= 64


def test_urls(spark):
    texts = [None, "", "no scheme", "http://EXAMPLE.org/es/1", "https://a.b.example.org/en/12", "http://org", "http://x.com/fr/", "http://notexample.org/es/", "http://x.net/cart?q#f", "a://b.com/de/?x://y.org/"]
    rows = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")).collect()}
    assert [rows[k]["rule"] for k in range(10)] == [None, None, None, "example.org/es/", "example.org/en/1", None, "com/fr/", "org/", None, "com/de/"]
    assert rows[8]["verdict"] == "block" and rows[3]["host"] == "example.org" and rows[0]["host"] == rows[0]["path"] == ""


def test_personal_data(docs):
    assert pii.base_spans("a@b.co, +1 (988) 555-2485 x 1.2.3.4 x 1.2.3.400 x 4539148803436467") == [(0, 6, "email"), (8, 25, "phone"), (28, 35, "ip"), (50, 66, "card")]
    assert pii.base_spans("+1 (988) 555-2485 1.2.3.4 4539148803436467") == [(18, 25, "ip")]  # one run of phone characters, too long, and no second try
    found = {r["doc_id"]: r for r in pii.digest(pii.find_pii(docs, pii.train(docs, steps=5))).collect()}
    for k, t in _texts(docs).items():
        base = pii.base_spans(t or "")
        assert found[k]["base_sha256"] == hashlib.sha256(",".join(f"{c}:{a}:{b}" for a, b, c in base).encode()).hexdigest()
        assert all(f"{c}:{a}:{b}" in found[k]["spans"].split(",") for a, b, c in base)


def test_media_round_trip(docs):
    texts = _texts(docs)
    for r in media.encode_media(docs).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload, _ = media.from_wav(bytes(r["media"]))
        assert payload.rstrip(b"\0") == raw.rstrip(b"\0") and len(payload) % 64 == 0 and len(payload) >= max(64, len(raw))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and len(r["tensor"]) == media.ROWS * media.BANDS
    x = np.random.default_rng(0).normal(size=500).astype("f4")
    for up, down in ((1, 2), (3, 2)):
        taps, wide = media._low_pass(up, down), np.zeros(500 * up)
        wide[::up] = x
        want = np.convolve(wide, taps)[len(taps) // 2 :][: 500 * up][::down]
        assert np.abs(want - media.resample(x, up, down)).max() < 1e-5


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_recall(spark):
    r = random.Random(4)
    vocabulary = ["w%d" % k for k in range(2000)]
    items = [[r.choice(vocabulary) for _ in range(r.randint(15, 50))] for _ in range(20)]
    texts, want = [], set()
    for k in range(120):
        words = [r.choice(vocabulary) for _ in range(150)]
        if k % 2:
            held = list(items[k % 20])
            for _ in range(r.randint(0, len(held) // 5)):
                at = r.randrange(len(held))
                held[at : at + 1] = r.choice(([], [r.choice(vocabulary)], [held[at], r.choice(vocabulary)]))
            words[60:60] = held
        texts.append(" ".join(words))
        for i, item in enumerate(items):
            if set(item) & set(words) and any(_edit(item, words[s : s + len(item) * 12 // 10 + 1]) <= len(item) // 5 for s in range(len(words)) if len(set(item) & set(words[s : s + len(item) + 12])) >= len(item) // 2):
                want.add((k, i))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    for size in (8 << 20, 1000):
        got = {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(docs, bench, index_bytes=size).collect()}
        assert got <= want and len(got) >= 0.95 * len(want)


def test_language_is_learned(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.identify(docs, langid.train(docs, steps=80)).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    score, start, move = rng.normal(size=(7, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    fresh = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    want = np.zeros((7, 3))
    import itertools

    for part in (slice(0, 4), slice(4, 7)):
        s = score[part]
        for path in itertools.product(range(3), repeat=len(s)):
            p = np.exp(start[path[0]] + sum(s[i, k] for i, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
            for i, k in enumerate(path):
                want[part.start + i, k] += p
    want /= want.sum(1, keepdims=True)
    assert np.allclose(langid.marginals(score, fresh, start, move), want)


def test_language_model_prefers_text_to_noise(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = lm.train(docs)
    noise = docs.selectExpr("doc_id", "reverse(text) AS text")
    mean = lambda d: lm.score(d, model).selectExpr("avg(mean_log_prob) AS m").first()["m"]
    assert mean(docs) > mean(noise)


@pytest.mark.parametrize("table", ["empty", "null"])
def test_empty_tables(spark, table):
    rows = [] if table == "empty" else [(1, None, None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    n = len(rows)
    assert licenses.scan_licenses(docs).count() == n and substrings.drop_repeats(docs).count() == n
    assert neardup.near_duplicates(docs).count() == n and packing.pack(docs).count() == n
    assert langid.identify(docs, langid.train(docs)).count() == n and media.encode_media(docs).count() == n
    assert pii.find_pii(docs, pii.train(docs), carry=True).count() == n and lm.score(docs, lm.train(docs)).count() == n


def test_every_operator_has_a_query():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
