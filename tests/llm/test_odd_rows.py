"""Results by the contracts' own words: base spans of personal data, held-out languages, URL rules and contamination on odd rows."""

import hashlib
import re

import pytest

from scanloom.llm import decontam, queries, urls


def _luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and _luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, text) if good(m[0])]
    counts = [sum(f[1] == k for f in found) for k in range(4)]
    return (*counts, hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(found)).encode()).hexdigest())


def test_base_spans_by_the_contract(spark, sf, tmp_path):
    own = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [None, "", "a@b.co,a@b@c.de x@y..z 1.2.3.4.5 256.1.1.1 1.2.3.4", "4539 1488 0343 6467 45391488034364671 é4539-1488-0343-6467ü", "+1 (988) 555-2485 +49.30-1234567- ++1 2 +1()2", "é" * 9 + "😀 x@y.zz " * 3, "0" * 5000]
    extra = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    own.unionByName(extra, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op7_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    for g in got:
        assert (g["n_email"], g["n_ip"], g["n_card"], g["n_phone"], g["base_sha256"]) == _base(texts[g["doc_id"]]), g["doc_id"]


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [g for g in queries.op2_language_id(spark, sf).collect() if g["held_out"] and truth[g["doc_id"]] is not None]
    assert len(held) > 100
    assert sum(g["lang_pred"] == truth[g["doc_id"]] for g in held) >= 0.97 * len(held)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _judge(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


@pytest.mark.parametrize("empty", [False, True])
def test_urls_on_odd_rows(spark, empty):
    held = [None, "", "no url", "http://", "https://EXAMPLE.org/es/x", "http://a.Example.ORG/en/12?q#f", "http://example.org?x", "http://badexample.org/es/", "ftp://x.com/de/é", "http://x.com/fr/de/", "http://É.com/de/", "://com/de/", "http://com", "x://y://z.org/", "http://h.net/" + "a" * 60_000, "http://h.net/login"]
    rows = [] if empty else [(k, u, "a", "b") for k, u in enumerate(held)] + [(4, held[4], "a", "b"), (4, held[8], "a", "b"), (None, held[4], "a", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string").repartition(2)
    got = sorted(((g["page_id"], g["host"], g["path"], g["rule"]) for g in urls.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    want = [(k, *_judge(u)[:2], _judge(u)[2][0] if _judge(u)[2] else None) for k, u, *_ in rows]
    assert got == sorted(want, key=str)
    for g in urls.filter_urls(pages).collect():
        if g["rule"] is not None:
            assert g["verdict"] == next(v for h, p, v in RULES if h + p == g["rule"])


def test_contamination_on_odd_rows(spark):
    item = [f"w{k}x" for k in range(20)]
    items = [(1, " ".join(item)), (2, None), (3, ""), (4, "--"), (None, " ".join(item)), (1, " ".join(item)), (5, "one")]
    docs = [(1, "a b " + " ".join(item) + " c"), (2, None), (3, ""), (4, " ".join(item[:10])), (1, "clean words only"), (5, " ".join([*item[:9], "other", *item[10:]])), (5, " ".join([*item[:9], "other", *item[10:]]))]
    d = spark.createDataFrame([(*x, 9) for x in docs], "doc_id long, text string, item int").repartition(2)
    b = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, distance int")
    got = sorted((g["doc_id"], g["item_id"], g["distance"], g["start"], g["end"]) for g in decontam.contaminated(d, b).distinct().collect())
    assert got == [(1, 1, 0, 2, 22), (5, 1, 1, 0, 20)]
    assert decontam.contaminated(d, b.limit(0)).count() == 0 and decontam.contaminated(d.limit(0), b).count() == 0
    assert decontam.contaminated(d, b.where("item_id > 1 and item_id < 5")).count() == 0
