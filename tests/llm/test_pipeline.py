"""The corpus pipeline: every stage on documents with odd rows, against its operator's rule or brute force."""

import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import decontam, packing, pii
from tests.llm.test_llm import ODD

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    own = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6 + k, t, "en", None, len(t or "")) for k, t in enumerate([*ODD, *ODD, "word " * 60_000])], "doc_id long, text string, lang string, source string, n_chars long")
    return own.unionByName(odd.select(*[F.col(c).cast(own.schema[c].dataType) for c in own.columns])).withColumn("id", F.lit(7)).repartition(5)


def _ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_columns_and_take_odd_rows(spark, sf, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        empty = stage(spark, docs.limit(0), sf)
        assert empty.columns == docs.columns and empty.count() == 0, name
    assert corpus_pipeline.pack(spark, docs.limit(0), sf).count() == 0


def test_language_keeps_what_is_told(spark, sf, docs):
    kept = set(_ids(corpus_pipeline.language(spark, docs, sf)))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not any(k in kept for k, t in texts.items() if not t or not re.search(r"[^\W\d_]", t))
    own = [k for k, t in texts.items() if k < 10**6 and t and len(t.split()) >= 20]
    assert sum(k in kept for k in own) >= 0.97 * len(own)


def test_one_document_of_each_group_stays(spark, sf, docs):
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root, keys = {k: k for k in sets}, sorted(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(20):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert _ids(corpus_pipeline.near_copies(spark, docs, sf)) == [k for k in keys if root[k] == k]


def test_passages_and_personal_data(spark, sf, docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    kept, items = set(_ids(corpus_pipeline.benchmark_passages(spark, docs, sf))), [SPACE.findall(r["text"]) for r in bench.collect()]
    for r in docs.select("doc_id", "text").collect():
        if any(" ".join(item) in " ".join(SPACE.findall(r["text"] or "")) for item in items):
            assert r["doc_id"] not in kept
    assert kept == set(_ids(docs)) - set(_ids(decontam.contaminated(docs, bench)))
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in corpus_pipeline.personal_data(spark, docs, sf).collect():
        old = before[r["doc_id"]]
        assert pii.base_spans(r["text"] or "") == [] and (pii.base_spans(old or "") or r["text"] == old) and r["n_chars"] in (len(r["text"] or ""), None, 0)


def test_packed_pieces_hold_every_token(spark, sf, docs):
    from tokenizers import Tokenizer

    own, rows = Tokenizer.from_file(packing.default_tokenizer()), {}
    for r in corpus_pipeline.pack(spark, docs, sf).collect():
        rows.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*own.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, n, crc, total in sorted(rows[r["doc_id"]]):
            assert (start, total) == (at, len(ids)) and zlib.crc32(ids[at : at + n].tobytes()) == crc
            at += n
        assert at == len(ids)


def test_whole_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert used and all(r["n"] == r["end"] <= 2048 for r in used)
