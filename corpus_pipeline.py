"""From raw documents to packed training sequences: language, near copies, benchmark passages, personal data, packing.

Each stage calls one operator, works on all documents that its predecessor kept, and (but for the last) returns the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import decontam, langid, neardup, packing, pii
from scanloom.llm import text as tx

#: Share of a text's words that its language must have, by their marginals.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without text or letters, and those of no one language."""
    found = langid.identify(docs, langid.train(docs), carry=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def _without(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The rows but those with the key and the text (its hash t) of a row of out; rows with equal keys and other texts stay."""
    out = out.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"))
    return docs.join(out, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_t")), "left_anti").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the least key, of each group of near duplicates. Of linked texts with that key one stays."""
    found = neardup.near_duplicates(docs, named=True)
    heads = found.where(F.col("kept") & F.col("group").isNotNull() & F.col("doc_id").isNotNull())
    several = heads.groupBy("group").agg(F.min("t").alias("_least"), F.max("t").alias("_most")).where("_least < _most")
    more = heads.join(several, "group").where(F.col("t") > F.col("_least"))
    return _without(docs, found.where("not kept").select("doc_id", "t").unionByName(more.select("doc_id", "t")))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")
    found = decontam.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="row").select("row").distinct()
    return docs.join(found.withColumnRenamed("row", "_row"), F.xxhash64("doc_id", "text") == F.col("_row"), "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of each span of personal data."""
    found = pii.find_pii(docs, pii.train(docs), carry=True)
    own = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return found.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_passages", benchmark_passages), ("personal_data", personal_data), ("packing", pack)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{tx.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
