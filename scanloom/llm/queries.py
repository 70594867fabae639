"""One query for each operator of this subpackage, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import decontam, langid, lattice, lexical, licenses, lm, media, neardup, packing, pii, runs, substrings, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm.score(docs, lm.train(docs))


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.encode_media(_table(spark, sf_dir, "documents"), keep_media=False)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.digest(pii.find_pii(docs, pii.train(docs)))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _planted(docs: DataFrame) -> DataFrame:
    """Documents in which those with a crc32 divisible by ten repeat a stretch of their own words up to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    text = F.expr("array_join(transform(sequence(0, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_planted(_table(spark, sf_dir, "documents")), keep_text=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op12_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_language_id, op3_substring_dedup, op4_minhash_dedup, op5_pseudo_likelihood, op6_audio_features, op7_pii, op8_packing,
        op9_url_filter, op10_decontamination, op11_periodic_runs, op12_lattice_dedup, op13_ranked_search,
    )
}

_SUBSTRINGS = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), n AS (
  SELECT doc_id, words, len(words) AS n_words FROM w
), win AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM n, unnest(generate_series(1, n_words - 49)) AS s(i) WHERE n_words >= 50
), first AS (
  SELECT h, min(doc_id) AS least FROM win GROUP BY h
), cut AS (
  SELECT win.doc_id, list(i) AS starts FROM win JOIN first USING (h) WHERE least < win.doc_id GROUP BY win.doc_id
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(starts) AS i FROM cut) AS c, unnest(generate_series(i, i + 49)) AS g(p)
), kept AS (
  SELECT n.doc_id, list(words[p] ORDER BY p) AS words FROM n, unnest(generate_series(1, n_words)) AS g(p)
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = n.doc_id AND gone.p = g.p) GROUP BY n.doc_id
)
SELECT n.doc_id, n.n_words, n.n_words - coalesce(len(kept.words), 0) AS n_removed, sha256(coalesce(array_to_string(kept.words, ' '), '')) AS kept_sha256
FROM n LEFT JOIN kept USING (doc_id)
"""

_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS g FROM w, unnest(generate_series(1, greatest(len(words) - 3, least(len(words), 1)))) AS t(i)
), c AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT a, b FROM both_ JOIN c AS ca ON ca.doc_id = a JOIN c AS cb ON cb.doc_id = b WHERE 100 * both_.n >= 80 * (ca.n + cb.n - both_.n)
), reach AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), root AS (
  SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, least(d.doc_id, coalesce(root.least, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(root.least, d.doc_id)) AS kept
FROM documents AS d LEFT JOIN c USING (doc_id) LEFT JOIN root USING (doc_id)
"""

_URLS = r"""
WITH r AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, rest FROM r
), t AS (
  SELECT *, substr(rest, length(regexp_extract(rest, '^[^?#]*')) + 1) AS tail, '.' || host AS dotted FROM p
), j AS (
  SELECT *, CASE
    WHEN ends_with(dotted, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ends_with(dotted, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ends_with(dotted, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ends_with(dotted, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ends_with(dotted, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM t
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN contains(path, '/login') OR contains(path, '/cart') OR ends_with(path, '.zip') OR ends_with(path, '.exe')
      OR contains(tail, 'utm_source=feed') OR contains(tail, 'sessionid=') THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""

_RUNS = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), bits AS (
  SELECT i::BIGINT AS i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) AS t(i)
), crc AS (
  SELECT list(v ORDER BY i) AS t FROM bits
), h AS (
  SELECT doc_id, words, len(words) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h FROM d, crc
), g AS (
  SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h
), planted AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN words ELSE list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS words FROM g
), w AS (
  SELECT doc_id, n, unnest(words) AS word, unnest(range(n)) AS i FROM planted
), same AS (
  SELECT x.doc_id, y.i - x.i AS p, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island, x.i
  FROM w AS x JOIN w AS y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), stretch AS (
  SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM same GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(24, 3 * p)
), run AS (
  SELECT doc_id, start, length, min(p) AS period FROM stretch GROUP BY doc_id, start, length
), top AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS r FROM run
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS all_runs FROM run GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.start, top.length, top.period, 1000 * top.length // top.period AS exponent_milli,
  sha256(coalesce(all_runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents AS d LEFT JOIN listed USING (doc_id) LEFT JOIN (SELECT * FROM top WHERE r = 1) AS top USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_VECTORS = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), root AS (
  SELECT a AS vec_id, min(b) AS least FROM reach GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(root.least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(root.least, vec_id)) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN root USING (vec_id)
"""

_RANKED = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), total AS (
  SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), posting AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term
), weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM posting, total GROUP BY term, n_docs
), score AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN posting USING (term) JOIN weight USING (term), total GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM score WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""

#: The other operators' results rest on trained models, tokenizers or automata that SQL can't express; tests hold them against brute force.
ORACLES = {
    "op3_substring_dedup": _SUBSTRINGS, "op4_minhash_dedup": _NEAR, "op9_url_filter": _URLS, "op11_periodic_runs": _RUNS, "op12_lattice_dedup": _VECTORS,
    "op13_ranked_search": _RANKED,
}
