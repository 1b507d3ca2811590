"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express.

Each query applies one operator to its whole table and only derives the agreed columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import bpe, chroma, decontam, minhash, quality, sharding, substring, token_count, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(C.table(spark, sf_dir, "pages"))


def op3_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = chroma.fingerprints(C.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", chroma.tune).checkpoint()
    return chroma.align(prints, prints.where("id % 50 = 0")).withColumnRenamed("id", "vec_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(C.table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1
), shared AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id WHERE a.sh IN (SELECT sh FROM shared) GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.c + b.c - k)
), r AS (
  SELECT x AS doc_id, x AS z FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.z = e.x
), m AS (SELECT doc_id, min(z) AS z FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_shingles, coalesce(m.z, d.doc_id) AS component_id,
       d.doc_id = coalesce(m.z, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontam.contaminated().alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)
), m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)
), h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, unnest(range(0, n)) AS k FROM m) GROUP BY 1
), t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
         FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(C.table(spark, sf_dir, "documents"), digest=True)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)
), f AS (SELECT w, min(doc_id) AS first_doc FROM win GROUP BY 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM win JOIN f USING (w) WHERE first_doc < doc_id)
), words AS (
  SELECT u.doc_id, u.pos, u.word, g.pos IS NOT NULL AS removed
  FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM d) u LEFT JOIN gone g ON u.doc_id = g.doc_id AND u.pos = g.pos
), a AS (
  SELECT doc_id, count(*) FILTER (WHERE removed) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT removed), '') AS kept
  FROM words GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(C.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_quality": op2_quality,
    "op3_chroma_fingerprints": op3_chroma_fingerprints,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
}
SQL: dict[str, str] = {
    "op8_benchmark_decontamination": OP8_SQL,
    "op9_minhash_near_dedup": OP9_SQL,
    "op10_substring_dedup": OP10_SQL,
}
