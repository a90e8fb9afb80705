"""Queries of this package: one for each operator with its production parameters, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_batches
from . import fill_middle, license_scan, prefix_trie, secret_scan
from .exact_topk import exact_top_k
from .language_id import identify_language
from .ngram_join import ngram_join
from .packing import pack
from .quality_crf import score_quality
from .sentencepiece_codec import encode_decode
from .token_counts import token_counts
from .toxicity import score_toxicity
from .vptree_ann import nearest_neighbours


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return exact_top_k(read_table(spark, sf_dir, "embeddings"), query_modulus=50, k=5)


OP1_SQL = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.id % 50 = 0 AND q.id <> c.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, those of the best sum, and whether the text came back from them."""
    text_batches(spark)
    coded = encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "best_ids", "best_score", "came_back")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    joined = ngram_join(read_table(spark, sf_dir, "documents"), percent=90, size=3)
    return joined.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = w.doc_id
"""


def op8_vptree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), query_modulus=100, k=10)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return identify_language(read_table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every transformed text, and of the text rebuilt from it."""
    text_batches(spark)
    made = fill_middle.fill_in_middle(read_table(spark, sf_dir, "documents"))
    again = made.withColumn("restored", fill_middle.restored(F.col("output"), F.col("form")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return again.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return prefix_trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_quality_crf": op2_quality_crf,
    "op3_token_counts": op3_token_counts,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_join": op7_ngram_join,
    "op8_vptree_ann": op8_vptree_ann,
    "op9_license_scan": op9_license_scan,
    "op10_language_id": op10_language_id,
    "op11_secret_scan": op11_secret_scan,
    "op12_fill_middle": op12_fill_middle,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_topk": OP1_SQL, "op7_ngram_join": OP7_SQL, "op9_license_scan": license_scan.oracle_sql(),
    "op11_secret_scan": secret_scan.oracle_sql(), "op12_fill_middle": fill_middle.ORACLE_SQL, "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
