"""The registered queries of this subpackage and their DuckDB SQL.

A query reads its whole table, applies its operator with production parameters
and derives the digest columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextlake.llm import chroma, langid, licenses, mixing, neardup, packing, pii, topk, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.prototypes(docs.filter("not held_out"))
    return langid.identify(docs, model, keep=("doc_id", "held_out"))


def op2_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no sound, so a text's UTF-8 bytes stand for 8-bit samples.
    A row of kind ``member`` per document, and of kind ``match`` per aligned pair
    of classes; queries are the documents whose id is divisible by 50."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("samples"))
    members, matches = chroma.align(docs, F.col("doc_id") % 50 == 0)
    empty = F.lit(None).cast("long")
    named = members.select(F.lit("member").alias("kind"), F.col("id").alias("doc_id"), "class_id", empty.alias("offset"), empty.alias("frames"), empty.cast("double").alias("bit_error"))
    return named.unionByName(matches.select(F.lit("match").alias("kind"), F.col("query_id").alias("doc_id"), F.col("match_id").alias("class_id"), "offset", "frames", "bit_error"))


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counted(_read(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), shingle_words=2, pct=80)


def op5_toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.learn(docs, _read(spark, sf_dir, "labels")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents"))


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(_read(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, limit=2.0)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


def op9_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(_read(spark, sf_dir, "pages")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return packing.packed_documents(_read(spark, sf_dir, "documents"), path or tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_chroma_fingerprints": op2_chroma_fingerprints,
    "op3_pii_spans": op3_pii_spans,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_toxicity_grades": op5_toxicity_grades,
    "op6_license_scan": op6_license_scan,
    "op7_pareto_mix": op7_pareto_mix,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_warc_bundles": op9_warc_bundles,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLES: dict[str, str] = {
    "op8_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op9_warc_bundles": """
        SELECT page_id, bytes AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN bytes >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN bytes >= 1000 AND page_id <> m THEN m END AS refers_to
        FROM (SELECT page_id, h, octet_length(encode(h)) AS bytes, max(page_id) OVER (PARTITION BY h) AS m FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))""",
}
