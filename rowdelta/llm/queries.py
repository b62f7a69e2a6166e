"""Registered queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowdelta.llm import bpe, exact_dedup, packing, pii, scratch, secret_scan, simhash, substring_dedup, token_counts, toxicity, vector_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only documents with a passage to take out have rows; first_id is the document that keeps it."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("row")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_replaced")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = "filter(spans, s -> s.kind IN ('assign', 'access', 'hex'))"
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined.format(base)).cast("binary"), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))


#: Token counts above this one are marked.
TOKEN_LIMIT = 2048


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the documents that are marked toxic are in the cache when all documents ask for theirs: hits and misses in one run.

    The cache lies in the shared folder and goes with the application; a standing job names a lasting one.
    """
    docs, cache = table(spark, sf_dir, "documents"), scratch.folder(spark, "cache")
    marked = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    with scratch.released(spark):
        token_counts.count_tokens(docs, cache, ids=marked)
    return token_counts.count_tokens(docs, cache).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_secret_scan": op6_secret_scan,
    "op7_token_counts": op7_token_counts,
    "op8_vector_dedup": op8_vector_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_byte_bpe": op10_byte_bpe,
}
ORACLE: dict[str, str] = {
    "op8_vector_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), r(id, x) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.x = l.a),
        c AS (SELECT id, min(x) AS component_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON id = vec_id LEFT JOIN n ON a = vec_id""",
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
}
