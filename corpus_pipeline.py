"""From documents to packed token sequences: toxicity, exact dedup, near dedup, personal data, packing.

Cases, the same in all stages: a null text counts as empty; rows with a null id are documents like others; rows of one id
with different texts are different documents, rows equal in id and text are one after the second stage; texts of any
length are read whole; an empty table gives an empty table; other columns pass through unchanged, whatever their names,
but for `n_chars`, which follows the text. Every row that a stage drops is toxic or has a kept representative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowdelta.llm import exact_dedup, packing, pii, scratch, simhash, toxicity


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model, score_col="__toxicity").where("__toxicity < 0.5").drop("__toxicity")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each equal text stays."""
    return exact_dedup.survivors(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: at least 0.8 of five-word shingles in common."""
    return simhash.survivors(docs, **simhash.FIVE_WORDS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates."""
    out = pii.replaced(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


#: Words that a packing worker keeps: fewer than alone, as the executor's memory still holds what earlier stages have left.
WORDS = 200_000


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(docs, words=WORDS).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("toxicity", clean), ("exact_dedup", distinct), ("simhash", unlike), ("pii", private), ("packing", packed)]

#: SQL can't express the fit or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, path = docs, scratch.folder(spark, name)
        with scratch.released(spark):  # a stage's own tables go once its result is written
            docs = scratch.written(stage(spark, before, sf_dir), name, path)
        scratch.dropped(spark, before)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
