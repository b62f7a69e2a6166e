"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens) in shared storage. A document's content
is normalised no further than its tokenizer ignores: a vocabulary that drops white space has runs of it folded to
one space, any other keeps the text as it is. The distinct digests of the documents are joined to the cache; of what
is missing, the first text of each digest is encoded where it lies, found by its file and row, and its count appended: digests
are shuffled, texts are not (see scratch.among). The answer for each digest is then a table of its
own, to which the documents are joined: both sides are plain scans, so adaptive execution splits a digest that a
third of all rows have. Copies meet in a partial aggregate before every other shuffle.

Cases: a null text counts as empty; null ids and repeated rows are kept; an empty table gives no rows; other
columns are ignored, whatever their names. A job that is repeated after a failure finds what the first one appended;
counts appended twice agree and are folded when read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowdelta.llm import arrow, exact_dedup, scratch, tokens

CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Of the file's bytes and the library's version: another of either asks for other counts."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.__version__.encode()).hexdigest()


class PieceModel:
    """A sentencepiece model with the interface of tokens.PieceEncoder."""

    splits = False

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[bytes]) -> list[int]:
        return [len(x) for x in self.library.encode([t.decode() for t in texts], num_threads=1)]


def counter(path: str):
    """Texts to token counts, and whether the vocabulary drops white space."""
    if path.endswith(".model"):
        model = PieceModel(path)
        return model.counts, False
    encoder = tokens.encoder(path)
    return (lambda texts: [len(x) // 4 for x in encoder.packed(texts)]), encoder.splits


def normalised(text: Column, folds: bool) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")) if folds else text


def opened(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(content_digest, stored) of one tokenizer's counts; a cache that is not there yet is made, without rows."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    mine = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer_digest") == version)
    return mine.groupBy("content_digest").agg(F.max("n_tokens").alias("stored"))


def count_tokens(docs: DataFrame, cache: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: DataFrame | None = None) -> DataFrame:
    """One row for each document: id_col, n_bytes (UTF-8), n_tokens. cache: folder of the cache; made if absent.

    ids: a column id_col; only documents with one of them are counted.
    """
    spark, path = docs.sparkSession, path or tokens.vocabulary()
    version, folds = tokenizer_digest(path), counter(path)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)[0]
        for part, texts in arrow.slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count(texts), pa.int64())], ["file", "place", "n_tokens"])

    with scratch.tables(spark) as kept:
        source = exact_dedup.located(docs, id_col, text_col).select("doc", F.coalesce("text", F.lit("")).alias("text"), "locator.file", "locator.place")
        if ids is not None:
            wanted = source.select("doc", "file", "place").join(ids.select(F.col(id_col).alias("doc")), "doc", "left_semi")
            source = scratch.among(source, scratch.written(wanted.select("file", "place"), "wanted"), "place", "file")
        digest = F.unhex(F.sha2(normalised(F.col("text"), folds), 256)).alias("content_digest")
        rows = scratch.written(source.select("doc", F.octet_length("text").cast("long").alias("n_bytes"), digest, "file", "place"), "digests")
        asked = rows.groupBy("content_digest").agg(F.min(F.struct("file", "place")).alias("first")).join(opened(spark, cache, version), "content_digest", "left")
        asked = scratch.written(asked.select("content_digest", "first.file", "first.place", "stored"), "asked")
        missing = asked.where("stored IS NULL").select("content_digest", "file", "place")
        held = asked.where("stored IS NOT NULL")
        texts = scratch.among(source.select("file", "place", "text"), missing.select("file", "place"), "place", "file")
        counts = scratch.written(texts.mapInArrow(run, "file string, place long, n_tokens long"), "counts")
        fresh = scratch.written(missing.join(counts, ["file", "place"]).select("content_digest", "n_tokens"), "fresh")
        fresh.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
        answers = scratch.written(held.select("content_digest", F.col("stored").alias("n_tokens")).union(fresh), "answers")
        kept += [rows, answers]
    return rows.join(answers, "content_digest").select(F.col("doc").alias(id_col), "n_bytes", "n_tokens")
