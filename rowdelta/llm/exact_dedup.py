"""Exact deduplication with keyed streaming state.

A stream of keys (SHA-256 of the normalised text, the document's id, a content locator) runs through a streaming
aggregation whose state is kept on disk by RocksDB, without a watermark, so no key ever expires. For each digest
the state retains the least (id, locator) and the number of rows. A hit, a digest seen more than once, is
checked on full bytes: the texts behind it are grouped by the text itself, which settles a collision of digests too.
A locator is the file and the row's place in it, so every reading gives a text the same one. An input that is more than a
scan of Parquet files (a shuffle, whose rows may come in another order each time) is written once and read from there.
Copies meet in partial aggregates before each shuffle, so a group with a third of all rows is one row for each task.

`first_seen` works on any stream of keys, with a checkpoint of the caller's, and goes on where it stopped;
`deduplicate` drives it over a table that is there already.

Cases: a null text counts as empty; texts are equal when they are after each run of white space is one space; of rows
with the same text and id, one stays; a null id stays only if its group has no other; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rowdelta.llm import scratch

#: State on disk, without files laid out ahead of what is in them (megabytes for each partition's store).
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Null ids sort behind all others.
_FIRST = "min(struct(doc IS NULL AS without, doc, locator)) AS first"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def first_seen(keys: DataFrame, to: str, checkpoint: str) -> None:
    """Runs a stream of (digest, doc, locator) to its present end; each batch leaves the state of the digests that it touched in `to`.

    Counts and least ids in a later batch's folder replace those in an earlier one's; read them with `seen`.
    """
    spark = keys.sparkSession
    state = keys.groupBy("digest").agg(F.expr(_FIRST), F.count("*").alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/batch={number}")  # a batch that is run again writes the same

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def seen(spark, to: str, schema) -> DataFrame:
    """digest, first, n: the last state of each digest. Counts only grow and the least id only falls."""
    rows = spark.read.schema(schema).option("basePath", to).parquet(to)
    return rows.groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))


#: Logical operators under which a scan's rows stay what and where they are.
_PLAIN = {"LogicalRelation", "Project", "Filter", "SubqueryAlias"}


def _is_scan(docs: DataFrame) -> bool:
    def plain(node) -> bool:
        children = node.children()
        return node.nodeName() in _PLAIN and node.deterministic() and all(plain(children.apply(i)) for i in range(children.size()))

    return plain(docs._jdf.queryExecution().analyzed())


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, locator), alike at every reading."""
    wanted = F.col(id_col).alias("doc"), F.col(text_col).alias("text")
    locator = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")).alias("locator")
    if _is_scan(docs) and "_metadata" not in docs.columns:
        try:
            return docs.select(*wanted, locator)
        except AnalysisException:  # files of another format have no row numbers
            pass
    return scratch.written(docs.select(*wanted), "texts").select("doc", "text", locator)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, keep_id, group_size, kept, text_sha256 (hexadecimal)."""
    spark = docs.sparkSession
    with scratch.tables(spark) as kept:
        source = located(docs, id_col, text_col).withColumn("text", normalised(F.col("text")))
        texts = source.select(F.unhex(F.sha2("text", 256)).alias("digest"), "doc", "locator", "text")
        rows = scratch.written(texts.drop("text"), "keys")
        stream = spark.readStream.schema(rows.schema).parquet(rows.scratch_path)
        to = scratch.folder(spark, "state-out")
        first_seen(stream, to, scratch.folder(spark, "state"))
        schema = rows.groupBy("digest").agg(F.expr(_FIRST), F.count("*").alias("n")).schema
        groups = scratch.written(seen(spark, to, schema), "groups")

        hits = scratch.written(groups.where("n > 1").select("digest"), "hits")
        checked = scratch.matched(texts.select("digest", "text"), hits, "digest", "left_semi").groupBy("digest", "text").count()
        collided = scratch.written(checked.groupBy("digest").count().where("count > 1").select("digest"), "collided")
        clashes = not scratch.empty(collided)
        plain = scratch.written(groups.join(collided, "digest", "left_anti"), "plain") if clashes else groups
        kept += [rows, plain]
        found = rows.join(plain, "digest").select("doc", "locator", "first", "n", "digest")
        if clashes:  # digests under which different texts met: told apart by the text
            variant = F.sha2(F.concat("text", F.lit("\0"), F.reverse("text")), 512).alias("variant")
            told = scratch.written(scratch.matched(texts, collided, "digest", "left_semi").select("doc", "locator", "digest", variant), "told")
            apart = scratch.written(told.groupBy("digest", "variant").agg(F.expr(_FIRST), F.count("*").alias("n")), "apart")
            kept += [told, apart]
            found = found.union(told.join(apart, ["digest", "variant"]).select("doc", "locator", "first", "n", "digest"))
    return found.select(
        F.col("doc").alias(id_col), F.col("first.doc").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("locator") == F.col("first.locator")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    with scratch.tables(docs.sparkSession) as kept:
        found = scratch.written(deduplicate(docs, id_col, text_col).select(F.col(id_col).alias("sid"), "kept", F.col("text_sha256").alias("sha")), "found")
        out = found.where("NOT kept").select("sid").distinct()
        both = scratch.written(out.intersect(found.where("kept").select("sid")), "both")
        gone = scratch.written(out.exceptAll(both), "gone")
        stay = scratch.written(scratch.matched(found.where("kept"), both.withColumnRenamed("sid", "bid"), F.expr("sid <=> bid"), "left_semi").select("sid", "sha"), "stay")
        kept += [both, gone, stay]
    out = scratch.matched(docs, gone, docs[id_col].eqNullSafe(gone["sid"]), "left_anti")
    if not scratch.empty(both):  # an id with rows of either sort: told apart by the text
        part = scratch.matched(docs, both, docs[id_col].eqNullSafe(both["sid"]), "left_semi").withColumn("__sha", F.sha2(normalised(F.col(text_col)), 256))
        part = part.join(stay, part[id_col].eqNullSafe(stay["sid"]) & (part["__sha"] == stay["sha"]), "left_semi").dropDuplicates([id_col, "__sha"]).drop("__sha")
        out = scratch.matched(out, both, out[id_col].eqNullSafe(both["sid"]), "left_anti").unionByName(part)
    return out
