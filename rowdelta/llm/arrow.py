"""Helpers for operators that work on Arrow batches in mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of an Arrow batch of documents: one slice or a little less of common texts. Spark's 10,000 are 25 MB of text for each
#: task, held a few times over on both sides of the pipe.
ROWS, ROWS_KEY = 1536, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that a Parquet scan decodes at a time. Spark's 4,096 of texts or hashes lie in arrays of 16 to 32 MB, made anew for each file.
SCANNED, SCANNED_KEY = 512, "spark.sql.parquet.columnarReaderBatchSize"


def bounded(spark: SparkSession) -> None:
    """Sets the rows of batches where the session leaves Spark's defaults; for the session, as results are lazy."""
    for key, default, rows in ((ROWS_KEY, 10_000, ROWS), (SCANNED_KEY, 4096, SCANNED)):
        if int(spark.conf.get(key, str(default))) == default:
            spark.conf.set(key, str(rows))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with about `most` bytes of text each (one long text may be more), null texts as empty bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        start = size = 0
        for i in range(len(batch)):
            size += len(column[i].as_buffer() or b"") if column[i].is_valid else 0
            if size >= most or i == len(batch) - 1:
                part = column.slice(start, i + 1 - start).to_pylist()
                yield batch.slice(start, i + 1 - start), [x or b"" for x in part]
                start, size = i + 1, 0
