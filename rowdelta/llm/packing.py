"""Harmonic packing of token sequences.

A document is cut into pieces whose lengths are the reciprocal sizes floor(C / i) of the capacity C: whole
capacities first, then greedily the largest reciprocal size that fits, and at last a short tail. Pieces of one
length form a class; a bin of that class holds exactly floor(C / length) of them, so bins of a class are filled
by count alone, with less than one piece's rounding left over. Every worker fills its own bins; no row moves.
The pieces in a worker's unfilled bins at its end are laid end to end and cut at the capacity, the last rest into
powers of two, so nothing but the rounding inside full bins is padding.

A worker holds the pieces of its open bins only: at most one bin for each class.

Cases: a null or empty text is the end id alone; null ids of documents are kept; repeated rows are packed as often
as they come; an empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdelta.llm import arrow, tokens

CAPACITY = 4096
END_ID = 2
#: Reciprocals up to this one cut a document further; what is shorter than the last of them is its tail.
RECIPROCALS = 64

FIELDS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int = CAPACITY, reciprocals: int = RECIPROCALS) -> list[int]:
    """Piece lengths for n tokens, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        i = -(-capacity // n)
        out.append(capacity // i if i <= reciprocals else n)
        n -= out[-1]
    return out


class Worker:
    """Bins of one task. add() and end() give rows (doc, start, length, ids, doc_tokens, sequence, offset)."""

    def __init__(self, number: int, capacity: int = CAPACITY):
        self.next, self.capacity, self.open = number << 40, capacity, {}

    def _filled(self, pieces: list[tuple]) -> list[tuple]:
        rows, at = [], 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            rows.append((doc, start, n, ids, total, self.next, at))
            at += n
        self.next += 1
        return rows

    def add(self, doc, ids: bytes) -> list[tuple]:
        rows, at, total = [], 0, len(ids) // 4
        for n in cuts(total, self.capacity):
            held = self.open.setdefault(n, [])
            held.append((doc, at, ids[at * 4 : (at + n) * 4], total))
            at += n
            if len(held) == self.capacity // n:
                rows += self._filled(self.open.pop(n))
        return rows

    def end(self) -> list[tuple]:
        rest = [p for n in sorted(self.open) for p in self.open[n]]
        self.open, rows, held, room = {}, [], [], self.capacity
        left = sum(len(p[2]) for p in rest) // 4
        room = self._room(left)
        for doc, start, ids, total in rest:
            while ids:
                n = min(room, len(ids) // 4)
                held.append((doc, start, ids[: n * 4], total))
                start, ids, room, left = start + n, ids[n * 4 :], room - n, left - n
                if not room:
                    rows += self._filled(held)
                    held, room = [], self._room(left)
        return rows

    def _room(self, left: int) -> int:
        """Length of the next sequence: the capacity, or the largest power of two in what is left."""
        return self.capacity if left >= self.capacity else 1 << max(0, left.bit_length() - 1)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", words: int = tokens.CACHE_PIECES) -> DataFrame:
    """One row for each piece: id_col, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    words: those whose ids a worker keeps; fewer take less memory and more time.
    """
    path = vocabulary or tokens.vocabulary()
    end = int(end_id).to_bytes(4, "little")
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, worker = tokens.encoder(path, words), Worker(TaskContext.get().partitionId(), capacity)
        doc_type = None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*rows))
            longs = lambda x: pa.array(np.array(x, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(c[0], doc_type), longs(c[1]), longs(c[2]), pa.array(c[3], pa.binary()), longs(c[4]), longs(c[5]), longs(c[6])], ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for part, texts in arrow.slices(batches, most=min(4 << 20, 5 * words)):  # a slice's words are all held
            doc_type = part.column(0).type
            rows = []
            for doc, ids in zip(part.column(0).to_pylist(), encoder.packed(texts)):
                rows += worker.add(doc, ids + end)
            if rows:
                yield table(rows)
        if rows := worker.end():
            yield table(rows)

    return source.mapInArrow(run, f"doc {kind}, {FIELDS}").withColumnRenamed("doc", id_col)
