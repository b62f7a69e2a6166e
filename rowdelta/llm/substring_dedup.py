"""Repeated passages by content-defined chunks.

A gear hash rolls over the bytes of a text; where its value meets a mask, a segment may end, so cut points depend on
the last bytes alone and come back into step after an insertion. A chunk is SPAN segments end to end, one from each
cut point on, so short segments place it finely and yet texts do not share it by chance. Chunks are deduplicated by a
128-bit digest: of its occurrences, the one in the document of least id, and there the first, is kept. Elsewhere it counts where it
lies in a run of chunks kept elsewhere, each one segment after the other, of at least WORDS words; shorter runs (a common
line, a phrase) are left alone. What is cut never touches a kept occurrence, so a kept copy of every chunk stays whole.

Chunks are made once and written. Counting a digest is a partial aggregate, so a passage that a third of all
documents share is one row for each task; finding its occurrences is a join of two written tables on the digest, which adaptive
execution splits where it is skewed.

Cases: a null or empty text has no chunks; rows are told apart by themselves, whatever their ids, so equal rows and rows
of one id are copies of each other, null ids come last; a passage repeated within one text is cut from its second occurrence on;
an empty table gives no rows; other columns are ignored, whatever their names. Spans are UTF-8 bytes, end exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdelta.llm import arrow, scratch

#: Bytes of a segment, and of the window that the hash sees (not above the smallest segment).
SMALLEST, LARGEST, WINDOW = 24, 256, 16
#: Bits of the hash that are zero at a cut point: one byte in 8. Bits from WINDOW up depend on the whole window.
MASK = np.uint32(0b111 << 20)
#: Segments of a chunk.
SPAN = 3
#: Words of a run of repeated chunks that is reported. A passage loses up to a segment at either end, about five words.
WORDS = 32

#: A passage may be laid out in other lines: each white-space byte counts as a space, at its place.
BLANK = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))

GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4, person=b"gear").digest(), "little") for b in range(256)], np.uint32)


def candidates(data: np.ndarray) -> np.ndarray:
    """Ends (exclusive) after which the hash of the last WINDOW bytes meets the mask."""
    h, width = GEAR[data], 1
    while width < WINDOW:  # the sum of gear values shifted by age, by doubling the window
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return np.flatnonzero((h & MASK) == 0) + 1


def segment_ends(size: int, ends: list[int]) -> list[int]:
    """Segment ends of a text of that size from its candidates."""
    out, start = [], 0
    for e in ends:
        while e - start > LARGEST:
            start += LARGEST
            out.append(start)
        if e - start >= SMALLEST:
            out.append(e)
            start = e
    while size - start > LARGEST:
        start += LARGEST
        out.append(start)
    if size > start:
        out.append(size)
    return out


def segmented(texts: list[bytes]) -> list[list[int]]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return [[] for _ in texts]
    ends = candidates(data)
    starts = np.cumsum([0, *map(len, texts)])
    at = np.searchsorted(ends, starts, side="right")
    return [segment_ends(len(t), (ends[i:j] - s).tolist()) for t, s, i, j in zip(texts, starts, at, at[1:])]


def words_before(data: bytes) -> np.ndarray:
    """How many words start before each byte of a text whose white space is spaces, and before its end."""
    solid = np.frombuffer(data, np.uint8) != 32
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    return np.concatenate([[0], np.cumsum(starts)])


CHUNK = "d1 long, d2 long, k int, start long, size int, words int"


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(row, doc, d1, d2, k, start, size, words): every chunk, to be written once.

    row is a number of each row's own, or row_col; k numbers the segments; words are (in the first segment << 16) + in all.
    """
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    source = docs.select(number.alias("row"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for part, texts in arrow.slices(batches, most=2 << 20):
            texts = [t.translate(BLANK) for t in texts]
            of, digests, columns = [], [], []
            for i, (t, ends) in enumerate(zip(texts, segmented(texts))):
                if not ends:
                    continue
                cuts = np.array([0, *ends])
                first = np.arange(max(1, len(ends) - SPAN + 1))
                start, end = cuts[first], cuts[np.minimum(first + SPAN, len(ends))]
                count = words_before(t)[cuts]
                inside, here = count[np.minimum(first + SPAN, len(ends))] - count[first], count[first + 1] - count[first]
                of.append(np.full(len(first), i))
                digests += [xxh3_128_digest(t[a:b]) for a, b in zip(start.tolist(), end.tolist())]
                columns.append(np.stack([first, start, end - start, (here << 16) | inside]))
            if of:
                d, of, c = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), np.concatenate(of), np.concatenate(columns, 1)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)), pa.array(d[:, 0]), pa.array(d[:, 1]),
                    pa.array(c[0].astype(np.int32)), pa.array(c[1]), pa.array(c[2].astype(np.int32)), pa.array(c[3].astype(np.int32)),
                ], ["row", "doc", "d1", "d2", "k", "start", "size", "words"])

    return source.mapInArrow(run, f"row long, doc {kind}, {CHUNK}")


def runs(hits: list[dict], least: int = WORDS) -> list[tuple[int, int, int, object]]:
    """(start, end, chunks, first) of what is to go among one text's shared chunks, which come in order of k.

    own marks the chunks of which this text is the one that keeps them: of these, all but the first of each digest go too.
    """
    seen, keeps = set(), []
    for h in hits:
        keeps.append(h["own"] and h["d1"] not in seen)
        seen.add(h["d1"])
    stops, stop = [], None  # where the next kept chunk starts
    for h, keep in zip(reversed(hits), reversed(keeps)):
        stops.append(stop)
        stop = h["start"] if keep else stop
    stops.reverse()
    out, kept, i = [], 0, 0  # kept: where the last kept chunk ends
    while i < len(hits):
        j = i + 1
        if keeps[i]:
            kept = hits[i]["start"] + hits[i]["size"]
        else:
            while j < len(hits) and not keeps[j] and hits[j]["k"] == hits[j - 1]["k"] + 1:
                j += 1
            run, last = hits[i:j], hits[j - 1]
            if sum(h["words"] >> 16 for h in run[:-1]) + (last["words"] & 0xFFFF) >= least:
                start, end = max(kept, run[0]["start"]), last["start"] + last["size"]
                end = end if stops[j - 1] is None else min(end, stops[j - 1])
                if start < end:
                    out.append((start, end, len(run), run[0]["first"]))
        i = j
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = WORDS, row_col: str | None = None) -> DataFrame:
    """One row for each repeat to take out: id_col, start, end, chunks, first_id (document that keeps its first chunk), row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                if found := runs(batch.column(2)[i].as_py(), least):
                    c, at = list(zip(*found)), pa.array([i] * len(found))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], batch.column(1).type)], ["row", "doc", "start", "end", "chunks", "first_id"])

    with scratch.tables(docs.sparkSession) as kept:
        every = scratch.written(chunks(docs, id_col, text_col, row_col), "chunks")
        first = F.min(F.struct(F.col("doc").isNull().alias("without"), "doc", "row")).alias("first")
        shared = every.groupBy("d1", "d2").agg(first, F.count("*").alias("n")).where("n > 1")
        shared = scratch.written(shared.select("d1", "d2", F.col("first.doc").alias("first"), F.col("first.row").alias("keeper")), "shared")
        hits = scratch.matched(every, shared, ["d1", "d2"], "inner")
        hit = F.struct("k", "start", "size", "words", "d1", (F.col("row") == F.col("keeper")).alias("own"), "first")
        by_row = hits.groupBy("row", "doc").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
        out = scratch.written(by_row.mapInArrow(run, f"row long, doc {kind}, start long, end long, chunks long, first_id {kind}"), "passages")
        kept.append(out)
    return out.select(F.col("doc").alias(id_col), "start", "end", "chunks", "first_id", "row")


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = WORDS) -> DataFrame:
    """docs with the repeats cut from their texts; documents without any are left as they are.

    The rows are written once with a number of their own, by which the cuts find them again. Cuts keep to whole characters.
    """
    schema = docs.schema
    at = schema.names.index(text_col)
    with scratch.tables(docs.sparkSession) as kept:
        whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.monotonically_increasing_id().alias("row"))
        table = scratch.written(whole, "rows")
        flat = table.select(F.col(f"whole.`{id_col}`").alias("doc"), F.col(f"whole.`{text_col}`").alias("text"), "row")
        spans = repeated_passages(flat, "doc", "text", least, "row").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
        cuts = scratch.written(spans, "cuts")
        kept += [table, cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in arrow.slices(batches, "text"):
            columns = list(part.column(0).flatten())
            out = []
            for text, spans in zip(texts, part.column(2).to_pylist()):
                for s in reversed(spans or ()):
                    a, b = s["start"], s["end"]
                    while a < b and text[a] & 0xC0 == 0x80:
                        a += 1
                    while a < b < len(text) and text[b] & 0xC0 == 0x80:
                        b -= 1
                    text = text[:a] + text[b:]
                out.append(text.decode())
            columns[at] = pa.array([t if valid else None for t, valid in zip(out, columns[at].is_valid().to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    joined = scratch.matched(table, cuts, "row", "left").select("whole", F.col(f"whole.`{text_col}`").alias("text"), "spans")
    return joined.mapInArrow(run, schema)
