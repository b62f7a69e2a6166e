"""SimHash near-duplicates by anchor points of a covering code.

A pair of 64-bit fingerprints within three bits agrees up to one bit in a 32-bit half. In each half the anchors are the
words of the perfect Hamming code of length 31 with one free bit: covering radius one. Every fingerprint's home is the
anchor within the radius; replicas go to every anchor within the radius plus the half's threshold of one: the
fifteen code words two bits away, and the home with its free bit turned. Of any pair within three bits, one
side's home anchor therefore holds both. At each anchor fingerprints are compared and a spanning forest of the links
is kept, never all pairs, so a group of m alike leaves m - 1 rows. Equal fingerprints are folded beforehand, and an
anchor with very many different ones is compared in cells of two blocks (see cells), each a task's worth.

`survivors` with FIVE_WORDS decides by the words themselves: pairs from the anchors, and those that only a prefix filter
over the shingles finds (three bits are too few for most texts at 0.8), are verified on whole texts.

Cases: a null or empty text has fingerprint zero, linked like any other; texts of one or two words have their
word sequence as the only shingle; rows with a null id are linked like others, but name no group unless it has no
other id; rows of one id with different texts are different documents, rows equal in id and text share their fate; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowdelta.llm import arrow, cells, scratch, shingle_join
from rowdelta.llm.components import components

SHINGLE = 3
SEED = 42
#: Bits in which linked fingerprints may differ: at most three, so that one half differs in at most one.
THRESHOLD = 3
#: 64-bit words of check bits.
CHECK_WORDS = 4


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if len(words) < size:
        return [xxh64_intdigest(b" ".join(words), seed)] if words else []
    return [xxh64_intdigest(b" ".join(words[i : i + size]), seed) for i in range(len(words) - size + 1)]


def fingerprint_of(hashes: np.ndarray) -> int:
    """hashes: unsigned 64-bit; a bit is set where more than half of them have it."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # a long text's bits are laid out in parts
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def check_bits(hashes: np.ndarray) -> bytes:
    """CHECK_WORDS further fingerprints, each of the hashes mixed anew."""
    out = []
    for k in range(CHECK_WORDS):
        h = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(fingerprint_of(h ^ (h >> np.uint64(31))).to_bytes(8, "little"))
    return b"".join(out)


def source_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, own): own tells the texts of one id apart."""
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), own_of(F.col(text_col)).alias("own"))


def own_of(text: Column) -> Column:
    return F.xxhash64(text, text.isNull())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc, own, fp): the fingerprint as a signed 64-bit integer."""
    source = source_of(docs, id_col, text_col)
    arrow.bounded(docs.sparkSession)
    kind = source.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in arrow.slices(batches):
            fps = np.array([fingerprint_of(np.array(shingle_hashes(t, size), np.uint64)) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(fps)], ["doc", "own", "fp"])

    return source.mapInArrow(run, f"doc {kind}, own long, fp long")


_WORD = np.uint64(0x7FFFFFFF)
#: Of the positions 1 to 31, those whose number has bit k set.
_CHECKS = [np.uint64(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)) for k in range(5)]
#: For each syndrome s, the fifteen pairs of positions whose numbers xor to s, as masks to turn.
_PAIRS = np.array([[(1 << (p - 1)) | (1 << ((p ^ s) - 1)) for p in range(1, 32) if p < p ^ s] if s else [0] * 15 for s in range(32)], np.uint64)


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 32-bit words: the home anchor of each, and its 16 further anchors (n x 16); a repeated home means none."""
    word = halves & _WORD
    s = sum((np.bitwise_count(word & m).astype(np.int64) & 1) << k for k, m in enumerate(_CHECKS))
    turned = np.where(s > 0, np.uint64(1) << (np.maximum(s, 1) - 1).astype(np.uint64), np.uint64(0))
    home = halves ^ turned
    further = np.where((s > 0)[:, None], halves[:, None] ^ _PAIRS[s], home[:, None])
    return home, np.column_stack([further, home ^ np.uint64(1 << 31)])


def placed(reps: DataFrame) -> DataFrame:
    """reps (fp, node) to one row (anchor, home, fp, node) for each anchor of each half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 20_000):
                part = batch.slice(i, 20_000)
                fp = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                rows, keys, homes = [], [], []
                for half in (0, 1):
                    home, further = anchors((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF))
                    at, column = np.nonzero(further != home[:, None])
                    tag = np.uint64(half << 32)
                    rows += [np.arange(len(fp)), at]
                    keys += [home | tag, further[at, column] | tag]
                    homes += [np.ones(len(fp), bool), np.zeros(len(at), bool)]
                rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(homes)), *(part.column(i).take(rows) for i in range(2))], ["anchor", "home", "fp", "node"])

    return reps.select("fp", "node").mapInArrow(run, "anchor long, home boolean, fp long, node long")


def forest(fp: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links between points at home and any others, or with blocks those of the other block."""
    label, edges = np.arange(len(fp)), []
    for h in np.flatnonzero(home).tolist():
        near = np.bitwise_count(fp ^ fp[h]) <= threshold
        if block is not None:
            near &= block != block[h]
        near = np.flatnonzero(near)
        other, first = np.unique(label[near], return_index=True)
        new = other != label[h]
        if new.any():
            edges += [(h, x) for x in near[first[new]].tolist()]
            label[np.isin(label, other[new])] = label[h]
    return edges


def compared(points: DataFrame, threshold: int = THRESHOLD, limit: int = cells.LIMIT) -> DataFrame:
    """Links (a, b) between the nodes that meet at an anchor at which one of them is at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in cells.groups(batches, ["anchor"]):
            home, fp = t["home"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
            low, high, block = cells.unpacked(t["cell"].to_numpy())
            sizes = np.diff(np.append(starts, len(fp)))
            some = (sizes > 1) & (np.add.reduceat(home.astype(np.int64), starts) > 0)
            edges = []
            for a, n in zip(starts[some].tolist(), sizes[some].tolist()):
                at = slice(a, a + n)
                edges += [(x + a, y + a) for x, y in forest(fp[at], home[at], threshold, block[at] if low[a] < high[a] else None)]
            if edges:
                node = t["node"].combine_chunks()
                yield pa.RecordBatch.from_arrays([node.take(pa.array(x, pa.int64())) for x in zip(*edges)], ["a", "b"])

    return cells.gathered(cells.dealt(points, ["anchor"], "fp", limit), ["anchor"]).mapInArrow(run, "a long, b long")


def grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Of nodes (node, least) and links (a, b): (node, grp, component), the group's least node and its least id."""
    found = components(links)
    of = scratch.written(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("grp"), "least"), "groups")
    low = scratch.written(of.groupBy("grp").agg(F.min("least").alias("component")), "names")
    return of.select("node", "grp").join(low, "grp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD, limit: int = cells.LIMIT) -> DataFrame:
    """One row for each document: id_col, fp, component (smallest id reachable by links, its own included), own and grp."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the anchors cover thresholds up to {THRESHOLD}")
    with scratch.tables(docs.sparkSession) as kept:
        rows = scratch.written(fingerprints(docs, id_col, text_col, size), "fingerprints")
        reps = scratch.written(rows.groupBy("fp").agg(F.min("doc").alias("least")).withColumn("node", F.monotonically_increasing_id()), "representatives")
        labels = grouped(reps.select("node", "least"), compared(placed(reps), threshold, limit))
        labels = scratch.written(reps.join(labels, "node").select("fp", "grp", "component"), "labels")
        kept += [rows, labels]
    return rows.join(labels, "fp").select(F.col("doc").alias(id_col), "fp", "component", "own", "grp")


#: Settings for texts with at least 0.8 of their five-word shingles in common.
FIVE_WORDS = {"size": 5, "least": 0.8}


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0, **how) -> DataFrame:
    """Of each group the rows of docs with the least id (none last) and one text, with all their columns.

    Groups are those of near_duplicates, or with `least` those of texts that share so much of their shingles.
    """
    with scratch.tables(docs.sparkSession) as kept:
        if least:
            found = shingle_join.labelled(source_of(docs, id_col, text_col), least=least, **how)
        else:
            found = near_duplicates(docs, id_col, text_col, **how).withColumnRenamed(id_col, "doc")
        found = scratch.written(found.select("doc", "own", "grp", F.col("doc").isNull().alias("without")), "found")
        first = scratch.written(found.groupBy("grp").agg(F.min(F.struct("without", "doc", "own")).alias("first")), "firsts")
        both = found.join(first, "grp").where(~F.struct("without", "doc", "own").eqNullSafe(F.col("first")))
        gone = scratch.written(both.select(F.col("doc").alias("sid"), F.col("own").alias("sown")).distinct(), "gone")
        kept.append(gone)
    on = docs[id_col].eqNullSafe(gone["sid"]) & (own_of(docs[text_col]) == gone["sown"])
    return scratch.matched(docs, gone, on, "left_anti")
