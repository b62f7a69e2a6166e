"""Near-duplicate texts by the Jaccard similarity of their word shingles, candidates from SimHash anchors and a prefix filter.

Candidates are the pairs that SimHash's anchors link (fingerprints of the shingles within three bits) and those of prefix
filtering, which misses none: of two sets with at least `least` in common, the first n - ceil(least * n) + 1
shingles of each, in one order for all, share one. The order puts frequent shingles last, then goes by hash, so a common
passage does not gather all texts that have it. Texts that meet at a shingle, have sizes within the ratio and check
bits within MOST become links of a spanning forest, never all pairs. Check bits only spare work: of 256, 31 to 48 differ
on average at 0.8, with a deviation of 6, so MOST lies five deviations above the worst case (sets of four and five). In
3,300 random pairs of 5 to 100 shingles at 0.8 or a little above, at most 66 differed. A pair beyond MOST would be missed.

The forest's components hold all candidate pairs, and within each, whole sets decide. A component of at most MEMBERS
texts is compared in one task. A larger one is dealt in blocks, each beside the component's first text; then what
no block has linked to the component's largest class is compared with all the rest, block by block. A large group of
alike texts thus costs as many comparisons as it has texts, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdelta.llm import arrow, cache, cells, scratch
from rowdelta.llm.components import components

#: Check bits of 256 in which candidates differ at most.
MOST = 80
#: Shingles that come in at least FREQUENT texts go last in the order; the HOT most frequent of them are looked up (a bound
#: of the broadcast: more would be ordered by hash, which costs time and changes no result).
FREQUENT, HOT = 1000, 1 << 16
#: Texts of a block.
MEMBERS = 512


def shingles(text: bytes, size: int) -> tuple[np.ndarray, int]:
    """Distinct hashes in ascending order (a text without words has none), and the fingerprint of all."""
    from rowdelta.llm.simhash import fingerprint_of, shingle_hashes

    every = np.array(shingle_hashes(text, size), np.uint64)
    return np.unique(every), fingerprint_of(every)


def needed(n: int, least: float) -> int:
    return ceil(least * n - 1e-9)


def described(source: DataFrame, size: int) -> DataFrame:
    """(doc, own, digest, n, fp, check, hashes) of (doc, text, own): a digest of the set, its size, fingerprint, check bits and hashes."""
    from rowdelta.llm.simhash import check_bits

    kind = source.schema["doc"].dataType.simpleString()
    arrow.bounded(source.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache.released()
        for part, texts in arrow.slices(batches, most=1 << 20):
            sets, fps = zip(*(shingles(t, size) for t in texts))
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(2), pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
                pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array([check_bits(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
            ], ["doc", "own", "digest", "n", "fp", "check", "hashes"])

    return source.mapInArrow(run, f"doc {kind}, own long, digest binary, n int, fp long, check binary, hashes binary")


def frequent(sets: DataFrame, least: int = FREQUENT, most: int = HOT) -> np.ndarray:
    """Shingles in at least so many texts, ascending; counted over all texts but for what a slice of them has once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                data = b"".join(batch.column(0).slice(at, 4096).to_pylist())
                token, n = np.unique(np.frombuffer(data, np.uint64), return_counts=True)
                token, n = token[n > 1], n[n > 1]
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    found = sets.select("hashes").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = found.orderBy(F.desc("n"), "token").limit(most).select("token")
    return np.sort(np.array([r.token for r in top.collect()], np.int64).view(np.uint64))


def prefix(hashes: np.ndarray, least: float, late: np.ndarray) -> np.ndarray:
    """The first hashes of a set, those in `late` behind all others."""
    n = len(hashes) - needed(len(hashes), least) + 1
    if len(late) and len(hashes):
        behind = late[np.minimum(np.searchsorted(late, hashes), len(late) - 1)] == hashes
        if behind.any():
            hashes = np.concatenate([hashes[~behind], hashes[behind]])
    return hashes[:n]


def tokens(sets: DataFrame, least: float, late: np.ndarray) -> DataFrame:
    """(token, node, n, check): a row for each hash of each set's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                firsts = [prefix(np.frombuffer(h, np.uint64), least, late) for h in part.column(3).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(firsts)), [len(f) for f in firsts]))
                token = np.concatenate(firsts).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token), *(part.column(i).take(rows) for i in range(3))], ["token", "node", "n", "check"])

    return sets.select("node", "n", "check", "hashes").mapInArrow(run, "token long, node long, n int, check binary")


def candidates(points: DataFrame, least: float, limit: int = cells.LIMIT) -> DataFrame:
    """Links (a, b) of a forest over the pairs of (token, node, n, check) that meet at a token and may be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in cells.groups(batches, ["token"]):
            n = t["n"].to_numpy().astype(np.int64)
            sizes = np.diff(np.append(starts, len(n)))
            if not (sizes > 1).any():
                continue
            check = np.frombuffer(b"".join(t["check"].to_pylist()), np.uint64).reshape(len(n), -1)
            low, high, block = cells.unpacked(t["cell"].to_numpy())

            def alike(i, j):
                less, more = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])  # noqa: B023
                return (less >= least * more - 1e-9) & (np.bitwise_count(check[i] ^ check[j]).sum(-1) <= MOST)  # noqa: B023

            two = starts[(sizes == 2) & (low[starts] == high[starts])]
            two = two[alike(two, two + 1)]
            a, b = [two], [two + 1]
            for s, k in zip(starts.tolist(), sizes.tolist()):
                apart = low[s] < high[s]
                if k < 2 or (k == 2 and not apart):
                    continue
                label = np.arange(k)
                for h in range(k - 1):
                    rest = label != label[h]
                    if not rest.any():
                        break
                    if apart:
                        rest &= block[s : s + k] != block[s + h]
                    rest = np.flatnonzero(rest)
                    near = rest[alike(s + h, s + rest)]
                    other, at = np.unique(label[near], return_index=True)
                    if len(other):
                        a.append(np.full(len(at), s + h))
                        b.append(s + near[at])
                        label[np.isin(label, other)] = label[h]
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                node = t["node"].combine_chunks()
                yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], ["a", "b"])

    return cells.gathered(cells.dealt(points, ["token"], "node", limit), ["token"]).mapInArrow(run, "a long, b long")


def forest(sets: list[np.ndarray], least: float, label: np.ndarray | None = None, probes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the pairs of sets that have at least `least` in common.

    label: classes that are one already; probes: of which sets the pairs are looked at.
    """
    n = np.array([len(s) for s in sets], np.int64)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(token, kind="stable")
    row, bounds = row[order], np.searchsorted(token[order], np.arange(token.max(initial=-1) + 2))
    ends, edges = np.cumsum(n), []
    label = np.arange(len(sets)) if label is None else np.unique(label, return_inverse=True)[1]
    for i in range(len(sets) - 1) if probes is None else np.flatnonzero(probes).tolist():
        if (label == label[0]).all():
            break
        low, high = np.minimum(n, n[i]), np.maximum(n, n[i])
        if not ((label != label[i]) & (low >= least * high - 1e-9)).any():
            continue
        own = token[ends[i] - n[i] : ends[i]]
        both = np.bincount(np.concatenate([row[bounds[x] : bounds[x + 1]] for x in own.tolist()]), minlength=len(sets)) if len(own) else np.zeros(len(sets), np.int64)
        near = np.flatnonzero((both >= least * (n + n[i] - both) - 1e-9) & (label != label[i]))
        other, at = np.unique(label[near], return_index=True)
        edges += [(i, j) for j in near[at].tolist()]
        label[np.isin(label, other)] = label[i]
    return edges


def verified(members: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of the pairs of (key, cell, node, class, probe, hashes) within a cell whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, sets = None, [], []

        def links() -> Iterator[pa.RecordBatch]:
            probes = np.array([r[2] for r in rows], bool)
            if len(rows) > 1 and probes.any():
                if edges := forest(sets, least, np.array([r[1] for r in rows]), probes):
                    yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in x], pa.int64()) for x in zip(*edges)], ["a", "b"])

        for batch in batches:
            for i in range(len(batch)):
                key, cell, node, class_, probe, hashes = (batch.column(k)[i].as_py() for k in range(6))
                if (key, cell) != now:
                    yield from links()
                    now, rows, sets = (key, cell), [], []
                rows.append((node, class_, probe))
                sets.append(np.frombuffer(hashes, np.uint64))
        yield from links()

    ordered = members.select("key", "cell", "node", "class", "probe", "hashes").repartition("key", "cell").sortWithinPartitions("key", "cell", "node")
    return ordered.mapInArrow(run, "a long, b long")


def first_round(met: DataFrame, limit: int = MEMBERS) -> DataFrame:
    """(key, cell, node, class, probe) of candidates' components (node, component): a block of each beside its first node."""
    sizes = scratch.written(met.groupBy("component").agg(F.ceil(F.count("*") / limit).alias("blocks")).where("blocks > 1"), "large-components")
    rows = met.select(F.col("component").alias("key"), "node")
    if scratch.empty(sizes):
        return rows.select("key", F.lit(0).cast("long").alias("cell"), "node", F.col("node").alias("class"), F.lit(True).alias("probe"))
    rows = scratch.matched(rows, sizes.withColumnRenamed("component", "key"), ["key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    at = F.when(F.col("node") == F.col("key"), F.expr("sequence(0L, blocks - 1)")).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks"))))
    return rows.select("key", F.explode(at).alias("cell"), "node", F.col("node").alias("class"), F.lit(True).alias("probe"))


def second_round(met: DataFrame, links: DataFrame, limit: int = MEMBERS) -> DataFrame | None:
    """The same for what the first round left open: in large components, texts outside the largest class with all others.

    Cells of a component: each block of the largest class with each block of the rest, and the rest's pairs of blocks.
    """
    large = met.groupBy("component").agg(F.count("*").alias("rows")).where(F.col("rows") > limit)
    large = scratch.written(large.select("component"), "large-components")
    if scratch.empty(large):
        return None
    classes = components(links).withColumnsRenamed({"component": "class"})
    rows = scratch.matched(met, large, "component", "inner").join(classes, "node", "left")
    rows = scratch.written(rows.select(F.col("component").alias("key"), "node", F.coalesce("class", "node").alias("class")), "classes")
    counts = scratch.written(rows.groupBy("key", "class").agg(F.count("*").alias("n")), "class-sizes")
    main = counts.groupBy("key").agg(F.max(F.struct("n", F.negative("class").alias("c"))).alias("m"), F.sum("n").alias("all")).where(F.col("m.n") < F.col("all"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / limit))
    main = scratch.written(main.select("key", F.negative("m.c").alias("main"), blocks(F.col("m.n")).alias("p"), blocks(F.col("all") - F.col("m.n")).alias("q")), "main-classes")
    if scratch.empty(main):
        return None
    rows = scratch.matched(rows, main, ["key"], "inner").withColumn("probe", F.col("class") != F.col("main"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("probe"), F.col("q")).otherwise(F.col("p"))))
    mixed = F.expr("if(probe, transform(sequence(0L, p - 1), i -> i * q + block), transform(sequence(0L, q - 1), j -> block * q + j))")
    rest = F.expr("if(probe, transform(sequence(0L, q - 1), k -> p * q + least(block, k) * q + greatest(block, k)), array())")
    return rows.select("key", F.explode(F.concat(mixed, rest)).alias("cell"), "node", "class", "probe")


def with_hashes(places: DataFrame, has: DataFrame) -> DataFrame:
    """places (with node) with the hashes of (node, hashes); those of nodes without a place are not shuffled."""
    places = scratch.written(places, "places")
    return places.join(scratch.among(has, places.select("node"), "node"), "node")


def labelled(source: DataFrame, size: int, least: float, limit: int = cells.LIMIT, members: int = MEMBERS) -> DataFrame:
    """(doc, own, grp, component) of each row of (doc, text, own): its group and the group's smallest id."""
    from rowdelta.llm import simhash

    with scratch.tables(source.sparkSession) as kept:
        rows = scratch.written(described(source, size).withColumn("row", F.monotonically_increasing_id()), "shingles")
        same = rows.groupBy("digest").agg(F.min("row").alias("node"), F.count("*").alias("n")).where("n > 1").select("digest", "node")
        same = scratch.written(same, "repeated")
        copies = scratch.written(rows.select("row", "digest").join(same, "digest").where("row <> node").select("row", "node"), "copies")
        sets = scratch.among(rows, copies.select("row"), "row", inside=False).withColumnRenamed("row", "node")
        links = candidates(tokens(sets, least, frequent(sets)), least, limit).union(simhash.compared(simhash.placed(sets), limit=limit))
        met = scratch.written(components(links), "candidates")
        has = rows.select(F.col("row").alias("node"), "hashes")
        found = scratch.written(verified(with_hashes(first_round(met, members), has), least), "verified")
        places = second_round(met, found, members)
        if places is not None:
            found = found.union(scratch.written(verified(with_hashes(places, has), least), "verified"))
        nodes = rows.select("row", "doc").join(copies, "row", "left").select(F.coalesce("node", "row").alias("node"), "doc")
        least_ids = scratch.written(nodes.groupBy("node").agg(F.min("doc").alias("least")), "nodes")
        groups = scratch.written(simhash.grouped(least_ids, found), "labels")
        narrow = scratch.written(rows.select("doc", "own", "row").join(copies, "row", "left").select("doc", "own", F.coalesce("node", "row").alias("node")), "rows")
        kept += [narrow, groups]
    return narrow.join(groups, "node").select("doc", "own", "grp", "component")
