"""Near-duplicate embeddings by spherical-cap filters.

Filter directions are a structured random product code: the turned vector is cut into blocks, each block has a small
random code, and a direction is any choice of one code word for each block. A vector is list-decoded to all
directions whose inner product exceeds its cap, which lies half a standard deviation below its best direction:
partial sums are extended block by block and dropped as soon as the best rest can't reach the cap. Vectors of one label that share a filter are compared in double precision. A
pair counts at the first filter that it shares, so links are summed without a table of pairs, and each group leaves
a spanning forest. Equal vectors are folded first and weigh as many as they are.

The inner products of two vectors at cosine 0.98 with one direction differ by about 0.2 standard deviations, so each
nearly always holds the other's best direction. A vector has about 20 filters, whatever their number; the number of directions
follows from the counted vectors of the largest label, so that a group of unlike vectors holds GROUP or so at any size of
the table (recall is measured in the tests, for several settings). A group of very many alike vectors is
compared in cells of two blocks (see cells), each a task's worth.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link
with nothing; a null id names no group; vectors of other lengths never link; repeated rows link with each other; an empty table gives no
rows; other columns are ignored, whatever their names. Vectors are scaled by a power of two first, so none is too large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdelta.llm import cells, scratch
from rowdelta.llm.simhash import grouped

COSINE = 0.98
BLOCKS = 3
#: Code words of a block at least.
WORDS = 16
#: Filters of a vector, about, and vectors of a group that are aimed at.
LISTED, GROUP = 20, 250
#: How far the cap lies below the best direction, in standard deviations of the inner product with a random one.
GAP = 0.5
SEED = 7
#: Rows of a group that are compared with the whole group at once.
STRIPE = 256
#: Vectors of a block in a cell.
LIMIT = 2048


def words_for(vectors: int, blocks: int = BLOCKS) -> int:
    """Code words of a block for so many vectors of one label."""
    n = int(np.ceil((vectors * LISTED / GROUP) ** (1 / blocks)))
    return max(WORDS, n)


class ProductCode:
    def __init__(self, dim: int, blocks: int = BLOCKS, words: int = WORDS, gap: float = GAP, seed: int = SEED):
        rng = np.random.default_rng([seed, dim])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.blocks, self.words = min(blocks, dim), words
        self.cut = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cut, self.cut[1:]):
            c = rng.standard_normal((words, b - a))
            self.codes.append((c / np.linalg.norm(c, axis=1, keepdims=True)).T)
        self.gap = gap * np.sqrt(self.blocks / dim)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters in each row's cap, in order of row and filter."""
        x = unit @ self.turn
        scores = [x[:, a:b] @ c for a, b, c in zip(self.cut, self.cut[1:], self.codes)]
        best = np.array([s.max(1) for s in scores])
        least = best.sum(0) - self.gap - 1e-12
        row, filter_, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for k, s in enumerate(scores):
            sums = total[:, None] + s[row]
            at, word = np.nonzero(sums + best[k + 1 :].sum(0)[row][:, None] >= least[row][:, None])
            row, filter_, total = row[at], filter_[at] * self.words + word, sums[at, word]
        return row, filter_


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a power of two is taken out first, which rounds nothing."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def placed(reps: DataFrame, **code) -> DataFrame:
    """reps (label, vector, node, n) to one row for each filter of each vector."""
    kinds = {f.name: f.dataType.simpleString() for f in reps.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                sizes = np.diff(part.column(1).offsets.to_numpy())
                for dim in np.unique(sizes).tolist():
                    mine = np.flatnonzero(sizes == dim)
                    if dim not in codes:
                        codes[dim] = ProductCode(dim, **code)
                    row, filter_ = codes[dim].decode(units(_matrix(part.column(1).take(pa.array(mine)), dim)))
                    lists = np.split(filter_, np.flatnonzero(np.diff(row)) + 1)
                    rows = pa.array(mine[row])
                    yield pa.RecordBatch.from_arrays([*(part.column(i).take(rows) for i in range(4)), pa.array(np.full(len(rows), dim, np.int32)), pa.array(filter_), pa.array(lists, pa.list_(pa.int64())).take(pa.array(row))], ["label", "vector", "node", "n", "dim", "filter", "filters"])

    return reps.select("label", "vector", "node", "n").mapInArrow(run, f"label {kinds['label']}, vector {kinds['vector']}, node long, n long, dim int, filter long, filters array<bigint>")


def spanning(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (a, b) that make a spanning forest of them all; label, each row's class, is brought up to date.

    In each round every class takes its first pair to another class, and classes join, as in Boruvka's method.
    """
    taken = []
    while True:
        x, y = label[a], label[b]
        open_ = np.flatnonzero(x != y)
        if not len(open_):
            return np.array(taken, np.int64)
        low, high = np.minimum(x[open_], y[open_]), np.maximum(x[open_], y[open_])
        _, first = np.unique(high, return_index=True)  # a class hangs below a lower one, so there are no rings
        taken += open_[first].tolist()
        to = np.arange(len(label))
        to[high[first]] = low[first]
        while not np.array_equal(after := to[to], to):
            to = after
        label[:] = to[label]


def group_links(unit: np.ndarray, weight: np.ndarray, filters: list[np.ndarray], here: int, cosine: float, block: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of the pairs whose first shared filter is this one: each row's linked weight, and a spanning forest. With blocks, pairs of two."""
    n, total, edges, label, member = len(unit), np.zeros(len(unit), np.int64), [], np.arange(len(unit)), None
    for at in range(0, n, STRIPE):
        near = unit[at : at + STRIPE] @ unit.T >= cosine
        near[np.arange(len(near)), np.arange(at, at + len(near))] = False
        if block is not None:
            near &= block[at : at + STRIPE, None] != block
        if not near.any():
            continue
        if member is None:
            rows = np.repeat(np.arange(n), [len(f) for f in filters])
            all_ = np.concatenate(filters)
            rows, all_ = rows[all_ < here], all_[all_ < here]
            number, column = np.unique(all_, return_inverse=True)
            member = np.zeros((n, len(number)), np.float32)
            member[rows, column] = 1
        near &= member[at : at + STRIPE] @ member.T == 0
        total[at : at + STRIPE] = near @ weight
        i, j = np.nonzero(near)
        i, j = i[i + at < j] + at, j[i + at < j]
        new = spanning(i, j, label)
        edges += zip(i[new].tolist(), j[new].tolist())
    return total, edges


def linked(points: DataFrame, cosine: float = COSINE, limit: int = LIMIT) -> DataFrame:
    """(a, b, links): for each group, a's linked weight with b null, and forest links (a, b) with links null."""
    keys = ["label", "dim", "filter"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in cells.groups(batches, keys):
            dim, here, weight = (t[k].to_numpy() for k in ("dim", "filter", "n"))
            low, high, block = cells.unpacked(t["cell"].to_numpy())
            node, vectors, filters = (t[k].combine_chunks() for k in ("node", "vector", "filters"))
            a, b, links = [], [], []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(dim)]):
                if end - start < 2:
                    continue
                at = slice(start, end)
                lists = filters.slice(start, end - start)
                lists = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
                unit = units(_matrix(vectors.slice(start, end - start), int(dim[start])))
                total, edges = group_links(unit, weight[at], lists, int(here[start]), cosine, block[at] if low[start] < high[start] else None)
                some = np.flatnonzero(total)
                a += (some + start).tolist() + [e[0] + start for e in edges]
                b += [None] * len(some) + [e[1] + start for e in edges]
                links += total[some].tolist() + [None] * len(edges)
            if a:
                yield pa.RecordBatch.from_arrays([node.take(pa.array(a, pa.int64())), node.take(pa.array(b, pa.int64())), pa.array(links, pa.int64())], ["a", "b", "links"])

    return cells.gathered(cells.dealt(points, keys, "vector", limit), keys).mapInArrow(run, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, limit: int = LIMIT, **code) -> DataFrame:
    """One row for each vector: id_col, n_links, component (smallest id reachable, its own included)."""
    with scratch.tables(vectors.sparkSession) as kept:
        rows = scratch.written(vectors.select(F.col(id_col).alias("vec"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")), "vectors")
        finite = "forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(CAST(x AS DOUBLE)) < double('Infinity')) AND exists(vector, x -> x <> 0)"
        fit = F.expr(f"coalesce(label IS NOT NULL AND vector IS NOT NULL AND {finite}, false)")
        reps = rows.where(fit).groupBy("label", "vector").agg(F.min("vec").alias("least"), F.count("*").alias("n"))
        reps = scratch.written(reps.withColumn("node", F.monotonically_increasing_id()), "distinct")
        largest = reps.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        out = scratch.written(linked(placed(reps, **({"words": words_for(largest)} | code)), cosine, limit), "links")
        links = out.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        parts = grouped(reps.select("node", "least"), out.where("b IS NOT NULL").select("a", "b"))
        known = reps.join(links, "node", "left").join(parts, "node").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component")
        known = scratch.written(known, "known")
        kept += [rows, known]
    good = rows.where(fit).join(known, ["label", "vector"]).select("vec", "n_links", "component")
    bad = rows.where(~fit).select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component"))
    return good.union(bad).withColumnRenamed("vec", id_col)
