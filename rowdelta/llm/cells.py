"""Groups that are compared pair by pair, dealt over tasks in blocks.

A group of more than LIMIT rows is cut into blocks by a hash of a row's own key, and each pair of blocks is one cell
with a task's worth of work, at most about twice LIMIT rows. A group within the limit is one cell. Every pair of rows of
a group meets in one cell: rows of one block where low = high = block, rows of two blocks elsewhere. Sizes are counted over
all rows, by partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowdelta.llm import scratch

LIMIT = 4096
#: Bits of a block's number in `cell`, which holds the cell's two blocks and then the row's own.
BITS = 21


def dealt(points: DataFrame, keys: list[str], own: Column | str, limit: int = LIMIT) -> DataFrame:
    """points with `cell`: one row for each cell that the row is in."""
    at = points.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > limit)
    large = scratch.written(at.select(*keys, F.ceil(F.col("rows") / limit).alias("blocks")), "large-groups")
    if scratch.empty(large):
        return points.withColumn("cell", F.lit(0).cast("long"))
    rows = scratch.matched(points, large, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(own), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return rows.select(*points.columns, packed(F.least("block", "other"), F.greatest("block", "other"), F.col("block")).alias("cell"))


def packed(low: Column, high: Column, block: Column) -> Column:
    return F.shiftleft(low.cast("long"), 2 * BITS).bitwiseOR(F.shiftleft(high.cast("long"), BITS)).bitwiseOR(block.cast("long"))


def unpacked(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the cell's two blocks, and its own."""
    mask = (1 << BITS) - 1
    return cell >> (2 * BITS), (cell >> BITS) & mask, cell & mask


def gathered(dealt_: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a cell side by side."""
    return dealt_.repartition(*keys, F.shiftright("cell", BITS)).sortWithinPartitions(*keys, "cell")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """What `gathered` brings, cut between its cells: (table, starts of its cells)."""
    held: list[pa.RecordBatch] = []

    def starts(t) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[0] = True
        for k in keys:
            v = t[k].to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        v = t["cell"].to_numpy() >> BITS
        new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def place(batch: pa.RecordBatch, i: int) -> tuple:
        return (*(batch[k][i].as_py() for k in keys), batch["cell"][i].as_py() >> BITS)

    def table(rows: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(rows).combine_chunks()
        return t, starts(t)

    for batch in batches:
        if not len(batch):
            continue
        cut = int(starts(batch)[-1])
        goes_on = bool(held) and place(held[-1], len(held[-1]) - 1) == place(batch, 0)
        if cut and goes_on:
            held.append(batch.slice(0, cut))
        if held and (cut or not goes_on):
            yield table(held)
            held = []
        if cut and not goes_on:
            yield table([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield table(held)
