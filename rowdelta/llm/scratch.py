"""Written tables that cut lineage, and when they go.

They live under the folder that the cluster names in `spark.checkpoint.dir`, which driver and executors
share, so a lost executor costs only its own tasks. Where that setting is absent (tests, local mode) one
temporary folder per process takes its place.

An operator runs in `tables()`: what it wrote on its way is deleted at its end, but for the tables that its lazy result
still reads. Those, and whatever an error left behind, go when the application ends; `released` deletes them earlier.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: str | None = None
#: Folders made in each `tables()` that is open, the innermost last.
_open: list[list[str]] = []


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, to be filled by the caller."""
    global _local
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if _local is None:
            _local = tempfile.mkdtemp(prefix="rowdelta-")
            atexit.register(shutil.rmtree, _local, ignore_errors=True)
        top = _local
    out = f"{top.rstrip('/')}/rowdelta-{tag}-{uuid.uuid4().hex[:12]}"
    p, fs = _path(spark, out)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    if _open:
        _open[-1].append(out)
    return out


@contextmanager
def tables(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Yields a list for the tables that are to stay; all others written inside are deleted at the end."""
    kept: list[DataFrame] = []
    _open.append([])
    try:
        yield kept
    finally:
        made = _open.pop()
        stay = {t.scratch_path for t in kept if getattr(t, "scratch_path", None)}
        for path in made:
            if path in stay and _open:
                _open[-1].append(path)
            elif path not in stay:
                dropped(spark, path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """For a caller that writes a lazy result elsewhere: everything written inside is deleted at the end."""
    with tables(spark):
        yield


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """df, written once as Parquet and read back; every later use reads the files."""
    spark = df.sparkSession
    path = path or folder(spark, tag)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables that written() made and that no later plan reads."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "scratch_path", None)
        if path:
            p, fs = _path(spark, path)
            fs.delete(p, True)


#: Rows, and bytes of their text form, up to which a written table is sent to every executor; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8 << 20


def few(small: DataFrame) -> bool:
    """Whether a written table is within both bounds of a broadcast."""
    rows, size = small.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in small.columns))))), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def matched(big: DataFrame, small: DataFrame, on: str | Column | list, how: str) -> DataFrame:
    """big joined to a narrow written table: sent to all executors if its counted rows and bytes are few, else shuffled."""
    return big.join(F.broadcast(small) if few(small) else small, on, how)


#: Row numbers of a bitmap.
BITMAP = 8 * 4096


def among(big: DataFrame, places: DataFrame, at: str, group: str | None = None, inside: bool = True) -> DataFrame:
    """Rows of big whose row number `at` (in its `group`) is in the written `places`, or with inside=False is not.

    The places go to all executors as bitmaps, an eighth of a byte for each row that big has, so wide rows stay where they are up to
    some 40 million of them. Bitmaps beyond the bounds of a broadcast are not sent: then big is shuffled. To be read within the `tables` around it.
    """
    keys, place = [group] if group else [], F.pmod(F.col(at), F.lit(BITMAP))
    bits = places.groupBy(*(F.col(k).alias("__group") for k in keys), F.expr(f"`{at}` div {BITMAP}").alias("__part")).agg(F.bitmap_construct_agg(place).alias("b"), F.max(place).alias("m"))
    bits = written(bits.withColumn("__bits", F.expr("substring(b, 1, int(m div 8) + 1)")).drop("b", "m"), "bitmaps")
    if not few(bits):
        return big.join(places, [*keys, at], "left_semi" if inside else "left_anti")
    on = F.expr(f"`{at}` div {BITMAP}") == F.col("__part")
    for k in keys:
        on &= F.col(k) == F.col("__group")
    byte = F.expr(f"int(conv(hex(substring(__bits, int(pmod(`{at}`, {BITMAP}) div 8) + 1, 1)), 16, 10))")
    found = F.coalesce(F.expr(f"shiftright(__byte, int(pmod(`{at}`, 8))) % 2 = 1"), F.lit(False))
    both = big.join(F.broadcast(bits), on, "inner" if inside else "left").withColumn("__byte", byte)
    return both.where(found if inside else ~found).select(*(F.col(f"`{c}`") for c in big.columns))


def empty(df: DataFrame) -> bool:
    return not df.take(1)
