"""Rows beyond the first of their key.

The first place of each token is a partial aggregate; rows are joined to it and kept where they come later. A key with
a third of all rows thus makes a skewed join, which adaptive execution splits, and no window over one partition.
Without `order_by` a row's place is where Spark reads it, so the input has to be a deterministic one (a scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdelta.functions.normalize import Normalizer
from rowdelta.plans import keys, options
from rowdelta.plans.keys import ORDER, ROW, TOKEN, KeySpec


def surplus(a: DataFrame, preserve_order: bool = True, plan: options.Plan | None = None) -> DataFrame:
    """Of a prepared side (see keys.side), the rows after the first of their token."""
    later = repeated(a, plan)
    return (later.orderBy(ORDER) if preserve_order else later).select(f"{ROW}.*")


def repeated(a: DataFrame, plan: options.Plan | None = None) -> DataFrame:
    """The same as (token, order, row)."""
    first = a.groupBy(TOKEN).agg(F.min(ORDER).alias("o"), F.count("*").alias("n")).where("n > 1").select(F.col(TOKEN).alias("t"), "o")
    on = [a[TOKEN].getField(f.name).eqNullSafe(first["t"].getField(f.name)) for f in a.schema[TOKEN].dataType.fields]
    return a.join(first if plan is None else plan.hinted(first), on, "inner").where(F.col(ORDER) > F.col("o")).select(TOKEN, ORDER, ROW)


def duplicates(df: DataFrame, *, key: KeySpec = None, normalizer: Normalizer | None = None, order_by=None, preserve_order: bool = True, mode: str = "memory", **how) -> DataFrame:
    """Every occurrence after the first, in input order."""
    plan = options.plan(mode=mode, **how)
    return surplus(keys.side(df, key, normalizer, order_by), preserve_order, plan)


def duplicate_groups(df: DataFrame, *, key: KeySpec = None, normalizer: Normalizer | None = None) -> DataFrame:
    """(key columns, count) of the keys with more than one row."""
    named = keys.names(key) or (sorted(df.columns) if key is None else ["value"])
    parts = [p.alias(n) for p, n in zip(keys.parts(df, key, normalizer), named)]
    return df.select(*parts).groupBy(*(F.col(f"`{n}`") for n in named)).agg(F.count("*").alias("count")).where("count > 1")
