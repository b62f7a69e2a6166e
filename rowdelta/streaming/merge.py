"""Comparisons of inputs that are in order of their key: checked order, and results in key order.

Order is checked in parallel: within each partition against the row before, and between partitions by their ends, of
which there is one row each. NULL sorts first. The result is the usual relation, sorted by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowdelta.errors import InvalidInputError
from rowdelta.operators import sinks
from rowdelta.operators.duplicates import repeated
from rowdelta.operators.presence import grouped
from rowdelta.operators.results import json_value
from rowdelta.plans import keys
from rowdelta.plans.keys import ORDER, ROW, TOKEN, KeySpec


def order_violations(df: DataFrame, key: KeySpec, normalizer=None) -> int:
    """Places at which a key is below the one before it, in the order in which Spark reads the rows."""
    placed = keys.side(df, key, normalizer).withColumn("p", F.shiftright(ORDER, 33))
    before = F.lag(TOKEN).over(Window.partitionBy("p").orderBy(ORDER))
    ends = placed.withColumn("down", F.coalesce(before > F.col(TOKEN), F.lit(False))).groupBy("p")
    ends = ends.agg(F.sum(F.col("down").cast("int")).alias("n"), F.min_by(TOKEN, ORDER).alias("low"), F.max_by(TOKEN, ORDER).alias("high"))
    last = F.lag("high").over(Window.orderBy("p"))  # one row for each partition of the input
    return ends.withColumn("gap", F.coalesce(last > F.col("low"), F.lit(False)).cast("int")).agg(F.coalesce(F.sum(F.col("n") + F.col("gap")), F.lit(0))).first()[0]


def require_sorted(df: DataFrame, key: KeySpec, side: str, normalizer=None) -> None:
    try:
        n = order_violations(df, key, normalizer)
    except Exception as e:
        if "ORDERABLE" in str(e) or "ordering" in str(e):
            raise InvalidInputError(f"the {side} input's key has no order") from e
        raise
    if n:
        raise InvalidInputError(f"the {side} input is not sorted by its key ({n} places)")


def sorted_diff(first: DataFrame, second: DataFrame, *, key: KeySpec = None, normalizer=None, include_common: bool = False, include_duplicates: bool = False, validate_sorted: bool = True) -> DataFrame:
    """(section, value) in key order: for each key its presence row, then its duplicates, left before right."""
    if validate_sorted:
        require_sorted(first, key, "first", normalizer), require_sorted(second, key, "second", normalizer)
    a, b = keys.sides(first, second, key, normalizer)
    by_token = grouped(a, b)
    section = F.when(F.col("nr") == 0, "only_in_first").when(F.col("nl") == 0, "only_in_second").otherwise("common")
    value = F.when(F.col("nl") > 0, json_value(first, "first")).otherwise(json_value(second, "second"))
    out = by_token.select(TOKEN, F.lit(0).alias("rank"), F.coalesce("o1", "o2").alias("o"), section.alias("section"), value.alias("value"))
    if not include_common:
        out = out.where("section <> 'common'")
    if include_duplicates:
        for rank, side, df, name in ((1, a, first, "duplicates_first"), (2, b, second, "duplicates_second")):
            out = out.union(repeated(side).select(TOKEN, F.lit(rank), ORDER, F.lit(name), json_value(df, ROW)))
    return out.orderBy(TOKEN, "rank", "o").select("section", "value")


def iter_sorted_diff(first: DataFrame, second: DataFrame, **how) -> Iterator[dict[str, Any]]:
    import json

    for r in sorted_diff(first, second, **how).toLocalIterator():
        yield {"section": r.section, "value": json.loads(r.value)}


compare_sorted_iter = iter_sorted_diff


def write_sorted_diff(first: DataFrame, second: DataFrame, output, **how) -> int:
    """To .jsonl or .csv; the number of rows written."""
    import csv

    kind, n = sinks.suffix(output, ".jsonl", ".csv"), 0
    rows = sorted_diff(first, second, **how)
    with sinks.atomic(Path(output)) as f:
        out = csv.writer(f)
        if kind == ".csv":
            out.writerow(("section", "value"))
        for n, r in enumerate(rows.toLocalIterator(), 1):
            out.writerow((r.section, r.value)) if kind == ".csv" else f.write(f'{{"section":{sinks.dumps(r.section)},"value":{r.value}}}\n')
    return n


def write_sorted_diff_file(first, second, output, *, key: KeySpec = None, read: dict[str, Any] | None = None, **how) -> int:
    """The same for files or other sources (see sources.connectors.connect)."""
    from rowdelta.sources.connectors import connect

    return write_sorted_diff(connect(first, **(read or {})).open(), connect(second, **(read or {})).open(), output, key=key, **how)
