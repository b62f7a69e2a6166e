"""Which rows are on the left only, on the right only, or on both sides, by key or whole row.

Both sides are tagged, put together and grouped by token once. The counters need no rows and are a plan of their
own with partial sums; sections take the first row of each token by `min_by` in the same single shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowdelta.errors import InvalidInputError
from rowdelta.functions.normalize import Normalizer
from rowdelta.operators.duplicates import repeated, surplus
from rowdelta.operators.results import SECTIONS, CompareResult, CompareStats, json_value
from rowdelta.plans import keys, options
from rowdelta.plans.keys import ORDER, ROW, TOKEN, KeySpec


def _counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(token, nl, nr): rows of each token on either side."""
    tagged = a.select(TOKEN, F.lit(1).alias("l")).union(b.select(TOKEN, F.lit(0).alias("l")))
    return tagged.groupBy(TOKEN).agg(F.sum("l").alias("nl"), F.sum(1 - F.col("l")).alias("nr"))


def presence_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of all counters."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    on = {"first": "nl > 0", "second": "nr > 0", "only_first": "nr = 0", "only_second": "nl = 0", "common": "nl > 0 AND nr > 0"}
    found = [n(F.sum(F.expr(f"CAST({e} AS BIGINT)"))).alias(k) for k, e in on.items()]
    return _counts(a, b).agg(n(F.sum("nl")).alias("nl"), n(F.sum("nr")).alias("nr"), *found)


def grouped(a: DataFrame, b: DataFrame) -> DataFrame:
    """(token, nl, nr, first, second, o1, o2): counts, the first row and its place on either side."""
    none = lambda d: F.lit(None).cast(d.schema[ROW].dataType)
    tagged = a.select(TOKEN, F.lit(0).alias("side"), F.col(ORDER).alias("o"), F.col(ROW).alias("x"), none(b).alias("y")).union(
        b.select(TOKEN, F.lit(1), ORDER, none(a), ROW)
    )
    on = lambda e, side: F.expr(f"{e} FILTER (WHERE side = {side})")
    return tagged.groupBy(TOKEN).agg(
        on("count(*)", 0).alias("nl"), on("count(*)", 1).alias("nr"), on("min_by(x, o)", 0).alias("first"), on("min_by(y, o)", 1).alias("second"),
        on("min(o)", 0).alias("o1"), on("min(o)", 1).alias("o2"),
    )


def labelled(first: DataFrame, second: DataFrame, *, key: KeySpec = None, normalizer: Normalizer | None = None, order_by=None, include_common: bool = True) -> DataFrame:
    """(section, columns of either side): one row for each key, all sections in one shuffle, in no order."""
    by_token = grouped(*keys.sides(first, second, key, normalizer, order_by))
    section = F.when(F.col("nr") == 0, "only_in_first").when(F.col("nl") == 0, "only_in_second").otherwise("common")
    here = F.col("nl") > 0
    columns = [*first.columns, *(c for c in second.columns if c not in first.columns)]
    if "section" in columns:
        raise InvalidInputError("a column is named section already")

    def value(c: str) -> Column:
        if c not in second.columns:
            return F.col("first").getField(c)
        other = F.col("second").getField(c)
        return F.when(~here, other) if c not in first.columns else F.when(here, F.col("first").getField(c)).otherwise(other)

    out = by_token if include_common else by_token.where("nl = 0 OR nr = 0")
    return out.select(section.alias("section"), *(value(c).alias(c) for c in columns))


def _rows(df: DataFrame, row: str, order: str, preserve: bool) -> DataFrame:
    return (df.orderBy(order) if preserve else df).select(f"{row}.*")


def compare(first: DataFrame, second: DataFrame, *, key: KeySpec = None, normalizer: Normalizer | None = None, include_common: bool = True, include_duplicates: bool = False, include_stats: bool = True, preserve_order: bool = True, order_by=None, strategy: str = "hash", mode: str = "memory", output=None, **how) -> CompareResult:
    """Compares two tables. Of rows with the same key the first of its side stands for all (see keys.ordered)."""
    plan = options.plan(mode=mode, common=include_common, duplicates=include_duplicates, preserve_order=preserve_order, **how)
    if plan.result_mode == "file" and output is None:
        raise InvalidInputError("result_mode 'file' needs an output")
    a, b = keys.sides(first, second, key, normalizer, order_by)
    if plan.strategy == "hash_partition" and "partition_count" in how:
        a, b = (d.repartition(plan.partition_count, TOKEN) for d in (a, b))
    by_token = grouped(a, b)
    sections = {
        "only_in_first": _rows(by_token.where("nl > 0 AND nr = 0"), "first", "o1", preserve_order),
        "only_in_second": _rows(by_token.where("nl = 0 AND nr > 0"), "second", "o2", preserve_order),
        "common": _rows(by_token.where("nl > 0 AND nr > 0"), "first", "o1", preserve_order) if include_common else None,
        "duplicates_first": surplus(a, preserve_order, plan) if include_duplicates else None,
        "duplicates_second": surplus(b, preserve_order, plan) if include_duplicates else None,
    }

    def count() -> CompareStats:
        if not include_stats:
            return CompareStats()
        n = presence_counts(a, b).first()
        more = (n.nl - n["first"], n.nr - n.second) if include_duplicates else (0, 0)
        return CompareStats(n.nl, n.nr, n["first"], n.second, n.only_first, n.only_second, n.common, *more, mode=plan.backend, strategy=strategy if plan.backend == "memory" else plan.strategy)

    def whole() -> DataFrame:
        rank = F.when(F.col("nr") == 0, 0).when(F.col("nl") == 0, 1).otherwise(2)
        value = F.when(F.col("nl") > 0, json_value(first, "first")).otherwise(json_value(second, "second"))
        out = by_token.select(rank.alias("rank"), F.coalesce("o1", "o2").alias("o"), value.alias("value"))
        out = out if include_common else out.where("rank < 2")
        if include_duplicates:
            for i, (side, df) in enumerate(((a, first), (b, second)), 3):
                out = out.union(repeated(side, plan).select(F.lit(i), ORDER, json_value(df, ROW)))
        section = F.element_at(F.array(*map(F.lit, SECTIONS)), F.col("rank") + 1)
        return (out.orderBy("rank", "o") if preserve_order else out).select(section.alias("section"), "value")

    result = CompareResult(sections, count, {"backend": plan.backend, "strategy": plan.strategy, "plan": plan.metadata(), "result_mode": plan.result_mode}, whole=whole)
    if plan.unsupported:
        result.warnings.append(f"left to the cluster's settings: {', '.join(plan.unsupported)}")
    if output is not None:
        from rowdelta.operators import sinks

        sinks.write_result(result, output)
        result.metadata["output"] = str(output)
    return result


def diff(first: DataFrame, second: DataFrame, **how) -> CompareResult:
    """compare() without the common rows; their count is still there."""
    return compare(first, second, **{"include_common": False} | how)


def unique(first: DataFrame, second: DataFrame, **how) -> DataFrame:
    """Rows of one side only, the left's first; with preserve_order=False in any order, and in one shuffle."""
    if how.get("preserve_order", True) or set(how) - {"preserve_order", "key", "normalizer", "order_by"} or dict(first.dtypes) != dict(second.dtypes) or "section" in first.columns:
        return diff(first, second, **how).unique
    return labelled(first, second, **{k: v for k, v in how.items() if k != "preserve_order"}, include_common=False).drop("section")


def intersection(first: DataFrame, second: DataFrame, **how) -> DataFrame:
    """The left's first row of each key that both sides have."""
    return compare(first, second, **how).common


def compare_by_key(first: DataFrame, second: DataFrame, key: KeySpec, **how) -> CompareResult:
    return compare(first, second, key=key, **{"strategy": "key"} | how)


#: Digests by name; each takes the canonical text of a row.
DIGESTS = {"md5": F.md5, "sha1": F.sha1, "sha224": lambda c: F.sha2(c, 224), "sha256": lambda c: F.sha2(c, 256), "sha384": lambda c: F.sha2(c, 384), "sha512": lambda c: F.sha2(c, 512)}


def _from_hashlib(algorithm: str) -> Callable[[Column], Column]:
    try:
        length = () if hashlib.new(algorithm).digest_size else (32,)  # of digests of any length, 32 bytes
    except ValueError as e:
        raise ValueError(f"no digest {algorithm!r}; there are {', '.join(DIGESTS)} and those of hashlib") from e

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.new(algorithm, t.encode()).hexdigest(*length), na_action="ignore")

    return digest


def row_digest(df: DataFrame, key: KeySpec = None, algorithm: str = "sha256", normalizer: Normalizer | None = None) -> Column:
    """Hexadecimal digest of the canonical JSON of the key, or of the whole row by column name.

    Digests that Spark lacks are hashlib's, in batches of rows sent to Python.
    """
    digest = DIGESTS.get(algorithm) or _from_hashlib(algorithm)
    parts = keys.parts(df, key, normalizer)
    kinds = df.select(*(p.alias(f"k{i}") for i, p in enumerate(parts))).schema
    parts = [keys.aligned(p, f.dataType, p, f.dataType)[0] for p, f in zip(parts, kinds)]
    return digest(F.to_json(F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}))


def compare_by_hash(first: DataFrame, second: DataFrame, *, algorithm: str = "sha256", key: KeySpec = None, normalizer: Normalizer | None = None, **how) -> CompareResult:
    """Rows compared by a digest of their canonical text, one narrow key whatever the width of a row."""
    row_digest(first, key, algorithm, normalizer)
    return compare(first, second, key=lambda df: row_digest(df, key, algorithm, normalizer), **{"strategy": f"hash:{algorithm}"} | how)


compare_iter = compare_streams = compare


def except_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct whole rows of the left that the right lacks."""
    return first.select(sorted(first.columns)).subtract(second.select(sorted(second.columns)))


def intersect_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct whole rows of both sides."""
    return first.select(sorted(first.columns)).intersect(second.select(sorted(second.columns)))


def union_sections(result: CompareResult, names=None) -> DataFrame:
    """(section, value) of the sections named, or of all."""
    rows = result.rows()
    return rows if names is None else rows.where(reduce(Column.__or__, [F.col("section") == n for n in names], F.lit(False)))
