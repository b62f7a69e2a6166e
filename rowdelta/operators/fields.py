"""Which fields changed for rows that share a key.

The right's first row of each key is joined to every left row (or, in the sorted variant, to the left's first). Values are
compared in their own types; what is reported is their text, so that one array holds changes of any type.
A normaliser works on values here, never on the key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowdelta.errors import InvalidInputError
from rowdelta.functions.normalize import Normalizer
from rowdelta.functions.sizes import parse_size
from rowdelta.plans import keys
from rowdelta.plans.keys import ORDER, ROW, TOKEN, KeySpec

STREAMED = "rows were written to the output and are not held in the result"
TRUNCATED = "some changed rows were left out because of a limit"
REPEATED = "the right side has several rows for some keys; the first of each was compared"
UNCOUNTED = "row counts are not computed for sorted comparisons"


@dataclass(frozen=True)
class FieldChange:
    field: str
    left: Any
    right: Any

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


@dataclass(frozen=True)
class FieldDiffStats:
    first_count: int = 0
    second_count: int = 0
    compared_count: int = 0
    changed_row_count: int = 0
    changed_field_count: int = 0
    emitted_row_count: int = 0
    output_bytes: int = 0
    truncated: bool = False

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def compared_columns(first: DataFrame, second: DataFrame, key: KeySpec, columns: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> list[str]:
    """Sorted names. Key columns are left out only where no columns are named; an empty list compares nothing."""
    chosen = set(first.columns) | set(second.columns) if columns is None else {c.strip() for c in columns if c.strip()}
    out = {c.strip() for c in exclude or ()}
    return sorted(chosen - out - (set(keys.names(key)) if columns is None else set()))


def read_columns(columns: Sequence[str] | None, key: KeySpec) -> list[str] | None:
    """Columns to read: those named and the key's."""
    return None if columns is None else list(dict.fromkeys([*columns, *keys.names(key)]))


def _text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType | T.ArrayType | T.MapType | T.VariantType):
        return F.when(c.isNotNull(), F.to_json(c))
    return F.hex(c) if isinstance(kind, T.BinaryType) else c.cast("string")


def _first_rows(a: DataFrame) -> DataFrame:
    return a.groupBy(TOKEN).agg(F.min_by(ROW, ORDER).alias(ROW), F.min(ORDER).alias(ORDER), F.count("*").alias("n"))


def field_changes(first: DataFrame, second: DataFrame, *, key: KeySpec, columns=None, exclude_columns=None, normalizer: Normalizer | None = None, order_by=None, nan_equal: bool = True, first_only: bool = False, keep_missing: bool = False) -> DataFrame:
    """(__token, __order, key, changes) of every compared pair of rows; changes are (field, left, right), maybe none.

    keep_missing keeps what is on one side only too, with `side` left or right and no changes.
    """
    if key is None:
        raise InvalidInputError("a field comparison needs a key")
    a, b = keys.sides(first, second, key, None, order_by)
    if first_only:
        a = _first_rows(a).drop("n")
    b = _first_rows(b).select(F.col(TOKEN).alias("t"), F.col(ROW).alias("r"), F.col(ORDER).alias("o2"))
    on = [a[TOKEN].getField(f.name).eqNullSafe(b["t"].getField(f.name)) for f in a.schema[TOKEN].dataType.fields]
    pairs = a.withColumn("here", F.lit(True)).join(b.withColumn("there", F.lit(True)), on, "full" if keep_missing else "inner")
    items = []
    for name in compared_columns(first, second, key, columns, exclude_columns):
        side = lambda row, d: (F.col(row).getField(name), d.schema[name].dataType) if name in d.columns else (F.lit(None).cast("string"), T.NullType())  # noqa: B023, E731
        (x, xk), (y, yk) = side(ROW, first), side("r", second)
        u, v = (x, y) if normalizer is None else (normalizer(x), normalizer(y))
        u, v, alike = keys.aligned(u, xk, v, yk) if normalizer is None else (u, v, True)
        same = u.eqNullSafe(v) if alike else (x.isNull() & y.isNull())
        if not nan_equal and isinstance(xk, T.DoubleType | T.FloatType):
            same = same & ~F.coalesce(F.isnan(x), F.lit(False))
        items.append(F.when(~same, F.struct(F.lit(name).alias("field"), _text(x, xk).alias("left"), _text(y, yk).alias("right"))))
    kind = "array<struct<field:string,left:string,right:string>>"
    changes = F.filter(F.array(*items), lambda c: c.isNotNull()).cast(kind) if items else F.array().cast(kind)
    named = keys.names(key)
    if named:
        shown = [F.coalesce(F.col(ROW).getField(n).cast(first.schema[n].dataType), F.col("r").getField(n).cast(first.schema[n].dataType)).alias(n) if n in first.columns and n in second.columns else F.col(TOKEN).getField(f"k{i}").alias(n) for i, n in enumerate(named)]
    else:
        shown = [F.coalesce(F.col(TOKEN), F.col("t")).getField("k0").alias("value")]
    out = [F.coalesce(F.col(TOKEN), F.col("t")).alias(TOKEN), F.coalesce(F.col(ORDER), F.col("o2")).alias(ORDER), F.struct(*shown).alias("key"), changes.alias("changes")]
    if keep_missing:
        out[3] = F.when(F.col("here") & F.col("there"), changes).otherwise(F.array().cast(kind)).alias("changes")
        out.append(F.when(F.col("there").isNull(), "left").when(F.col("here").isNull(), "right").otherwise("both").alias("side"))
    return pairs.select(*out)


@dataclass
class FieldDiffResult:
    """rows: (key, changes) of the changed rows in left order; changes: one row for each changed field."""

    pairs: DataFrame
    counts: Callable[[], dict[str, int]]
    max_rows: int | None = None
    metadata: dict[str, Any] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    written: tuple[int, int, bool] | None = None

    @property
    def _changed(self) -> DataFrame:
        return self.pairs.where(F.size("changes") > 0)

    @property
    def rows(self) -> DataFrame:
        out = self._changed.orderBy(ORDER)
        return (out if self.max_rows is None else out.limit(self.max_rows)).select("key", "changes")

    @property
    def changes(self) -> DataFrame:
        return self.rows.select("key.*", F.inline("changes"))

    @property
    def by_column(self) -> DataFrame:
        """(field, n), over all changed rows, limited or not."""
        return self._changed.select(F.inline("changes")).groupBy("field").agg(F.count("*").alias("n"))

    @cached_property
    def summary_by_column(self) -> dict[str, int]:
        return {r["field"]: r["n"] for r in self.by_column.orderBy("field").collect()}

    @cached_property
    def stats(self) -> FieldDiffStats:
        n = self.counts()
        emitted = n["changed"] if self.max_rows is None else min(self.max_rows, n["changed"])
        rows, size, cut = self.written or (emitted, 0, emitted < n["changed"])
        return FieldDiffStats(n["first"], n["second"], n["compared"], n["changed"], n["fields"], rows, size, cut)

    def all_warnings(self) -> list[str]:
        """Known ones, and those that take counting."""
        out = [*self.warnings, *([TRUNCATED] if self.stats.truncated else [])]
        return out + [REPEATED] * bool(self.counts().get("repeated"))

    def to_dict(self) -> dict[str, Any]:
        rows = [] if self.written else [{"key": r.key.asDict(), "changes": [c.asDict() for c in r.changes]} for r in self.rows.collect()]
        return {"rows": rows, "summary_by_column": self.summary_by_column, "stats": self.stats.to_dict(), "metadata": self.metadata, "warnings": self.all_warnings()}


def compare_fields(first: DataFrame, second: DataFrame, *, key: KeySpec, columns=None, exclude_columns=None, normalizer=None, output=None, max_rows: int | None = None, max_bytes=None, order_by=None, nan_equal: bool = True, sorted_input: bool = False, validate_sorted: bool = True) -> FieldDiffResult:
    """Field changes of rows with equal keys; every left row is compared, or with sorted_input the first of each key."""
    if max_rows is not None and max_rows < 0:
        raise InvalidInputError("max_rows must not be negative")
    if max_bytes is not None and output is None:
        raise InvalidInputError("max_bytes needs an output")
    if sorted_input and validate_sorted:
        from rowdelta.streaming.merge import require_sorted

        require_sorted(first, key, "first"), require_sorted(second, key, "second")
    pairs = field_changes(first, second, key=key, columns=columns, exclude_columns=exclude_columns, normalizer=normalizer, order_by=order_by, nan_equal=nan_equal, first_only=sorted_input)
    if sorted_input:
        pairs = pairs.withColumn(ORDER, F.col(TOKEN))
    memo: dict[str, int] = {}

    def count() -> dict[str, int]:
        if not memo:
            sums = [F.coalesce(F.sum(e), F.lit(0)).cast("long") for e in (F.lit(1), (F.size("changes") > 0).cast("int"), F.size("changes"))]
            compared, changed, fields = pairs.agg(*(s.alias(f"n{i}") for i, s in enumerate(sums))).first()
            memo.update(compared=compared, changed=changed, fields=fields, first=0, second=0, repeated=0)
            if not sorted_input:
                b = keys.side(second, key)
                total, distinct = b.groupBy(TOKEN).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
                memo.update(first=first.count(), second=total, repeated=total - distinct)
        return memo

    result = FieldDiffResult(pairs, count, max_rows, {"key_columns": keys.names(key), "compared_columns": compared_columns(first, second, key, columns, exclude_columns), "sorted": sorted_input})
    if sorted_input:
        result.warnings.append(UNCOUNTED)
    if output is not None:
        from rowdelta.operators import sinks

        result.written = sinks.write_field_rows(result._changed.orderBy(ORDER).select("key", "changes"), output, max_rows, parse_size(max_bytes))
        result.metadata["output"] = str(output)
        result.warnings.append(STREAMED)
    return result


def compare_fields_sorted(first: DataFrame, second: DataFrame, **how) -> FieldDiffResult:
    """As compare_fields for inputs in order of their key: the first row of each key on both sides, in key order."""
    return compare_fields(first, second, sorted_input=True, **how)


def iter_field_diff_sorted(first: DataFrame, second: DataFrame, **how):
    """Changed rows in key order as dictionaries, streamed to the driver partition by partition."""
    for r in compare_fields_sorted(first, second, **how).rows.toLocalIterator():
        yield {"key": r.key.asDict(), "changes": [c.asDict() for c in r.changes]}


def changed_counts(first: DataFrame, second: DataFrame, **how) -> DataFrame:
    """One row: compared pairs, changed rows, changed fields."""
    n = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    pairs = field_changes(first, second, **how)
    return pairs.agg(n(F.lit(1), "compared"), n((F.size("changes") > 0).cast("int"), "changed_rows"), n(F.size("changes"), "changed_fields"))


