"""Observed schemas and their drift: which columns there are, of which types, and whether they are ever empty."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowdelta.errors import InvalidInputError
from rowdelta.plans import keys

#: Names of observed types by Spark type, fixed values.
TYPE_NAMES = {
    T.BooleanType: "bool", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int", T.FloatType: "float", T.DoubleType: "float",
    T.StringType: "str", T.ArrayType: "list", T.MapType: "list", T.StructType: "object", T.TimestampType: "datetime", T.TimestampNTZType: "datetime",
    T.DateType: "date", T.DecimalType: "Decimal", T.BinaryType: "bytes", T.DayTimeIntervalType: "timedelta",
}
#: The same for JSON values, by the first word of schema_of_variant.
JSON_NAMES = {"BOOLEAN": "bool", "BIGINT": "int", "DECIMAL": "float", "DOUBLE": "float", "STRING": "str", "ARRAY": "list", "OBJECT": "object"}


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    types: tuple[str, ...]
    nullable: bool
    present_count: int = 0
    null_count: int = 0
    missing_count: int = 0

    def to_dict(self) -> dict[str, Any]:
        return asdict(self) | {"types": list(self.types)}


@dataclass
class SchemaResult:
    columns: dict[str, ColumnSchema]
    row_count: int
    sampled: bool = False
    warnings: list[str] = field(default_factory=list)
    metadata: dict[str, Any] = field(default_factory=dict)

    def to_dict(self) -> dict[str, Any]:
        return {"columns": {k: v.to_dict() for k, v in self.columns.items()}, "row_count": self.row_count, "sampled": self.sampled, "warnings": self.warnings, "metadata": self.metadata}


@dataclass
class SchemaDiffResult:
    left_schema: SchemaResult
    right_schema: SchemaResult
    added_columns: list[str]
    removed_columns: list[str]
    type_changes: list[dict[str, Any]]
    nullable_changes: list[dict[str, Any]]
    warnings: list[str] = field(default_factory=list)
    metadata: dict[str, Any] = field(default_factory=dict)

    @property
    def has_changes(self) -> bool:
        return bool(self.added_columns or self.removed_columns or self.type_changes or self.nullable_changes)

    def to_dict(self) -> dict[str, Any]:
        return {k: v.to_dict() if isinstance(v, SchemaResult) else v for k, v in vars(self).items()} | {"has_changes": self.has_changes}


def _loose(name: str, strict: bool) -> str:
    return "number" if not strict and name in ("int", "float") else name


def type_name(kind: T.DataType, strict: bool = True) -> str | None:
    return _loose(TYPE_NAMES[type(kind)], strict) if type(kind) in TYPE_NAMES else None if isinstance(kind, T.NullType) else kind.typeName()


def _empty(c: Column, kind: T.DataType, empty_string_null: bool) -> Column:
    return c.isNull() | (c == "") if empty_string_null and isinstance(kind, T.StringType) else c.isNull()


def profile(df: DataFrame, *, empty_string_null: bool = True, strict_numeric_types: bool = True) -> DataFrame:
    """(column, types, nullable, present_count, null_count, missing_count, row_count), one row for each column of a typed table, from one aggregate."""
    sums = [F.count_if(_empty(F.col(f"`{f.name}`"), f.dataType, empty_string_null)).alias(f"n{i}") for i, f in enumerate(df.schema)]
    one = df.agg(F.count("*").alias("n"), *sums)
    rows = F.array(*(
        F.struct(
            F.lit(f.name).alias("column"), F.when(F.col(f"n{i}") < F.col("n"), F.lit(type_name(f.dataType, strict_numeric_types) or "")).otherwise("").alias("types"), (F.col(f"n{i}") > 0).alias("nullable"),
            F.col("n").alias("present_count"), F.col(f"n{i}").alias("null_count"), F.lit(0).cast("long").alias("missing_count"), F.col("n").alias("row_count"),
        ) for i, f in enumerate(df.schema)
    ))
    return one.select(F.inline(rows))


def json_profile(df: DataFrame, json_col: str = "value", order_by=None, *, empty_string_null: bool = True, strict_numeric_types: bool = True) -> DataFrame:
    """The same for JSON objects in a text or VARIANT column. Rows that lack a column count only after its first appearance."""
    v = F.col(json_col) if isinstance(df.schema[json_col].dataType, T.VariantType) else F.parse_json(json_col)
    rows = df.select(v.alias("v"), keys.ordered(df, order_by).alias("o")).where("v IS NOT NULL")
    pairs = rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select("o", F.col("key").alias("column"), "value", F.schema_of_variant("value").alias("kind"))
    names = F.regexp_extract("kind", "^[A-Z]+", 0)
    name = F.create_map(*(F.lit(x) for k, t in JSON_NAMES.items() for x in (k, _loose(t, strict_numeric_types))))[names]
    null = (F.col("kind") == "VOID") | ((F.col("kind") == "STRING") & F.lit(empty_string_null) & (F.expr("try_variant_get(value, '$', 'string')") == ""))
    seen = pairs.groupBy("column").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(~F.coalesce(null, F.lit(False)), name))), ",").alias("types"), F.count("*").alias("present_count"),
        F.count_if(null).alias("null_count"), F.min("o").alias("first"),
    )
    # rows after a column's first: every row is counted once at its place among the few first places
    firsts = seen.groupBy().agg(F.array_sort(F.collect_set("first")).alias("firsts"))
    at = rows.select("o").join(F.broadcast(firsts), how="cross").groupBy(F.size(F.filter("firsts", lambda f: f <= F.col("o"))).alias("k")).agg(F.count("*").alias("n"))
    reach = seen.groupBy("first").agg(F.first("first").alias("f")).join(F.broadcast(firsts), how="cross").select("first", F.array_position("firsts", F.col("first")).alias("k0"))
    after = reach.join(F.broadcast(at), F.expr("k >= k0")).groupBy("first").agg(F.sum("n").alias("after"))
    total = rows.agg(F.count("*").alias("row_count"))
    out = seen.join(after, "first").join(F.broadcast(total), how="cross").withColumn("missing_count", F.col("after") - F.col("present_count"))
    return out.select("column", "types", ((F.col("null_count") > 0) | (F.col("missing_count") > 0)).alias("nullable"), "present_count", "null_count", "missing_count", "row_count")


def infer_schema(df: DataFrame, *, sample_size: int | None = None, empty_string_null: bool = True, strict_numeric_types: bool = True, order_by=None) -> SchemaResult:
    """The observed schema of all rows, or of the first sample_size ones."""
    if sample_size is not None and sample_size < 0:
        raise InvalidInputError("sample_size must not be negative")
    sampled = False
    if sample_size is not None:
        head = df.orderBy(keys.ordered(df, order_by)) if order_by else df
        sampled = len(head.limit(sample_size + 1).select(F.lit(1)).collect()) > sample_size
        df = head.limit(sample_size)
    variant = df.columns == ["value"] and isinstance(df.schema["value"].dataType, T.VariantType)
    how = {"empty_string_null": empty_string_null, "strict_numeric_types": strict_numeric_types}
    rows = (json_profile(df, order_by=order_by, **how) if variant else profile(df, **how)).collect() if df.columns else []
    columns = {r["column"]: ColumnSchema(r["column"], tuple(t for t in r.types.split(",") if t), r.nullable, r.present_count, r.null_count, r.missing_count) for r in rows}
    count = rows[0].row_count if rows else df.count()
    if not count:
        columns = {}
    return SchemaResult(columns, count, sampled, [f"only the first {sample_size} rows were looked at"] if sampled else [])


def schema_diff(left: SchemaResult, right: SchemaResult) -> SchemaDiffResult:
    a, b = left.columns, right.columns
    both = sorted(a.keys() & b.keys())
    types = [{"column": c, "left_types": list(a[c].types), "right_types": list(b[c].types)} for c in both if a[c].types != b[c].types]
    nulls = [{"column": c, "left_nullable": a[c].nullable, "right_nullable": b[c].nullable} for c in both if a[c].nullable != b[c].nullable]
    notes = [f"{side}: {w}" for side, s in (("left", left), ("right", right)) for w in s.warnings]
    return SchemaDiffResult(left, right, sorted(b.keys() - a.keys()), sorted(a.keys() - b.keys()), types, nulls, notes)


def compare_schema(first: DataFrame, second: DataFrame, **how) -> SchemaDiffResult:
    return schema_diff(infer_schema(first, **how), infer_schema(second, **how))


def schema_drift(first: DataFrame, second: DataFrame, **how) -> DataFrame:
    """(column, change, left_value, right_value): added, removed, type_changed, nullable_changed."""
    side = lambda d, s: profile(d, **how).select(F.col("column"), F.col("types").alias(f"{s}_types"), F.col("nullable").cast("string").alias(f"{s}_nullable"))
    both = side(first, "l").join(side(second, "r"), "column", "full")
    none = F.lit(None).cast("string")
    item = lambda when, change, left=none, right=none: F.when(when, F.struct(F.lit(change).alias("change"), left.alias("left_value"), right.alias("right_value")))
    c = F.col
    items = F.array(
        item(c("l_types").isNull(), "added"),
        item(c("r_types").isNull(), "removed"),
        item(c("l_types") != c("r_types"), "type_changed", c("l_types"), c("r_types")),
        item(c("l_nullable") != c("r_nullable"), "nullable_changed", c("l_nullable"), c("r_nullable")),
    )
    return both.select("column", F.inline(F.filter(items, lambda x: x.isNotNull())))
