"""Keys: from a key specification to one token struct for each row, equal on both sides exactly where keys are.

NULL matches NULL, NaN matches NaN, 0.0 matches -0.0. Numbers of any width compare by value; a string never equals a
number, and a boolean never equals either, so sides of such types are kept apart instead of cast. Structs compare by
field name, maps whatever their order, arrays element by element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from rowdelta.errors import InvalidInputError, KeyExtractionError, NormalizationError
from rowdelta.functions.normalize import Normalizer

#: A column name, several, an expression over a frame, or None for the whole row.
KeySpec = str | Sequence[str] | Callable[[DataFrame], Column] | None

TOKEN, ORDER, ROW = "__token", "__order", "__row"


def names(key: KeySpec) -> list[str]:
    """Column names of a key; of an expression or the whole row, none."""
    if key is None or callable(key):
        return []
    out = [key] if isinstance(key, str) else list(key)
    if not out:
        raise InvalidInputError("a key needs at least one column")
    return out


def _column(df: DataFrame, name: str) -> Column:
    if name in df.columns:
        return df[f"`{name}`"]
    try:
        df.select(F.col(name))
    except AnalysisException as e:
        raise KeyExtractionError(f"no key column {name!r}; there are {', '.join(df.columns)}") from e
    return F.col(name)


def parts(df: DataFrame, key: KeySpec, normalizer: Normalizer | None = None) -> list[Column]:
    """Key expressions. A normaliser works on each part of a key; on a whole row, on its string columns."""
    if callable(key):
        try:
            out = [key(df)]
        except Exception as e:
            raise KeyExtractionError(f"the key expression failed: {e}") from e
    elif key is None:
        out = [df[f"`{c}`"] for c in sorted(df.columns)]
    else:
        out = [_column(df, n) for n in names(key)]
    if normalizer is None:
        return out
    try:
        kinds = df.select(*(c.alias(f"k{i}") for i, c in enumerate(out))).dtypes
        new = [normalizer(c) if key is not None or kinds[i][1] == "string" else c for i, c in enumerate(out)]
        df.select(*(c.alias(f"k{i}") for i, c in enumerate(new)))
    except Exception as e:
        raise NormalizationError(f"the normaliser failed: {e}") from e
    return new


def _canonical(c: Column, kind: T.DataType) -> Column:
    """Comparable and groupable, with fields in order of name."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*(_canonical(c.getField(f.name), f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(_canonical(e["key"], kind.keyType).alias("k"), _canonical(e["value"], kind.valueType).alias("v"))))
    if isinstance(kind, T.VariantType):  # a number by its value, whatever it is written as
        word = F.regexp_extract(F.schema_of_variant(c), "^[A-Z]+", 0)
        whole, real = F.try_variant_get(c, "$", "bigint"), F.try_variant_get(c, "$", "double")
        number = F.when((word == "BIGINT") | (whole.cast("double") == real), whole.cast("string")).otherwise(real.cast("string"))
        return F.when(word.isin("BIGINT", "DECIMAL", "DOUBLE"), number).when(word != "VOID", F.to_json(c))
    return c


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType | T.NullType):
        return kind.typeName()
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StringType | T.VarcharType | T.CharType):
        return "string"
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return "time"
    return kind.typeName()


def _wide(a: T.DataType, b: T.DataType) -> str:
    """The type in which two kinds of number are compared."""
    if any(isinstance(x, T.FractionalType) and not isinstance(x, T.DecimalType) for x in (a, b)):
        return "double"
    if any(isinstance(x, T.DecimalType) for x in (a, b)):
        scale = max(x.scale if isinstance(x, T.DecimalType) else 0 for x in (a, b))
        return f"decimal(38,{scale})"
    return "bigint"


def aligned(a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType) -> tuple[Column, Column, bool]:
    """Both as one type, and whether values of the two can be equal at all (beside both being NULL)."""
    if isinstance(a_kind, T.VariantType) != isinstance(b_kind, T.VariantType) and not isinstance(b_kind if isinstance(a_kind, T.VariantType) else a_kind, T.NullType):
        a, b, a_kind, b_kind = a.cast("variant"), b.cast("variant"), T.VariantType(), T.VariantType()
    a, b = _canonical(a, a_kind), _canonical(b, b_kind)
    if isinstance(a_kind, T.VariantType) and isinstance(b_kind, T.VariantType):
        return a, b, True
    fa, fb = _family(a_kind), _family(b_kind)
    if a_kind == b_kind and not isinstance(a_kind, T.VariantType):
        return a, b, True
    if "void" in (fa, fb):
        kind = (b_kind if fa == "void" else a_kind).simpleString()
        return (a.cast(kind), b, True) if fa == "void" else (a, b.cast(kind), True)
    if fa == fb == "number":
        kind = _wide(a_kind, b_kind)
        return a.cast(kind), b.cast(kind), True
    if fa == fb == "string":
        return a.cast("string"), b.cast("string"), True
    if fa == fb == "time":
        return a.cast("timestamp"), b.cast("timestamp"), True
    if fa == fb and fa in ("struct", "array", "map", "variant"):
        text = lambda c: F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        return F.when(a.isNotNull(), text(a)), F.when(b.isNotNull(), text(b)), True
    return a.cast("string"), b.cast("string"), False


def ordered(df: DataFrame, order_by: Sequence[str] | None = None) -> Column:
    """What 'first' goes by: the columns named, or the place in which Spark reads the row."""
    if order_by:
        return F.struct(*(_column(df, c).alias(f"o{i}") for i, c in enumerate([order_by] if isinstance(order_by, str) else order_by)))
    return F.monotonically_increasing_id()


def tokens(first: DataFrame, second: DataFrame, key: KeySpec, normalizer: Normalizer | None = None) -> tuple[Column, Column]:
    """A token struct for each side, of one type; where sides can't be equal, each carries its number."""
    if key is None:
        every = sorted(set(first.columns) | set(second.columns))
        first, second = (d.select("*", *(F.lit(None).alias(c) for c in every if c not in d.columns)) for d in (first, second))
    a, b = parts(first, key, normalizer), parts(second, key, normalizer)
    kinds = [[f.dataType for f in d.select(*(c.alias(f"k{i}") for i, c in enumerate(p))).schema] for d, p in ((first, a), (second, b))]
    pairs, apart = [], []
    for i, (x, xk, y, yk) in enumerate(zip(a, kinds[0], b, kinds[1])):
        x, y, alike = aligned(x, xk, y, yk)
        pairs.append((x.alias(f"k{i}"), y.alias(f"k{i}")))
        if not alike:  # NULL still matches NULL
            apart.append((F.when(x.isNotNull(), 0).alias(f"s{i}"), F.when(y.isNotNull(), 1).alias(f"s{i}")))
    pairs += apart
    return F.struct(*(p[0] for p in pairs)), F.struct(*(p[1] for p in pairs))


def sides(first: DataFrame, second: DataFrame, key: KeySpec, normalizer: Normalizer | None = None, order_by: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Each side as (token, order, row)."""
    if key is None:
        every = sorted(set(first.columns) | set(second.columns))
        a, b = (d.select(*d.columns, *(F.lit(None).alias(c) for c in every if c not in d.columns)) for d in (first, second))
    else:
        a, b = first, second
    ta, tb = tokens(a, b, key, normalizer)
    out = []
    for d, own, t in ((a, first, ta), (b, second, tb)):
        out.append(d.select(t.alias(TOKEN), ordered(own, order_by).alias(ORDER), F.struct(*(F.col(f"`{c}`") for c in own.columns)).alias(ROW)))
    return out[0], out[1]


def side(df: DataFrame, key: KeySpec, normalizer: Normalizer | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """One table as (token, order, row)."""
    return sides(df, df, key, normalizer, order_by)[0]
