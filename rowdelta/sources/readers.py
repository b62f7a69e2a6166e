"""Files as DataFrames: CSV, TSV, JSON lines, Parquet and text, gzipped or not.

Delimited values are strings; an empty field is '' and so, as Spark reads it, is one that a short row lacks. Files without
line breaks in quotes are split over tasks; one with any is read by one task, whole rows at a time. JSON lines of objects become
columns, of VARIANT where a key holds values of several types; a file whose lines are not all objects, or read with
`ragged=True`, becomes one `value` column of VARIANT, in which a lacking key differs from a null.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowdelta.errors import CorruptedInputError, InvalidInputError, UnsupportedFormatError

#: File endings by format, fixed values.
ENDINGS = {"csv": ("csv",), "tsv": ("tsv", "tab"), "jsonl": ("jsonl", "ndjson"), "parquet": ("parquet",), "txt": ("txt", "log")}
ALIASES = {"text": "txt", "tab": "tsv", "pq": "parquet", "ndjson": "jsonl"}


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def normalize_format(name: str) -> str:
    name = name.strip().lower().replace("-", "_")
    name = ALIASES.get(name, name)
    if name != "auto" and name not in ENDINGS:
        raise UnsupportedFormatError(f"unknown format {name!r}; there are {', '.join(ENDINGS)}")
    return name


def infer_format(path) -> str:
    """By the ending, '.gz' aside."""
    name = str(path).rstrip("/").lower().removesuffix(".gz")
    ending = name.rpartition(".")[2] if "." in name.rpartition("/")[2] else ""
    for kind, endings in ENDINGS.items():
        if ending in endings:
            return kind
    raise UnsupportedFormatError(f"no format for {path}")


def read_delimited(path, *, delimiter: str = ",", encoding: str = "utf-8", quotechar: str = '"', has_header: bool = True, fieldnames: Sequence[str] | None = None, multiline: bool | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Strings by header, by fieldnames, or with neither as one array column `value`. multiline: rows may break in quotes; looked up if None."""
    spark = spark or session()
    if multiline is None:
        multiline = breaks_in_quotes(path, quotechar, encoding, spark)
    reader = spark.read.option("sep", delimiter).option("encoding", encoding).option("quote", quotechar).option("escape", quotechar).option("header", has_header and not fieldnames).option("inferSchema", False).option("multiLine", multiline)
    df = reader.csv(str(path))
    if has_header and fieldnames:  # the names replace the header's
        df = reader.option("header", True).csv(str(path))
    if fieldnames:
        if len(fieldnames) != len(df.columns):
            raise InvalidInputError(f"{len(fieldnames)} names for {len(df.columns)} columns")
        df = df.toDF(*fieldnames)
    df = df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))
    return df if has_header or fieldnames else df.select(F.array(*df.columns).alias("value"))


def breaks_in_quotes(path, quotechar: str = '"', encoding: str = "utf-8", spark: SparkSession | None = None) -> bool:
    """Whether a line has an odd number of quotes, so that a field goes on in the next."""
    if not quotechar:
        return False
    lines = (spark or session()).read.option("encoding", encoding).text(str(path))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit(quotechar), F.lit("")))
    return bool(lines.where(quotes % 2 == 1).take(1))


def read_csv(path, **how) -> DataFrame:
    return read_delimited(path, **how)


def read_tsv(path, **how) -> DataFrame:
    return read_delimited(path, **{"delimiter": "\t"} | how)


def read_jsonl(path, *, encoding: str = "utf-8", ragged: bool | None = None, schema=None, spark: SparkSession | None = None) -> DataFrame:
    """One value for each line that is not blank. A line that is no JSON raises CorruptedInputError, with its number where it can be told."""
    spark = spark or session()
    lines = spark.read.option("encoding", encoding).text(str(path)).where(F.trim("value") != "")
    bad = lines.where(F.try_parse_json("value").isNull()).limit(1).collect()
    if bad:
        raise CorruptedInputError(f"{path}{line_of(str(path), bad[0].value)}: not JSON: {bad[0].value[:80]!r}")
    if ragged is None and schema is None:
        ragged = lines.where(~F.ltrim("value").startswith("{")).limit(1).count() > 0
    if ragged:
        return lines.select(F.parse_json("value").alias("value"))
    reader = spark.read.option("encoding", encoding).option("mode", "FAILFAST")
    if schema is None and (mixed := mixed_keys(lines)):
        inferred = reader.json(str(path)).schema
        schema = T.StructType([T.StructField(f.name, T.VariantType() if f.name in mixed else f.dataType) for f in inferred])
    return (reader.schema(schema) if schema is not None else reader).json(str(path))


def mixed_keys(lines: DataFrame) -> set[str]:
    """Keys of JSON objects, one a line, that hold values of several types (null aside)."""
    pairs = lines.select(F.parse_json("value").alias("v")).lateralJoin(lines.sparkSession.tvf.variant_explode(F.col("v").outer()))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    kind = F.when(kind == "DOUBLE", "DECIMAL").otherwise(kind)
    kinds = pairs.select("key", kind.alias("kind")).where("kind <> 'VOID'").groupBy("key").agg(F.min("kind").alias("a"), F.max("kind").alias("b"))
    return {r["key"] for r in kinds.where("a <> b").collect()}


def line_of(path: str, text: str) -> str:
    """':number' of a line in a local file, or ''."""
    import gzip
    import os

    local = re.sub("^file:/+", "/", path)
    if not os.path.isfile(local):
        return ""
    with (gzip.open if local.endswith(".gz") else open)(local, "rt", encoding="utf-8", errors="replace") as lines:
        return next((f":{i}" for i, line in enumerate(lines, 1) if line.rstrip("\r\n") == text), "")


def read_parquet(path, *, columns: Sequence[str] | None = None, batch_size: int = 65_536, spark: SparkSession | None = None) -> DataFrame:
    if batch_size <= 0:
        raise InvalidInputError("batch_size must be positive")
    df = (spark or session()).read.parquet(str(path))
    return df if columns is None else df.select(*columns)


def read_text(path, *, encoding: str = "utf-8", spark: SparkSession | None = None) -> DataFrame:
    """One `value` for each line, blank ones too."""
    return (spark or session()).read.option("encoding", encoding).option("lineSep", "\n").text(str(path))


def read_file(path, *, format: str = "auto", encoding: str = "utf-8", delimiter: str | None = None, quotechar: str = '"', has_header: bool = True, fieldnames=None, columns=None, batch_size: int = 65_536, ragged: bool | None = None, spark: SparkSession | None = None) -> DataFrame:  # noqa: A002
    """By format or ending; columns and batch_size hold for Parquet only, ragged for JSON lines."""
    kind = normalize_format(format)
    kind = infer_format(path) if kind == "auto" else kind
    if kind in ("csv", "tsv"):
        return read_delimited(path, delimiter=delimiter or {"csv": ",", "tsv": "\t"}[kind], encoding=encoding, quotechar=quotechar, has_header=has_header, fieldnames=fieldnames, spark=spark)
    if kind == "jsonl":
        return read_jsonl(path, encoding=encoding, ragged=ragged, spark=spark)
    if kind == "parquet":
        return read_parquet(path, columns=columns, batch_size=batch_size, spark=spark)
    return read_text(path, encoding=encoding, spark=spark)
