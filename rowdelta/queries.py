"""Registered queries of the comparison operators and their SQL oracles.

Snapshot pairs are derived from the test tables by modulo, the same way in both engines; this makes two versions of a
table, it does not shorten the work. Results are whole numbers, text and doubles.
"""

from __future__ import annotations

import itertools
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowdelta.functions.normalize import compose_normalizers, string_normalizer
from rowdelta.operators import approx, events, fields, fuzzy, presence, schema, sinks
from rowdelta.operators import duplicates as dup
from rowdelta.plans import keys
from rowdelta.sources import readers
from rowdelta.streaming import merge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- snapshot pairs: Spark, then SQL

#: Each: (table, select list, condition) of the old and the new side, in SQL that both engines read alike.
_ORDERS = "o_orderkey, o_custkey, {status} AS o_orderstatus, CAST(round({price} * 100) AS BIGINT) AS price_cents, {priority} AS o_orderpriority"
PAIRS = {
    "orders": (
        ("orders", _ORDERS.format(status="o_orderstatus", price="o_totalprice", priority="o_orderpriority"), "o_orderkey % 7 <> 0"),
        ("orders", _ORDERS.format(status="CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END", price="(CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 100 ELSE o_totalprice END)", priority="CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END"), "o_orderkey % 9 <> 0"),
    ),
    "lines": tuple(("lineitem", "l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS quantity", f"l_orderkey % {m} <> 0") for m in (5, 7)),
    "texts": (
        ("documents", "doc_id, text", "doc_id % 3 <> 0"),
        ("documents", "doc_id, concat('  ', replace(text, 'e', 'E'), ' ') AS text", "doc_id % 4 <> 0"),
    ),
    "customers": tuple(("customer", "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS k, c_custkey, c_mktsegment", f"c_custkey % {m} <> 0") for m in (3, 4)),
    "parts": (
        ("part", "p_partkey, p_name, p_brand, p_size", "p_partkey % 3 <> 0"),
        ("part", "p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'Brand#0' ELSE p_brand END AS p_brand, p_size", "p_partkey % 4 <> 0"),
    ),
}


def pair(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, DataFrame]:
    side = lambda t, cols, where: spark.read.parquet(f"{d}/{t}.parquet").where(where).selectExpr(*_columns(cols))
    return tuple(side(*s) for s in PAIRS[name])


def _columns(text: str) -> list[str]:
    """A select list cut at its outer commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def _with(name: str, more: str = "") -> str:
    (a, ac, aw), (b, bc, bw) = PAIRS[name]
    return f"WITH a AS (SELECT {ac} FROM {a} WHERE {aw}), b AS (SELECT {bc} FROM {b} WHERE {bw}){', ' + more if more else ''} "


def query(name: str, oracle: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return put


def _first(side: str, key: str, order: str) -> str:
    return f"(SELECT * FROM {side} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1)"


# ---------------------------------------------------------------- presence

_COUNTS = "count(*) FILTER (nl > 0) AS unique_first, count(*) FILTER (nr > 0) AS unique_second, count(*) FILTER (nr = 0) AS only_first, count(*) FILTER (nl = 0) AS only_second, count(*) FILTER (nl > 0 AND nr > 0) AS common, CAST(sum(nl) AS BIGINT) AS first_rows, CAST(sum(nr) AS BIGINT) AS second_rows"


def _counted(pair_: str, key: str) -> str:
    return _with(pair_, f"t AS (SELECT {key}, 1 AS l, 0 AS r FROM a UNION ALL SELECT {key}, 0, 1 FROM b), g AS (SELECT sum(l) AS nl, sum(r) AS nr FROM t GROUP BY {key})") + f"SELECT {_COUNTS} FROM g"


def _stats(a: DataFrame, b: DataFrame, key, normalizer=None) -> DataFrame:
    n = presence.presence_counts(*keys.sides(a, b, key, normalizer))
    return n.select(F.col("first").alias("unique_first"), F.col("second").alias("unique_second"), "only_first", "only_second", "common", F.col("nl").alias("first_rows"), F.col("nr").alias("second_rows"))


@query("presence_stats", _counted("orders", "o_orderkey"))
def presence_stats(spark, d):
    return _stats(*pair(spark, d, "orders"), "o_orderkey")


@query("presence_composite_stats", _counted("lines", "l_orderkey, l_linenumber"))
def presence_composite_stats(spark, d):
    return _stats(*pair(spark, d, "lines"), ["l_orderkey", "l_linenumber"])


_PRESENCE = {
    "only_first": "SELECT * FROM a ANTI JOIN b USING (o_orderkey)",
    "only_second": "SELECT * FROM b ANTI JOIN a USING (o_orderkey)",
    "common": "SELECT * FROM a SEMI JOIN b USING (o_orderkey)",
    "unique": "SELECT * FROM a ANTI JOIN b USING (o_orderkey) UNION ALL SELECT * FROM b ANTI JOIN a USING (o_orderkey)",
}


@query("presence_rows", _with("orders") + "SELECT 'only_in_first' AS section, * FROM a ANTI JOIN b USING (o_orderkey) UNION ALL SELECT 'only_in_second', * FROM b ANTI JOIN a USING (o_orderkey) UNION ALL SELECT 'common', * FROM a SEMI JOIN b USING (o_orderkey)")
def presence_rows(spark, d):
    return presence.labelled(*pair(spark, d, "orders"), key="o_orderkey", order_by="o_orderkey")


@query("presence_only_first", _with("orders") + _PRESENCE["only_first"])
def presence_only_first(spark, d):
    return presence.diff(*pair(spark, d, "orders"), key="o_orderkey").only_in_first


@query("presence_only_second", _with("orders") + _PRESENCE["only_second"])
def presence_only_second(spark, d):
    return presence.diff(*pair(spark, d, "orders"), key="o_orderkey").only_in_second


@query("presence_common", _with("orders") + _PRESENCE["common"])
def presence_common(spark, d):
    return presence.intersection(*pair(spark, d, "orders"), key="o_orderkey")


@query("presence_unique", _with("orders") + _PRESENCE["unique"])
def presence_unique(spark, d):
    return presence.unique(*pair(spark, d, "orders"), key="o_orderkey", preserve_order=False)


_LINE_ORDER = "l_partkey, cents, quantity"


@query(
    "presence_composite",
    _with("lines", f"a1 AS {_first('a', 'l_orderkey, l_linenumber', _LINE_ORDER)}, b1 AS {_first('b', 'l_orderkey, l_linenumber', _LINE_ORDER)}")
    + "SELECT 'only_in_first' AS section, * FROM a1 ANTI JOIN b1 USING (l_orderkey, l_linenumber) UNION ALL SELECT 'only_in_second', * FROM b1 ANTI JOIN a1 USING (l_orderkey, l_linenumber)",
)
def presence_composite(spark, d):
    return presence.labelled(*pair(spark, d, "lines"), key=["l_orderkey", "l_linenumber"], order_by=["l_partkey", "cents", "quantity"], include_common=False)


@query("presence_null_key", _counted("customers", "k"))
def presence_null_key(spark, d):
    return _stats(*pair(spark, d, "customers"), "k")


@query("presence_whole_row", _with("orders") + "SELECT * FROM a EXCEPT SELECT * FROM b")
def presence_whole_row(spark, d):
    return presence.diff(*pair(spark, d, "orders"), preserve_order=False).only_in_first


@query("intersect_whole_row", _with("orders") + "SELECT * FROM a INTERSECT SELECT * FROM b")
def intersect_whole_row(spark, d):
    return presence.intersect_rows(*pair(spark, d, "orders"))


@query("except_whole_row", _with("orders") + "SELECT * FROM b EXCEPT SELECT * FROM a")
def except_whole_row(spark, d):
    a, b = pair(spark, d, "orders")
    return presence.except_rows(b, a)


@query("presence_type_mismatch", _with("orders") + "SELECT count(*) AS only_first, (SELECT count(*) FROM b) AS only_second, CAST(0 AS BIGINT) AS common FROM a")
def presence_type_mismatch(spark, d):
    a, b = pair(spark, d, "orders")
    return _stats(a, b.withColumn("o_orderkey", F.col("o_orderkey").cast("string")), "o_orderkey").select("only_first", "only_second", "common")


@query("presence_widened_key", _counted("orders", "o_orderkey"))
def presence_widened_key(spark, d):
    a, b = pair(spark, d, "orders")
    return _stats(a, b.withColumn("o_orderkey", F.col("o_orderkey").cast("double")), "o_orderkey")


_NORM = "lower(regexp_replace(regexp_replace(text, '\\s+', '', 'g'), '[^0-9A-Za-zА-Яа-яЁё]+', '', 'g'))"


@query("presence_normalized", _with("texts", f"t AS (SELECT {_NORM} AS k, 1 AS l, 0 AS r FROM a UNION ALL SELECT {_NORM}, 0, 1 FROM b), g AS (SELECT sum(l) AS nl, sum(r) AS nr FROM t GROUP BY k)") + f"SELECT {_COUNTS} FROM g")
def presence_normalized(spark, d):
    return _stats(*pair(spark, d, "texts"), "text", string_normalizer(lower=True, remove_spaces=True, remove_special=True))


@query("presence_composed_normalizer", _with("texts", "t AS (SELECT md5(lower(trim(text))) AS k, 1 AS l, 0 AS r FROM a UNION ALL SELECT md5(lower(trim(text))), 0, 1 FROM b), g AS (SELECT sum(l) AS nl, sum(r) AS nr FROM t GROUP BY k)") + f"SELECT {_COUNTS} FROM g")
def presence_composed_normalizer(spark, d):
    return _stats(*pair(spark, d, "texts"), "text", compose_normalizers(string_normalizer(lower=True), F.md5))


@query("presence_by_hash", _counted("orders", "o_orderkey, o_custkey, o_orderstatus, price_cents, o_orderpriority"))
def presence_by_hash(spark, d):
    a, b = pair(spark, d, "orders")
    return _stats(a, b, lambda df: presence.row_digest(df, None, "sha256"))


@query("row_digest", "SELECT c_custkey, sha256(concat('{\"k0\":', c_custkey, ',\"k1\":\"', c_name, '\"}')) AS digest FROM customer")
def row_digest(spark, d):
    df = spark.read.parquet(f"{d}/customer.parquet")
    return df.select("c_custkey", presence.row_digest(df, ["c_custkey", "c_name"]).alias("digest"))


@query("presence_callable_key", _counted("orders", "o_orderkey % 1000 AS m").replace("GROUP BY o_orderkey % 1000 AS m", "GROUP BY m"))
def presence_callable_key(spark, d):
    return _stats(*pair(spark, d, "orders"), lambda df: df["o_orderkey"] % 1000)


# ---------------------------------------------------------------- duplicates


@query("duplicates_rows", "SELECT p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1")
def duplicates_rows(spark, d):
    df = spark.read.parquet(f"{d}/part.parquet").select("p_name", "p_partkey")
    return dup.duplicates(df, key="p_name", order_by="p_partkey", preserve_order=False)


@query("duplicates_composite", "SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS surplus FROM lineitem")
def duplicates_composite(spark, d):
    a = spark.read.parquet(f"{d}/lineitem.parquet")
    extra = dup.duplicates(a, key=["l_orderkey", "l_linenumber"], preserve_order=False).agg(F.count("*").alias("surplus"))
    return a.agg(F.count("*").alias("n")).crossJoin(extra)


@query("duplicates_text", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1")
def duplicates_text(spark, d):
    return dup.duplicates(spark.read.parquet(f"{d}/documents.parquet"), key="text", order_by="doc_id", preserve_order=False).select("doc_id")


@query("duplicates_normalized", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY regexp_replace(lower(text), '\\s+', '', 'g') ORDER BY doc_id) > 1")
def duplicates_normalized(spark, d):
    return dup.duplicates(spark.read.parquet(f"{d}/documents.parquet"), key="text", order_by="doc_id", normalizer=string_normalizer(lower=True, remove_spaces=True), preserve_order=False).select("doc_id")


@query("duplicates_null_key", "SELECT c_custkey FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS k, c_custkey FROM customer) QUALIFY row_number() OVER (PARTITION BY k ORDER BY c_custkey) > 1")
def duplicates_null_key(spark, d):
    df = spark.read.parquet(f"{d}/customer.parquet").selectExpr("CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS k", "c_custkey")
    return dup.duplicates(df, key="k", order_by="c_custkey", preserve_order=False).select("c_custkey")


@query("duplicate_groups", "SELECT l_orderkey, l_linenumber, count(*) AS \"count\" FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return dup.duplicate_groups(spark.read.parquet(f"{d}/lineitem.parquet"), key=["l_orderkey", "l_linenumber"])


@query("compare_duplicates", _with("lines") + f"SELECT 'first' AS side, l_orderkey, l_linenumber, {_LINE_ORDER} FROM a WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) QUALIFY row_number() OVER w > 1 UNION ALL SELECT 'second', l_orderkey, l_linenumber, {_LINE_ORDER} FROM b WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) QUALIFY row_number() OVER w > 1")
def compare_duplicates(spark, d):
    r = presence.compare(*pair(spark, d, "lines"), key=["l_orderkey", "l_linenumber"], order_by=["l_partkey", "cents", "quantity"], include_duplicates=True, preserve_order=False)
    return r.duplicates_first.withColumn("side", F.lit("first")).unionByName(r.duplicates_second.withColumn("side", F.lit("second")))


# ---------------------------------------------------------------- field diff

_FIELDS = ("o_custkey", "o_orderpriority", "o_orderstatus", "price_cents")


def _changes(columns=_FIELDS, wrap: str = "{}", on: str = "o_orderkey", a: str = "a", b: str = "b", key: str | None = None) -> str:
    key = key or f"{a}.{on}"
    same = lambda c: f"{wrap.format(f'{a}.{c}')} IS DISTINCT FROM {wrap.format(f'{b}.{c}')}"
    return " UNION ALL ".join(f"SELECT {key} AS id, '{c}' AS field, CAST({a}.{c} AS VARCHAR) AS \"left\", CAST({b}.{c} AS VARCHAR) AS \"right\" FROM {a} JOIN {b} ON {a}.{on} IS NOT DISTINCT FROM {b}.{on} WHERE {same(c)}" for c in columns)


def _long(df: DataFrame) -> DataFrame:
    return df.where(F.size("changes") > 0).select(F.col("key")[df.schema["key"].dataType.names[0]].alias("id"), F.inline("changes"))


def _fields(spark, d, **how) -> DataFrame:
    return _long(fields.field_changes(*pair(spark, d, "orders"), key="o_orderkey", **how))


@query("field_changes_long", _with("orders") + _changes())
def field_changes_long(spark, d):
    return _fields(spark, d)


@query("field_changed_rows", _with("orders", f"c AS ({_changes()})") + "SELECT id, count(*) AS n FROM c GROUP BY id")
def field_changed_rows(spark, d):
    rows = fields.compare_fields(*pair(spark, d, "orders"), key="o_orderkey").rows
    return rows.select(F.col("key.o_orderkey").alias("id"), F.size("changes").cast("long").alias("n"))


@query("field_summary_by_column", _with("orders", f"c AS ({_changes()})") + "SELECT field, count(*) AS n FROM c GROUP BY field")
def field_summary_by_column(spark, d):
    return fields.compare_fields(*pair(spark, d, "orders"), key="o_orderkey").by_column


@query("field_stats", _with("orders", f"c AS ({_changes()})") + "SELECT (SELECT count(*) FROM a JOIN b USING (o_orderkey)) AS compared, count(DISTINCT id) AS changed_rows, count(*) AS changed_fields FROM c")
def field_stats(spark, d):
    return fields.changed_counts(*pair(spark, d, "orders"), key="o_orderkey")


@query("field_columns_filter", _with("orders") + _changes(("o_orderstatus",)))
def field_columns_filter(spark, d):
    return _fields(spark, d, columns=["o_orderstatus", " "])


@query("field_exclude_columns", _with("orders") + _changes(("o_custkey", "o_orderpriority", "price_cents")))
def field_exclude_columns(spark, d):
    return _fields(spark, d, exclude_columns=["o_orderstatus"])


@query("field_null_vs_value", _with("orders", f"c AS ({_changes(('o_orderpriority',))})") + "SELECT id, \"left\" FROM c WHERE \"right\" IS NULL")
def field_null_vs_value(spark, d):
    return _fields(spark, d, columns=["o_orderpriority"]).where("right IS NULL").select("id", "left")


@query("field_normalized", _with("orders") + _changes(("o_orderstatus",), "lower({})"))
def field_normalized(spark, d):
    return _fields(spark, d, columns=["o_orderstatus"], normalizer=F.lower)


@query("field_missing_column", _with("orders") + "SELECT a.o_orderkey AS id, 'note' AS field, CAST(NULL AS VARCHAR) AS \"left\", 'n' AS \"right\" FROM a JOIN b USING (o_orderkey)")
def field_missing_column(spark, d):
    a, b = pair(spark, d, "orders")
    return _long(fields.field_changes(a, b.withColumn("note", F.lit("n")), key="o_orderkey", columns=["note"]))


@query("field_duplicate_right", _with("parts", f"r AS {_first('b', 'p_name', 'p_partkey')}") + _changes(("p_brand", "p_size"), on="p_name", b="r", key="a.p_partkey"))
def field_duplicate_right(spark, d):
    a, b = pair(spark, d, "parts")
    out = fields.field_changes(a, b, key="p_name", columns=["p_brand", "p_size"], order_by="p_partkey")
    return out.select(F.col(keys.ORDER)["o0"].alias("id"), F.inline("changes"))


@query("field_sorted_first_of_group", _with("parts", f"l AS {_first('a', 'p_name', 'p_partkey')}, r AS {_first('b', 'p_name', 'p_partkey')}") + _changes(("p_brand", "p_size"), on="p_name", a="l", b="r", key="l.p_name"))
def field_sorted_first_of_group(spark, d):
    a, b = pair(spark, d, "parts")
    return _long(fields.field_changes(a, b, key="p_name", columns=["p_brand", "p_size"], order_by="p_partkey", first_only=True))


@query("field_limit", _with("orders", f"c AS ({_changes()}), t AS (SELECT DISTINCT id FROM c ORDER BY id LIMIT 20)") + "SELECT id, field, \"left\", \"right\" FROM c SEMI JOIN t USING (id)")
def field_limit(spark, d):
    """A limit is the feature here: the first 20 changed rows."""
    return _long(fields.compare_fields(*pair(spark, d, "orders"), key="o_orderkey", order_by="o_orderkey", max_rows=20).rows)


@query("field_composite_key", _with("lines", f"a1 AS {_first('a', 'l_orderkey, l_linenumber', _LINE_ORDER)}, b1 AS {_first('b', 'l_orderkey, l_linenumber', _LINE_ORDER)}") + "SELECT count(*) AS pairs, count(*) FILTER (a1.cents IS DISTINCT FROM b1.cents) AS cents_changed FROM a1 JOIN b1 USING (l_orderkey, l_linenumber)")
def field_composite_key(spark, d):
    p = fields.field_changes(*pair(spark, d, "lines"), key=["l_orderkey", "l_linenumber"], columns=["cents"], order_by=["l_partkey", "cents", "quantity"], first_only=True)
    return p.agg(F.count("*").alias("pairs"), F.count_if(F.size("changes") > 0).alias("cents_changed"))


@query("field_null_key", _with("customers", f"r AS {_first('b', 'k', 'c_custkey')}") + "SELECT count(*) AS pairs, count(*) FILTER (a.c_mktsegment IS DISTINCT FROM r.c_mktsegment) AS changed FROM a JOIN r ON a.k IS NOT DISTINCT FROM r.k")
def field_null_key(spark, d):
    p = fields.field_changes(*pair(spark, d, "customers"), key="k", columns=["c_mktsegment"], order_by="c_custkey")
    return p.agg(F.count("*").alias("pairs"), F.count_if(F.size("changes") > 0).alias("changed"))


@query("field_array_values", "SELECT vec_id, len(embedding) AS n FROM embeddings WHERE vec_id % 5 = 0")
def field_array_values(spark, d):
    """Arrays compare element by element: the new side drops each fifth vector's first component."""
    a = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    b = a.withColumn("embedding", F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 2, 1000)).otherwise(F.col("embedding")))
    changed = fields.field_changes(a, b, key="vec_id").where(F.size("changes") > 0).select(F.col("key.vec_id").alias("vec_id"), F.from_json(F.col("changes")[0]["left"], "array<float>").alias("x"))
    return changed.select("vec_id", F.size("x").cast("long").alias("n"))


# ---------------------------------------------------------------- sorted


@query("sorted_diff_rows", _with("orders", "t AS (SELECT o_orderkey, 0 AS side FROM a UNION ALL SELECT o_orderkey, 1 FROM b), g AS (SELECT o_orderkey AS id, min(side) AS lo, max(side) AS hi FROM t GROUP BY 1)") + "SELECT id, CASE WHEN lo < hi THEN 'common' WHEN lo = 0 THEN 'only_in_first' ELSE 'only_in_second' END AS section FROM g")
def sorted_diff_rows(spark, d):
    a, b = pair(spark, d, "orders")
    a, b = (x.orderBy("o_orderkey") for x in (a, b))
    return merge.sorted_diff(a, b, key="o_orderkey", include_common=True, validate_sorted=False).select(F.get_json_object("value", "$.o_orderkey").cast("long").alias("id"), "section")


@query("sorted_validation", "SELECT CAST(0 AS BIGINT) AS ascending, count(*) - 1 AS descending FROM orders")
def sorted_validation(spark, d):
    k = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    n = [merge.order_violations(k.orderBy(o), "o_orderkey") for o in (F.asc("o_orderkey"), F.desc("o_orderkey"))]
    return spark.createDataFrame([tuple(n)], "ascending long, descending long")


# ---------------------------------------------------------------- schema


def _profile(cols: dict[str, str], frm: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS types, count(*) FILTER ({c} IS NULL{empty}) > 0 AS nullable, count(*) AS present_count, count(*) FILTER ({c} IS NULL{empty}) AS null_count, CAST(0 AS BIGINT) AS missing_count, count(*) AS row_count FROM {frm}" for c, t in cols.items() for empty in ((f" OR {c} = ''",) if t == "str" else ("",)))


_ORDER_TYPES = {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "str", "price_cents": "int", "o_orderpriority": "str"}


_ALL_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS price_cents, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders"


@query("schema_profile", _profile(_ORDER_TYPES, f"({_ALL_ORDERS})"))
def schema_profile(spark, d):
    return schema.profile(spark.read.parquet(f"{d}/orders.parquet").selectExpr(*_columns(_ALL_ORDERS.removeprefix("SELECT ").removesuffix(" FROM orders"))))


#: Two versions of nation and, from what DuckDB says of their columns, the drift between them.
_KINDS = "CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'VARCHAR' THEN 'str' WHEN 'DOUBLE' THEN 'float' END AS types"
_NATIONS = f"l AS (SELECT column_name AS c, {_KINDS} FROM (DESCRIBE SELECT * FROM nation)), r AS (SELECT column_name AS c, {_KINDS} FROM (DESCRIBE SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS n_regionkey, 1 AS extra FROM nation))"


@query("schema_profile_loose", _profile({"c_custkey": "number", "c_name": "str", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "str"}, "customer"))
def schema_profile_loose(spark, d):
    return schema.profile(spark.read.parquet(f"{d}/customer.parquet"), strict_numeric_types=False)


@query("schema_empty_string", "SELECT count(*) FILTER (r_regionkey % 2 = 0) AS as_null, CAST(0 AS BIGINT) AS as_text FROM region")
def schema_empty_string(spark, d):
    df = spark.read.parquet(f"{d}/region.parquet").select(F.when(F.col("r_regionkey") % 2 == 0, "").otherwise(F.col("r_name")).alias("r_name"))
    n = [schema.profile(df, empty_string_null=e).select(F.col("null_count").alias(n)) for e, n in ((True, "as_null"), (False, "as_text"))]
    return n[0].crossJoin(n[1])


@query("schema_drift", f"WITH {_NATIONS} SELECT coalesce(l.c, r.c) AS \"column\", CASE WHEN l.c IS NULL THEN 'added' WHEN r.c IS NULL THEN 'removed' ELSE 'type_changed' END AS change, CASE WHEN r.c IS NOT NULL THEN l.types END AS left_value, CASE WHEN l.c IS NOT NULL THEN r.types END AS right_value FROM l FULL JOIN r ON l.c = r.c WHERE l.types IS DISTINCT FROM r.types")
def schema_drift(spark, d):
    a = spark.read.parquet(f"{d}/nation.parquet")
    return schema.schema_drift(a, a.drop("n_name").withColumn("extra", F.lit(1)).withColumn("n_regionkey", F.col("n_regionkey").cast("string")))


@query("schema_nullable_drift", _with("orders", f"p AS ({_profile(_ORDER_TYPES, 'a')}), q AS ({_profile(_ORDER_TYPES, 'b')})") + "SELECT \"column\", 'nullable_changed' AS change, CAST(p.nullable AS VARCHAR) AS left_value, CAST(q.nullable AS VARCHAR) AS right_value FROM p JOIN q USING (\"column\") WHERE p.nullable <> q.nullable")
def schema_nullable_drift(spark, d):
    return schema.schema_drift(*pair(spark, d, "orders"))


@query("schema_sampled", "SELECT \"column\", types, CAST(row_count AS INTEGER) AS n FROM (" + _profile({"n_nationkey": "int", "n_name": "str", "n_regionkey": "int"}, "(SELECT * FROM nation ORDER BY n_nationkey LIMIT 10)") + ")")
def schema_sampled(spark, d):
    """A sample is the feature here: the first 10 rows."""
    s = schema.infer_schema(spark.read.parquet(f"{d}/nation.parquet"), sample_size=10, order_by="n_nationkey")
    return spark.createDataFrame([(c.name, ",".join(c.types), s.row_count) for c in s.columns.values()], "column string, types string, n int")


_RAGGED = "CASE event_id % 4 WHEN 0 THEN '{\"k\": 1, \"x\": \"s\"}' WHEN 1 THEN '{\"k\": 1.5}' WHEN 2 THEN '{\"k\": null, \"x\": true}' ELSE props END"


@query(
    "schema_json_observed",
    f"""WITH t AS (SELECT event_id, {_RAGGED} AS j FROM events), p AS (SELECT event_id, key, value FROM t, LATERAL (SELECT key, value FROM json_each(CAST(t.j AS JSON)))),
    f AS (SELECT key, min(event_id) AS o FROM p GROUP BY key), n AS (SELECT key, (SELECT count(*) FROM t WHERE event_id >= f.o) AS reach FROM f),
    y AS (SELECT key, CASE json_type(value) WHEN 'BIGINT' THEN 'int' WHEN 'UBIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' END AS t, json_type(value) = 'NULL' AS nul FROM p)
    SELECT key AS "column", coalesce(string_agg(DISTINCT t, ',' ORDER BY t), '') AS types, count(*) AS present_count, count(*) FILTER (nul) AS null_count, any_value(reach) - count(*) AS missing_count FROM y JOIN n USING (key) GROUP BY key""",
)
def schema_json_observed(spark, d):
    df = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(_RAGGED).alias("value"))
    return schema.json_profile(df, order_by="event_id").select("column", "types", "present_count", "null_count", "missing_count")


# ---------------------------------------------------------------- events


@query("events_presence", _with("orders") + "SELECT 'only_left' AS type, o_orderkey AS id FROM a ANTI JOIN b USING (o_orderkey) UNION ALL SELECT 'only_right', o_orderkey FROM b ANTI JOIN a USING (o_orderkey)")
def events_presence(spark, d):
    return events.presence_frame(*pair(spark, d, "orders"), key="o_orderkey").select("type", F.get_json_object("event", "$.key.o_orderkey").cast("long").alias("id"))


@query("events_duplicates", _with("lines") + "SELECT 'left' AS side, l_orderkey, l_linenumber, count(*) AS n FROM a GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'right', l_orderkey, l_linenumber, count(*) FROM b GROUP BY ALL HAVING count(*) > 1")
def events_duplicates(spark, d):
    e = events.presence_frame(*pair(spark, d, "lines"), key=["l_orderkey", "l_linenumber"]).where("type = 'duplicate_key'")
    at = lambda p, k: F.get_json_object("event", p).cast(k)
    return e.select(at("$.side", "string").alias("side"), at("$.key.l_orderkey", "long").alias("l_orderkey"), at("$.key.l_linenumber", "int").alias("l_linenumber"), at("$.count", "long").alias("n"))


@query("events_field", _with("orders", f"c AS ({_changes()})") + "SELECT 'field_change' AS type, id, field FROM c UNION ALL SELECT DISTINCT 'row_changed', id, NULL FROM c")
def events_field(spark, d):
    e = events.field_frame(*pair(spark, d, "orders"), key="o_orderkey")
    return e.select("type", F.get_json_object("event", "$.key.o_orderkey").cast("long").alias("id"), F.get_json_object("event", "$.column").alias("field"))


@query("events_summary", _with("orders", f"c AS ({_changes()})") + "SELECT 'only_left' AS type, count(*) AS n FROM a ANTI JOIN b USING (o_orderkey) UNION ALL SELECT 'only_right', count(*) FROM b ANTI JOIN a USING (o_orderkey) UNION ALL SELECT 'field_change', count(*) FROM c UNION ALL SELECT 'row_changed', count(DISTINCT id) FROM c")
def events_summary(spark, d):
    a, b = pair(spark, d, "orders")
    return events.event_counts(events.presence_frame(a, b, key="o_orderkey").select("type").union(events.field_frame(a, b, key="o_orderkey").select("type")))


@query("events_schema", f"WITH {_NATIONS} SELECT CASE WHEN l.c IS NULL THEN 'column_added' WHEN r.c IS NULL THEN 'column_removed' ELSE 'type_changed' END AS change, coalesce(l.c, r.c) AS \"column\" FROM l FULL JOIN r ON l.c = r.c WHERE l.types IS DISTINCT FROM r.types")
def events_schema(spark, d):
    a = spark.read.parquet(f"{d}/nation.parquet")
    found = events.schema_diff_result_events(schema.compare_schema(a, a.drop("n_name").withColumn("extra", F.lit(1)).withColumn("n_regionkey", F.col("n_regionkey").cast("string"))))
    return spark.createDataFrame([(e["change"], e["column"]) for e in found if e["type"] == "schema_change"], "change string, column string")


# ---------------------------------------------------------------- sources and sinks: written, read, compared with what was written

_folders = itertools.count()


def _scratch(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = f"file:{tempfile.gettempdir()}"
    top = top.rstrip("/")
    return f"{top}/rowdelta-trip-{os.getpid()}-{next(_folders)}"


def _trip(kind: str, how: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
        path = f"{_scratch(spark)}.{how.get('ending', kind)}"
        if kind == "txt":
            df = df.select(F.col("n_name").alias("value"))
            df.write.text(path)
        else:
            df.write.options(**how.get("write", {})).format(how.get("as", kind)).save(path)
        back = readers.read_file(path, format=kind)
        return _stats(df, back, None).select("only_first", "only_second", "common")

    return run


for _name, _kind, _how in (
    ("csv", "csv", {"write": {"header": True, "escape": '"'}}),
    ("tsv", "tsv", {"as": "csv", "write": {"header": True, "sep": "\t", "escape": '"'}}),
    ("jsonl", "jsonl", {"as": "json"}),
    ("parquet", "parquet", {}),
    ("text", "txt", {}),
    ("gzip", "csv", {"ending": "csv.gz", "write": {"header": True, "compression": "gzip"}}),
):
    QUERIES[f"roundtrip_{_name}"] = _trip(_kind, _how)
    ORACLE[f"roundtrip_{_name}"] = "SELECT CAST(0 AS BIGINT) AS only_first, CAST(0 AS BIGINT) AS only_second, count(*) AS common FROM nation"


@query("csv_quoted_newline", "SELECT CAST(0 AS BIGINT) AS only_first, CAST(0 AS BIGINT) AS only_second, count(*) AS common FROM (SELECT DISTINCT o_orderkey, o_orderstatus, o_orderpriority FROM orders)")
def csv_quoted_newline(spark, d):
    """Fields with line breaks, quotes and delimiters, written and read again."""
    note = F.concat("o_orderstatus", F.lit('\n"'), "o_orderpriority", F.lit('", and\n,'))
    df = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("k"), note.alias("note"))
    path = f"{_scratch(spark)}.csv"
    df.write.option("header", True).option("escape", '"').csv(path)
    return _stats(df, readers.read_file(path, format="csv"), None).select("only_first", "only_second", "common")


_MIXED = "CASE event_id % 3 WHEN 0 THEN concat('{\"k\": ', CAST(event_id AS BIGINT) - event_id % 10, '}') WHEN 1 THEN concat('{\"k\": \"', event_id - event_id % 10, '\"}') ELSE concat('{\"k\": ', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'null' END, '}') END"


@query(
    "jsonl_mixed_keys",
    """WITH f AS (SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN concat('n', event_id - event_id % 10) WHEN 1 THEN concat('s', event_id - event_id % 10) ELSE CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'null' END END AS k FROM events),
    g AS (SELECT DISTINCT concat('n', event_id - event_id % 20) AS k FROM events)
    SELECT (SELECT count(*) FROM f ANTI JOIN g USING (k)) AS only_first, (SELECT count(*) FROM g ANTI JOIN f USING (k)) AS only_second, (SELECT count(*) FROM f SEMI JOIN g USING (k)) AS common""",
)
def jsonl_mixed_keys(spark, d):
    """Keys that are numbers, texts, booleans and nulls against keys that are all numbers, in two files."""
    df, paths = spark.read.parquet(f"{d}/events.parquet"), [f"{_scratch(spark)}.jsonl" for _ in range(2)]
    df.select(F.expr(_MIXED)).write.text(paths[0])
    df.select(F.expr("concat('{\"k\": ', event_id - event_id % 20, '}')")).write.text(paths[1])
    return _stats(*(readers.read_file(p, format="jsonl") for p in paths), "k").select("only_first", "only_second", "common")


@query("jsonl_file_schema", ORACLE["schema_json_observed"])
def jsonl_file_schema(spark, d):
    """The observed schema of a file of ragged objects, in the order of its lines."""
    path = f"{_scratch(spark)}.jsonl"
    spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(_RAGGED).alias("value")).coalesce(1).sortWithinPartitions("event_id").select("value").write.text(path)
    found = schema.json_profile(readers.read_jsonl(path, ragged=True))
    return found.select("column", "types", "present_count", "null_count", "missing_count")


@query("result_rows", _with("orders", "t AS (SELECT 'only_in_first' AS section FROM a ANTI JOIN b USING (o_orderkey) UNION ALL SELECT 'only_in_second' FROM b ANTI JOIN a USING (o_orderkey))") + "SELECT section, count(*) AS n FROM t GROUP BY section")
def result_rows(spark, d):
    """Sections written as a folder and read back."""
    path = _scratch(spark)
    sinks.write_sections(presence.diff(*pair(spark, d, "orders"), key="o_orderkey", preserve_order=False), path, "parquet")
    return spark.read.parquet(path).groupBy("section").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- approximate helpers

_POSITION = "('0x' || substr(md5(concat(s, ':', v)), 1, 15))::BIGINT % m"


@query(
    "bloom_candidates",
    f"""WITH a AS (SELECT CAST(p_partkey AS VARCHAR) AS v FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT CAST(p_partkey AS VARCHAR) AS v FROM part WHERE p_partkey % 4 <> 0),
    n AS (SELECT greatest(1, (SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS n), z AS (SELECT n, greatest(8, CAST(ceil(-n * ln(0.01) / (ln(2) * ln(2))) AS BIGINT)) AS m FROM n),
    s AS (SELECT m, unnest(range(greatest(1, CAST(round(m / n * ln(2)) AS BIGINT)))) AS s FROM z), bits AS (SELECT DISTINCT {_POSITION} AS bit FROM b, s), asked AS (SELECT DISTINCT v, {_POSITION} AS bit FROM a, s)
    SELECT CAST(v AS BIGINT) AS p_partkey FROM asked LEFT JOIN bits ON asked.bit = bits.bit GROUP BY v HAVING count(bits.bit) < count(*)""",
)
def bloom_candidates(spark, d):
    """The filter is sized by the counted rows, in the oracle too."""
    a, b = (x.select("p_partkey") for x in pair(spark, d, "parts"))
    return approx.probabilistic_diff_candidates(a, b, key="p_partkey").only_in_first


@query("fuzzy_pairs")
def fuzzy_pairs(spark, d):
    a = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("value"))
    b = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("value"))
    return fuzzy.compare_fuzzy_strings(a, b, threshold=60, block=lambda c: F.right(c, F.lit(2)), order_by="value").pairs
