"""Every registered query of the comparison operators against its oracle, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from rowdelta import queries

DIR = "/root/testdata/sf0.001"


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.ORACLE) <= set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    df = queries.QUERIES[name](spark, DIR)
    con.execute(queries.ORACLE[name])
    order = [c[0] for c in con.description]
    got = sorted(map(str, (tuple(r) for r in df.select(*(f"`{c}`" for c in order)).collect())))
    assert got == sorted(map(str, con.fetchall()))


def test_bloom_candidates_finds_most_rows_of_a_larger_table(spark, tmp_path):
    part = spark.range(1, 20_001).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "1 AS p_size")
    part.write.parquet(str(tmp_path / "part.parquet"))
    real = {i for i in range(1, 20_001) if i % 3 and not i % 4}
    got = {r.p_partkey for r in queries.QUERIES["bloom_candidates"](spark, str(tmp_path)).collect()}
    assert got <= real and len(got) > 0.97 * len(real)
