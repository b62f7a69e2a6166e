"""Presence, duplicates and their invariants, against a small model in plain Python."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import rowdelta as rd
from rowdelta.operators.presence import except_rows, intersect_rows


def frame(spark, values, name="value", kind="int"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}").coalesce(1)


def rows(df):
    return [tuple(r) for r in df.collect()]


def model(left, right):
    first = lambda xs: list(dict.fromkeys(xs))
    a, b = first(left), first(right)
    rest = lambda xs: [x for i, x in enumerate(xs) if x in xs[:i]]
    return [x for x in a if x not in b], [x for x in b if x not in a], [x for x in a if x in b], rest(left), rest(right)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=12), st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=12))
def test_sections_match_the_model(spark, left, right):
    r = rd.compare(frame(spark, left), frame(spark, right), include_duplicates=True)
    got = [[v for v in r.iter_section(s)] for s in ("only_in_first", "only_in_second", "common", "duplicates_first", "duplicates_second")]
    assert got == list(model(left, right))
    s = r.stats
    assert (s.first_count, s.second_count) == (len(left), len(right))
    assert s.unique_first_count == s.only_in_first_count + s.common_count
    assert s.unique_second_count == s.only_in_second_count + s.common_count
    assert s.first_count - s.unique_first_count == s.duplicate_first_count


def test_keyed_sections_and_iterators(spark):
    a = spark.createDataFrame([(70, "larch"), (71, "alder")], "id int, name string").coalesce(1)
    b = spark.createDataFrame([(71, "rowan"), (88, "maple")], "id int, name string").coalesce(1)
    r = rd.compare_by_key(a, b, "id")
    assert rows(r.only_in_first) == [(70, "larch")] and rows(r.only_in_second) == [(88, "maple")] and rows(r.common) == [(71, "alder")]
    assert list(r.iter_unique()) == [{"id": 70, "name": "larch"}, {"id": 88, "name": "maple"}]
    assert rows(rd.unique(a, b, key="id")) == [(70, "larch"), (88, "maple")]
    d = rd.diff(a, b, key="id")
    assert d.common is None and d.stats.common_count == 1 and d.stats.duplicate_first_count == 0


def test_keys_null_types_and_composites(spark):
    a = spark.createDataFrame([(1, None), (None, "x")], "k int, v string")
    b = spark.createDataFrame([(1.0, None), (None, "y")], "k double, v string")
    assert rd.compare(a, b, key="k").stats.common_count == 2
    text = spark.createDataFrame([("1", None), (None, "y")], "k string, v string")
    s = rd.compare(a, text, key="k").stats
    assert (s.common_count, s.only_in_first_count, s.only_in_second_count) == (1, 1, 1)
    assert rd.compare(a, b, key=["k", "v"]).stats.common_count == 1
    flag = spark.createDataFrame([(True,)], "k boolean")
    assert rd.compare(flag, frame(spark, [1], "k"), key="k").stats.common_count == 0
    with pytest.raises(rd.KeyExtractionError):
        rd.compare(a, b, key="nope")


def test_whole_rows_with_nested_values_and_column_order(spark):
    a = spark.createDataFrame([(1, ["x"], {"p": 1, "q": 2})], "id int, tags array<string>, m map<string,int>")
    b = spark.createDataFrame([({"q": 2, "p": 1}, ["x"], 1)], "m map<string,int>, tags array<string>, id int")
    assert rd.compare(a, b).stats.common_count == 1
    n = lambda s: spark.createDataFrame([(1.0,), (float("nan"),)], "v double") if s else spark.createDataFrame([(float("nan"),), (-0.0,)], "v double")
    assert rd.compare(n(True), n(False)).stats.common_count == 1
    assert rows(except_rows(frame(spark, [1, 1, 2]), frame(spark, [2]))) == [(1,)]
    assert rows(intersect_rows(frame(spark, [1, 2, 2]), frame(spark, [2]))) == [(2,)]


def test_hash_and_callable_and_normaliser(spark):
    a, b = frame(spark, [" Oslo\t", "Turin"], kind="string"), frame(spark, ["oSLO", "Quito"], kind="string")
    n = rd.string_normalizer(lower=True, remove_spaces=True)
    assert rd.compare(a, b, key="value", normalizer=n).stats.common_count == 1
    assert rd.compare(a, b, normalizer=n).stats.common_count == 1
    assert rd.compare(a, b, key=lambda d: n(d["value"])).stats.common_count == 1
    for algorithm in ("md5", "sha1", "sha256", "sha512", "blake2b", "sha3_256", "shake_128"):
        r = rd.compare_by_hash(a, a, algorithm=algorithm)
        assert r.stats.common_count == 2 and r.stats.strategy == f"hash:{algorithm}"
    with pytest.raises(ValueError):
        rd.compare_by_hash(a, b, algorithm="nope")
    both = rd.compose_normalizers(rd.string_normalizer(lower=True), rd.string_normalizer(remove_special=True))
    assert rows(frame(spark, ["  Ёж-1 x "], kind="string").select(both(F.col("value"))))[0] == ("ёж1x",)
    with pytest.raises(rd.NormalizationError):
        rd.compare(a, b, key="value", normalizer=lambda c: 1 / 0)


def test_duplicates(spark):
    assert [r[0] for r in rows(rd.duplicates(frame(spark, ["a", "b", "a", "a"], kind="string")))] == ["a", "a"]
    d = spark.createDataFrame([(1, 3), (1, 2), (2, 1)], "k int, o int")
    assert rows(rd.duplicates(d, key="k", order_by="o")) == [(1, 3)]
    assert rows(rd.duplicate_groups(d, key="k")) == [(1, 2)]
    assert rows(rd.duplicates(frame(spark, []))) == []


@pytest.mark.parametrize("how", [{"mode": "disk", "disk_strategy": s} for s in ("sqlite", "hash-partition", "external_sort", "auto")] + [{"mode": "auto", "memory_limit": "1KB"}, {"mode": "disk", "disk_strategy": "hash", "partition_count": 3}])
def test_backends_are_hints(spark, how):
    r = rd.compare(frame(spark, [31, 55, 55, 90]), frame(spark, [55, 62, 62, 90]), include_duplicates=True, **how)
    assert rows(r.only_in_first) == [(31,)] and r.stats.duplicate_second_count == 1
    assert r.metadata["backend"] == r.stats.mode


def test_options_are_checked(spark):
    for bad in ({"mode": "x"}, {"chunk_size": 0}, {"disk_strategy": "x"}, {"result_mode": "x"}, {"partition_count": 0}):
        with pytest.raises(ValueError):
            rd.compare(frame(spark, [1]), frame(spark, [1]), **bad)
    assert rd.compare(frame(spark, []), frame(spark, [])).stats.first_count == 0
    assert rd.compare(frame(spark, [1]), frame(spark, [1]), include_stats=False).stats == rd.CompareStats()


@pytest.mark.parametrize("order", [None, "o"])
def test_rows_of_all_sections_are_those_of_each_and_group_once(spark, order):
    a = spark.createDataFrame([(5, "e", 9), (3, None, 1), (5, "x", 2), (8, "q", 4)], "k int, v string, o int").coalesce(1)
    b = spark.createDataFrame([(8, "r", 3), (1, "s", 2), (1, "t", 1)], "k int, v string, o int").coalesce(1)
    for duplicates in (False, True):
        r = rd.compare(a, b, key="k", include_duplicates=duplicates, order_by=order)
        apart = rd.CompareResult(r.sections, r.counter)
        assert rows(r.rows()) == rows(apart.rows())
    plan = rd.compare(a, b, key="k").rows()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1


def test_sections_of_a_written_result_come_from_its_file(spark, tmp_path):
    a, b = frame(spark, [31, 55, None]), frame(spark, [55, 62])
    for name in ("w.jsonl", "w.csv"):
        r = rd.compare(a, b, output=tmp_path / name)
        assert list(r.iter_section("only_in_first")) == [31, None] and list(r.iter_unique()) == [31, None, 62]
        (tmp_path / name).write_text((tmp_path / name).read_text().replace("31", "32"))
        assert next(r.iter_unique()) == 32


def test_bloom_candidates_with_null_and_repeated_values(spark):
    a, b = frame(spark, [7, 7, None, 9]), frame(spark, [9, None])
    c = rd.probabilistic_diff_candidates(a, b, key="value", false_positive_rate=1e-6)
    assert sorted(rows(c.only_in_first), key=str) == [(7,), (7,), (None,)] and rows(c.only_in_second) == [(None,)]
