import json

import pytest

import rowdelta as rd
from rowdelta.operators import events, fields, schema, sinks
from rowdelta.streaming import merge


def changes(result):
    return [(tuple(r.key), [tuple(c) for c in r.changes]) for r in result.rows.collect()]


def test_changes_summary_and_limits(spark, tmp_path):
    a = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", None)], "id int, name string, city string").coalesce(1)
    b = spark.createDataFrame([(1, "A", "x"), (2, "b", None), (3, "c", None), (9, "z", "z")], "id int, name string, city string").coalesce(1)
    r = rd.compare_fields(a, b, key="id")
    assert changes(r) == [((1,), [("name", "a", "A")]), ((2,), [("city", "y", None)])]
    assert r.summary_by_column == {"city": 1, "name": 1}
    s = r.stats
    assert (s.first_count, s.second_count, s.compared_count, s.changed_row_count, s.changed_field_count, s.truncated) == (3, 4, 3, 2, 2, False)
    r = rd.compare_fields(a, b, key="id", max_rows=1)
    assert len(changes(r)) == 1 and r.stats.truncated and r.stats.changed_row_count == 2
    out = tmp_path / "f.jsonl"
    r = rd.compare_fields(a, b, key="id", output=out, max_bytes=90)
    assert r.stats.truncated and list(rd.iter_field_diff_rows(out)) and r.stats.output_bytes <= 90
    assert rd.compare_fields(a, b, key="id", columns=()).stats.changed_row_count == 0
    assert rd.compare_fields(a, b, key="id", exclude_columns=["name"]).summary_by_column == {"city": 1}
    from pyspark.sql import functions as F

    assert rd.compare_fields(a, b, key="id", columns=["name"], normalizer=F.lower).stats.changed_row_count == 0
    for bad in ({"key": None}, {"key": "id", "max_rows": -1}, {"key": "id", "max_bytes": 1}):
        with pytest.raises(rd.InvalidInputError):
            rd.compare_fields(a, b, **bad)


def test_duplicates_null_keys_types_and_missing_columns(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n")], "id int, v string").coalesce(1)
    b = spark.createDataFrame([(1, "a"), (1, "x"), (None, "m")], "id int, v string").coalesce(1)
    r = rd.compare_fields(a, b, key="id")
    assert changes(r) == [((1,), [("v", "b", "a")]), ((None,), [("v", "n", "m")])]
    assert fields.REPEATED in r.all_warnings()
    assert [x["key"] for x in rd.iter_field_diff_sorted(a.where("id IS NOT NULL"), b.where("id IS NOT NULL"), key="id")] == []
    x, y = spark.createDataFrame([(1, 5, 1.0)], "id int, n int, d double"), spark.createDataFrame([(1, 5.0, "t")], "id int, n double, e string")
    assert changes(rd.compare_fields(x, y, key="id")) == [((1,), [("d", "1.0", None), ("e", None, "t")])]
    nan = spark.createDataFrame([(1, float("nan"))], "id int, d double")
    assert rd.compare_fields(nan, nan, key="id").stats.changed_row_count == 0
    assert rd.compare_fields(nan, nan, key="id", nan_equal=False).stats.changed_row_count == 1


def test_sorted(spark, tmp_path):
    a = spark.createDataFrame([(10,), (25,), (25,), (60,)], "id int").coalesce(1)
    b = spark.createDataFrame([(25,), (33,), (33,), (60,)], "id int").coalesce(1)
    got = [(r["section"], r["value"]["id"]) for r in rd.iter_sorted_diff(a, b, key="id", include_common=True, include_duplicates=True)]
    assert got == [("only_in_first", 10), ("common", 25), ("duplicates_first", 25), ("only_in_second", 33), ("duplicates_second", 33), ("common", 60)]
    with pytest.raises(rd.InvalidInputError):
        list(rd.iter_sorted_diff(spark.createDataFrame([(2,), (1,)], "id int").coalesce(1), b, key="id"))
    assert merge.order_violations(spark.range(0, 100, 1, 7).toDF("id"), "id") == 0
    for name in ("s.jsonl", "s.csv"):
        assert rd.write_sorted_diff(a, b, tmp_path / name, key="id") == 2
        assert [r["value"] for r in rd.iter_result_rows(tmp_path / name)] == [{"id": 10}, {"id": 33}]


def test_schema(spark):
    a = spark.createDataFrame([(1, "x", 1.5, 1), (2, "", None, 2)], "id int, name string, score double, fax int")
    b = spark.createDataFrame([(1, "x", "s", "e")], "id int, name string, score string, mobile string")
    s = rd.infer_schema(a)
    assert s.columns["name"].nullable and s.columns["name"].null_count == 1 and s.columns["score"].types == ("float",) and not s.columns["id"].nullable
    assert not rd.infer_schema(a, empty_string_null=False).columns["name"].nullable
    assert rd.infer_schema(a, strict_numeric_types=False).columns["id"].types == ("number",)
    d = rd.compare_schema(a, b)
    assert d.added_columns == ["mobile"] and d.removed_columns == ["fax"] and [c["column"] for c in d.type_changes] == ["score"] and d.has_changes
    one = rd.infer_schema(a.coalesce(1), sample_size=1)
    assert one.sampled and one.row_count == 1 and one.warnings
    with pytest.raises(rd.InvalidInputError):
        rd.infer_schema(a, sample_size=-1)
    kinds = [e.get("change") for e in events.schema_diff_result_events(d)]
    assert kinds == [None, "column_added", "column_removed", "type_changed", "nullable_changed", "nullable_changed", None]


def test_ragged_json_counts_missing_only_after_the_first(spark):
    rows = ['{"a": 1}', '{"a": 1.5, "b": "x"}', '{"a": null, "b": ""}', '{"b": {"c": 1}}']
    df = spark.createDataFrame(list(enumerate(rows)), "o int, value string")
    got = {r["column"]: (r.types, r.present_count, r.null_count, r.missing_count) for r in schema.json_profile(df, order_by="o").collect()}
    assert got == {"a": ("float,int", 3, 1, 1), "b": ("object,str", 3, 1, 0)}


def test_events(spark, tmp_path):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string").coalesce(1)
    b = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string").coalesce(1)
    got = list(rd.iter_compare_events(a, b, key="id", include_duplicates=True, created_at="t"))
    assert [e["type"] for e in got] == ["metadata", "only_left", "only_right", "duplicate_key", "summary"]
    assert got[3] == {"type": "duplicate_key", "key": {"id": 2}, "side": "left", "count": 2} and got[-1]["common_rows"] == 1
    found = list(rd.iter_field_diff_events(a, b, key="id"))
    assert [e["type"] for e in found] == ["metadata", "row_changed", "field_change", "row_changed", "field_change", "summary"]
    assert [e["type"] for e in rd.iter_sorted_field_diff_events(a, b, key="id")] == ["metadata", "row_changed", "field_change", "summary"]
    path = tmp_path / "e.jsonl"
    with open(path, "w") as f:
        assert sinks.write_jsonl_events(f, got, max_output_rows=1) == 3
    assert rd.summarize_event_file(path).to_dict()["only_right"] == 1  # the stream's own summary counts
    assert rd.summarize_events(got[:-1]).to_dict()["duplicate_keys_left"] == 1
    (tmp_path / "bad.jsonl").write_text(json.dumps(got[1]) + "\n")
    with pytest.raises(rd.InvalidInputError):
        list(rd.iter_event_rows(tmp_path / "bad.jsonl"))
    with pytest.raises(rd.InvalidInputError):
        events.validate_event({"type": "summary"})


def test_bloom_and_fuzzy(spark):
    f = rd.build_bloom_filter(range(1000))
    assert (f.bit_count, f.hash_count) == (9586, 7) and all(i in f for i in range(1000))
    assert sum(i in f for i in range(1000, 3000)) < 60
    a, b = (spark.createDataFrame([(x,) for x in xs], "value int") for xs in ([1, 2, 3], [3, 4]))
    c = rd.probabilistic_diff_candidates(a, b, false_positive_rate=0.0001)
    assert sorted(r[0] for r in c.only_in_first.collect()) == [1, 2] and [r[0] for r in c.only_in_second.collect()] == [4]
    x, y = (spark.createDataFrame([(v,) for v in vs], "value string").coalesce(1) for vs in (["Harbour Lane", "Mill"], ["harbor lane", "Quay"]))
    r = rd.compare_fuzzy_strings(x, y, threshold=75, normalizer=rd.string_normalizer(lower=True))
    assert [(p.first, p.second) for p in map(lambda q: type("P", (), {"first": q[0], "second": q[1]}), r.common.collect())] == [("Harbour Lane", "harbor lane")]
    with pytest.raises(rd.InvalidInputError):
        rd.compare_fuzzy_strings(x, y, threshold=101)
