import gzip
import json
from dataclasses import dataclass

import pytest

import rowdelta as rd
from rowdelta.cli import main
from rowdelta.functions.sizes import parse_size
from rowdelta.sources import readers


@pytest.fixture
def files(tmp_path):
    out = {}
    for name, text in {"a.csv": "id,name\n11,fig\n12,plum\n", "b.csv": "id,name\n12,plum\n13,pear\n", "a.tsv": "id\tname\n1,5\tA\n", "a.jsonl": '{"id":1}\n\n{"id":2}\n', "b.jsonl": '{"id":2}\n{"id":3}\n', "d.txt": "moss\nfern\nmoss\nreed\nfern\n", "semi.csv": "1;x\n2;y\n", "c.csv": "id,name\n11,fig\n12,quince\n"}.items():
        out[name] = tmp_path / name
        out[name].write_text(text)
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write('id,name\n1,"A ""x"""\n2,\n')
    out["a.csv.gz"] = tmp_path / "a.csv.gz"
    return {k: str(v) for k, v in out.items()}


def test_readers(spark, files, tmp_path):
    assert [tuple(r) for r in readers.read_file(files["a.csv.gz"]).collect()] == [("1", 'A "x"'), ("2", "")]
    assert readers.read_tsv(files["a.tsv"]).collect()[0][0] == "1,5"
    assert readers.read_csv(files["semi.csv"], delimiter=";", has_header=False, fieldnames=["k", "v"]).columns == ["k", "v"]
    assert readers.read_csv(files["semi.csv"], delimiter=";", has_header=False).collect()[0].value == ["1", "x"]
    assert readers.read_jsonl(files["a.jsonl"]).count() == 2
    assert [r.value for r in readers.read_text(files["d.txt"]).collect()] == ["moss", "fern", "moss", "reed", "fern"]
    spark.range(3).toDF("id").write.parquet(str(tmp_path / "p.parquet"))
    assert readers.read_file(tmp_path / "p.parquet", columns=["id"]).count() == 3
    (tmp_path / "mixed.jsonl").write_text('1\n{"a": 2}\n')
    assert readers.read_jsonl(tmp_path / "mixed.jsonl").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 2}\n{oops\n')
    with pytest.raises(rd.CorruptedInputError, match=":2"):
        readers.read_jsonl(tmp_path / "bad.jsonl")
    with pytest.raises(rd.InvalidInputError):
        readers.read_parquet(tmp_path / "p.parquet", batch_size=0)
    for name, kind in {"x.CSV.gz": "csv", "x.tab": "tsv", "x.ndjson": "jsonl", "x.log": "txt"}.items():
        assert readers.infer_format(name) == kind
    with pytest.raises(rd.UnsupportedFormatError):
        readers.infer_format("x.xlsx")
    assert parse_size("1.5 KB") == 1536 and parse_size(None) is None


def test_connectors(spark, files):
    @dataclass
    class User:
        id: int
        name: str

    r = rd.compare_sources([User(1, "a"), User(2, "b")], [{"id": 2, "name": "b"}], key="id")
    assert r.stats.common_count == 1 and r.metadata["connectors"]["first"]["name"] == "iterable"
    assert rd.compare_files(files["a.csv"], files["b.csv"], key="id").stats.to_dict()["only_in_first_count"] == 1
    assert [r.value for r in rd.duplicates_source(rd.TextConnector(files["d.txt"])).collect()] == ["moss", "fern"]
    assert {"csv", "pq", "table", "iterable"} <= set(rd.list_connectors())
    rd.register_connector("My-Source", lambda: rd.IterableConnector([1, 2]))
    assert rd.create_connector("my_source").open().count() == 2
    with pytest.raises(rd.InvalidInputError):
        rd.create_connector("nope")
    assert isinstance(rd.connect(spark.range(1)), rd.SourceConnector)
    assert rd.compare_fields_files(files["a.csv"], files["c.csv"], key="id").summary_by_column == {"name": 1}
    assert not rd.compare_file_schema(files["a.csv"], files["b.csv"]).has_changes


@pytest.mark.parametrize("name", ["r.json", "r.jsonl", "r.csv"])
def test_result_files(spark, files, tmp_path, name):
    out = tmp_path / name
    rd.compare_files(files["a.csv"], files["b.csv"], key="id", output=out)
    if name == "r.json":
        assert json.loads(out.read_text())["only_in_first"] == [{"id": "11", "name": "fig"}]
    else:
        assert [r["section"] for r in rd.iter_result_rows(out)] == ["only_in_first", "only_in_second", "common"]
        assert list(rd.iter_result_values(out, ["common"])) == [{"id": "12", "name": "plum"}]
    with pytest.raises(rd.UnsupportedFormatError):
        rd.compare_files(files["a.csv"], files["b.csv"], key="id", output=tmp_path / "r.xml")
    assert not list(tmp_path.glob(".r*"))


def test_cli(spark, files, tmp_path, capsys):
    def run(*args):
        code = main([str(a) for a in args])
        text = capsys.readouterr()
        return code, text.out, text.err

    code, out, _ = run("compare", files["a.csv"], files["b.csv"], "--key", "id", "--summary", "--fail-on-diff")
    assert code == 1 and json.loads(out)["common_count"] == 1 and not json.loads(out)["equal"]
    code, out, _ = run("intersection", files["a.csv"], files["b.csv"], "--key", "id")
    assert code == 0 and json.loads(out) == [{"id": "12", "name": "plum"}]
    code, out, _ = run("duplicates", files["d.txt"], "--fail-on-diff")
    assert code == 1 and json.loads(out) == ["moss", "fern"]
    code, out, _ = run("diff", files["a.csv"], files["c.csv"], "--key", "id", "--field-diff", "--format", "jsonl")
    assert code == 0 and [json.loads(x)["type"] for x in out.splitlines()] == ["metadata", "row_changed", "field_change", "summary"]
    code, out, _ = run("diff", files["a.csv"], files["b.csv"], "--key", "id", "--format", "jsonl", "--max-output-rows", "1", "--fail-on-diff")
    assert code == 1 and [json.loads(x)["type"] for x in out.splitlines()] == ["metadata", "only_left", "summary"]
    code, out, _ = run("compare", files["a.csv"], files["b.csv"], "--schema-diff", "--summary")
    assert code == 0 and json.loads(out)["equal"]
    code, out, _ = run("diff", files["a.csv"], files["c.csv"], "--key", "id", "--field-diff", "--output", tmp_path / "f.jsonl")
    assert code == 0 and (tmp_path / "f.jsonl").exists()
    for args in (("compare", files["a.csv"], files["b.csv"], "--field-diff"), ("compare", "none.csv", files["b.csv"]), ("diff", files["a.csv"], files["b.csv"], "--sorted-input"), ("compare", files["a.csv"], files["b.csv"], "--max-output-rows", "1")):
        code, _, err = run(*args)
        assert code == 2 and len(err.strip().splitlines()) == 1


def test_rows_that_break_in_quotes(spark, tmp_path):
    from rowdelta.sources import readers

    (tmp_path / "plain.csv").write_text('sku,note\nA-7,"oak, ""solid"""\nB-2,pine\n')
    (tmp_path / "broken.csv").write_text('sku,note\nA-7,"oak\nsolid"\nB-2,"""\n"""\n')
    assert not readers.breaks_in_quotes(tmp_path / "plain.csv") and readers.breaks_in_quotes(tmp_path / "broken.csv")
    assert [tuple(r) for r in readers.read_file(tmp_path / "plain.csv").collect()] == [("A-7", 'oak, "solid"'), ("B-2", "pine")]
    assert [tuple(r) for r in readers.read_file(tmp_path / "broken.csv").collect()] == [("A-7", "oak\nsolid"), ("B-2", '"\n"')]


def test_json_lines_of_mixed_types(spark, tmp_path):
    import rowdelta as rd
    from rowdelta.sources import readers

    (tmp_path / "mixed.jsonl").write_text('{"k":1,"w":"x"}\n{"k":true,"w":null}\n{"k":"1"}\n{"k":2.5,"w":"y"}\n')
    (tmp_path / "whole.jsonl").write_text('{"k":1,"w":"z"}\n{"k":2,"w":"y"}\n')
    a, b = (readers.read_file(tmp_path / f"{n}.jsonl") for n in ("mixed", "whole"))
    assert [t for _, t in a.dtypes] == ["variant", "string"] and [t for _, t in b.dtypes] == ["bigint", "string"]
    stats = rd.compare(a, b, key="k").stats
    assert (stats.unique_first_count, stats.common_count, stats.only_in_second_count) == (4, 1, 1)
    assert [(r["changes"][0]["left"], r["changes"][0]["right"]) for r in rd.compare_fields(a, b, key="k").to_dict()["rows"]] == [("x", "z")]
    left = rd.compare_file_schema(tmp_path / "mixed.jsonl", tmp_path / "whole.jsonl").left_schema.columns
    assert left["k"].types == ("bool", "float", "int", "str") and (left["w"].null_count, left["w"].missing_count) == (1, 1)


def test_a_file_result_needs_an_output(spark):
    import rowdelta as rd

    df = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(rd.InvalidInputError):
        rd.compare(df, df, key="id", result_mode="file")
    assert rd.build_bloom_filter(["A "], normalizer=lambda v: v.strip().lower()).__contains__("a")
