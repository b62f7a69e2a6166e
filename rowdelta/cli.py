"""python -m rowdelta compare|diff|intersection|duplicates FILE [FILE]

Exit codes: 0 done; 1 differences or duplicates found, with --fail-on-diff; 2 an error, told in one line.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from typing import Any

from rowdelta.errors import InvalidInputError, RowDeltaError
from rowdelta.functions.normalize import string_normalizer
from rowdelta.functions.sizes import parse_size
from rowdelta.operators import duplicates as dup
from rowdelta.operators import events, fields, presence, schema, sinks
from rowdelta.operators.results import plain
from rowdelta.sources import readers

TWO = ("compare", "diff", "intersection")
FLAG = {"action": "store_true"}
#: Options by group: flags, arguments to argparse.
INPUT = {
    "--format": {"default": "auto"}, "--input-format": {}, "--encoding": {"default": "utf-8"}, "--key": {}, "--delimiter": {}, "--quotechar": {"default": '"'},
    "--no-header": FLAG, "--fieldnames": {}, "--columns": {}, "--parquet-batch-size": {"type": int, "default": 65_536},
}
BACKEND = {"--mode": {"default": "memory"}, "--chunk-size": {"type": int, "default": 100_000}, "--temp-dir": {}, "--disk-limit": {}, "--disk-strategy": {"default": "sqlite"}, "--partition-count": {"type": int}}
OUTPUT = {"--result-mode": {"default": "memory", "choices": ["memory", "file"]}, "--output": {}, "--max-output-rows": {"type": int}, "--max-output-bytes": {}, "--memory-limit": {}, "--include-duplicates": FLAG}
FIELDS = {"--field-diff": FLAG, "--exclude-columns": {}, "--max-rows": {"type": int}, "--max-bytes": {}, "--sorted-input": FLAG}
SCHEMA = {"--schema-diff": FLAG, "--schema-sample-size": {"type": int}, "--empty-string-not-null": FLAG, "--loose-numeric-types": FLAG}
BEHAVIOUR = {"--summary": FLAG, "--fail-on-diff": FLAG, "--lower": FLAG, "--strip": {"action": argparse.BooleanOptionalAction}, "--remove-spaces": FLAG, "--remove-special": FLAG}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="rowdelta", description="Compare two files, or find duplicates in one.")
    commands = out.add_subparsers(dest="command", required=True)
    for name in (*TWO, "duplicates"):
        p = commands.add_parser(name)
        p.add_argument("file_a")
        if name in TWO:
            p.add_argument("file_b")
        for group in (INPUT, BACKEND, BEHAVIOUR, *((OUTPUT,) if name in TWO else ()), *((FIELDS, SCHEMA) if name in TWO[:2] else ())):
            for flag, how in group.items():
                p.add_argument(flag, **how)
    return out


def _names(text: str | None) -> list[str] | None:
    return None if text is None else [t.strip() for t in text.split(",") if t.strip()]


def _lines(path: str) -> bool:
    return str(path).lower().removesuffix(".gz").endswith((".jsonl", ".ndjson"))


def wants_events(a: argparse.Namespace) -> bool:
    """--format jsonl asks for events, unless it can only mean the inputs."""
    return a.command in TWO[:2] and a.format == "jsonl" and (bool(a.input_format) or not (_lines(a.file_a) and _lines(a.file_b)))


def check(a: argparse.Namespace) -> None:
    get = lambda n: getattr(a, n, None)
    ending = "." + str(get("output") or "").rpartition(".")[2].lower()
    limits, output = (get("max_output_rows") is not None or get("max_output_bytes") is not None), get("output")
    rules = [
        (get("field_diff") and get("schema_diff"), "--field-diff and --schema-diff exclude each other"),
        (get("sorted_input") and not get("field_diff"), "--sorted-input goes with --field-diff"),
        (get("field_diff") and not a.key, "--field-diff needs --key"),
        ((get("max_rows") is not None or get("max_bytes") is not None) and not get("field_diff"), "--max-rows and --max-bytes go with --field-diff"),
        ((get("max_output_rows") or 0) < 0, "--max-output-rows must not be negative"),
        (limits and not wants_events(a), "--max-output-rows and --max-output-bytes go with events (--format jsonl)"),
        ((get("field_diff") or get("schema_diff")) and get("result_mode") == "file", "--result-mode file goes with row comparisons only"),
        (get("result_mode") == "file" and not output, "--result-mode file needs --output"),
        (wants_events(a) and output and ending != ".jsonl", "events are written to .jsonl only"),
        (get("schema_diff") and not wants_events(a) and output and ending != ".json", "a schema comparison is written to .json only"),
        (get("field_diff") and output and ending != ".jsonl", "field changes are written to .jsonl only"),
    ]
    for broken, text in rules:
        if broken:
            raise InvalidInputError(text)


def _read(a: argparse.Namespace, path: str):
    kind = a.input_format or ("auto" if wants_events(a) else a.format)
    key = _names(a.key)
    columns = _names(a.columns)
    if columns is not None and (getattr(a, "field_diff", False) or wants_events(a)):
        columns = fields.read_columns(columns, key or None)
    return readers.read_file(path, format=kind, encoding=a.encoding, delimiter=a.delimiter, quotechar=a.quotechar, has_header=not a.no_header, fieldnames=_names(a.fieldnames), columns=columns, batch_size=a.parquet_batch_size)


def _key(a: argparse.Namespace):
    names = _names(a.key)
    return None if not names else names[0] if len(names) == 1 else names


def _normalizer(a: argparse.Namespace):
    if not (a.lower or a.remove_spaces or a.remove_special or a.strip is not None):
        return None
    return string_normalizer(lower=a.lower, strip=a.strip is not False, remove_spaces=a.remove_spaces, remove_special=a.remove_special)


def _summary(result: Any) -> dict[str, Any]:
    if isinstance(result, presence.CompareResult):
        s = result.stats.to_dict()
        same = not any(s[k] for k in ("only_in_first_count", "only_in_second_count", "duplicate_first_count", "duplicate_second_count"))
        return {"equal": same, **{k: v for k, v in s.items() if not k.startswith("unique")}, **{k: result.metadata.get(k) for k in ("backend", "result_mode", "output")}, "warnings": result.warnings}
    if isinstance(result, fields.FieldDiffResult):
        s = result.stats.to_dict()
        return {"equal": not s["changed_row_count"], **s, "summary_by_column": result.summary_by_column, "output": result.metadata.get("output"), "warnings": result.all_warnings()}
    if isinstance(result, schema.SchemaDiffResult):
        lists = {k: getattr(result, k) for k in ("added_columns", "removed_columns", "type_changes", "nullable_changes")}
        counts = {f"{k.rstrip('s')}_count": len(v) for k, v in lists.items()}
        return {"equal": not result.has_changes, **counts, **lists, "left_row_count": result.left_schema.row_count, "right_row_count": result.right_schema.row_count, "warnings": result.warnings}
    return result


def _differs(result: Any, a: argparse.Namespace) -> bool:
    if isinstance(result, dict):
        return a.command == "duplicates" and result["duplicate_count"] > 0
    return a.command != "intersection" and not _summary(result)["equal"]


def _events(a: argparse.Namespace) -> int:
    first, second, key = _read(a, a.file_a), _read(a, a.file_b), _key(a)
    if a.schema_diff:
        stream = events.schema_diff_result_events(_schema(a, first, second))
    elif a.field_diff and a.sorted_input:
        stream = events.iter_sorted_field_diff_events(first, second, key=key, columns=_names(a.columns), exclude_columns=_names(a.exclude_columns), normalizer=_normalizer(a))
    elif a.field_diff:
        stream = events.compare_and_field_events(first, second, key=key, columns=_names(a.columns), exclude_columns=_names(a.exclude_columns), normalizer=_normalizer(a), include_duplicates=a.include_duplicates)
    else:
        stream = events.iter_compare_events(first, second, key=key, normalizer=_normalizer(a), include_common=a.command == "compare", include_duplicates=a.include_duplicates)
    found = False

    def watched():
        nonlocal found
        for e in stream:
            found = found or e["type"] not in ("metadata", "summary")
            yield e

    limits = {"max_output_rows": a.max_output_rows, "max_output_bytes": parse_size(a.max_output_bytes)}
    if a.output:
        with sinks.atomic(a.output) as f:
            sinks.write_jsonl_events(f, watched(), **limits)
    else:
        sinks.write_jsonl_events(sys.stdout, watched(), **limits)
    return int(a.fail_on_diff and found)


def _schema(a: argparse.Namespace, first, second) -> schema.SchemaDiffResult:
    return schema.compare_schema(first, second, sample_size=a.schema_sample_size, empty_string_null=not a.empty_string_not_null, strict_numeric_types=not a.loose_numeric_types)


def run(a: argparse.Namespace) -> int:
    check(a)
    if wants_events(a):
        return _events(a)
    show = lambda x: print(sinks.dumps(x, indent=2, separators=(",", ": ")))
    how = {"mode": a.mode, "chunk_size": a.chunk_size, "temp_dir": a.temp_dir, "disk_limit": a.disk_limit, "disk_strategy": a.disk_strategy} | ({"partition_count": a.partition_count} if a.partition_count is not None else {})
    first, key, norm = _read(a, a.file_a), _key(a), _normalizer(a)
    if a.command == "duplicates":
        found = dup.duplicates(first, key=key, normalizer=norm, **how)
        result: Any = {"duplicate_count": found.count()}
        result["empty"] = not result["duplicate_count"]
        show(result if a.summary else [plain(r) for r in found.toLocalIterator()])
        return int(a.fail_on_diff and _differs(result, a))
    second = _read(a, a.file_b)
    if getattr(a, "schema_diff", False):
        result = _schema(a, first, second)
        if a.output:
            with sinks.atomic(a.output) as f:
                f.write(sinks.dumps(result.to_dict(), indent=2, separators=(",", ": ")))
    elif getattr(a, "field_diff", False):
        result = fields.compare_fields(first, second, key=key, columns=_names(a.columns), exclude_columns=_names(a.exclude_columns), normalizer=norm, output=a.output, max_rows=a.max_rows, max_bytes=a.max_bytes, sorted_input=a.sorted_input)
    else:
        common = a.command != "diff"
        result = presence.compare(first, second, key=key, normalizer=norm, include_common=common, include_duplicates=a.include_duplicates, memory_limit=a.memory_limit, result_mode=a.result_mode, output=a.output, **how)
    if a.command == "intersection":
        n = result.stats.common_count
        show({"count": n, "empty": not n} if a.summary else None if a.output else list(result.iter_section("common")))
    elif a.summary or a.output:
        show(_summary(result))
    else:
        show(result.to_dict())
    return int(a.fail_on_diff and _differs(result, a))


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return run(a)
    except FileNotFoundError as e:
        text = f"no such file: {e.filename}"
    except (RowDeltaError, ValueError, OSError) as e:
        text = str(e)
    except Exception as e:  # Spark's own errors come in many classes
        text = str(e).splitlines()[0]
    print(f"rowdelta: {text.splitlines()[0] if text else 'error'}", file=sys.stderr)
    return 2
