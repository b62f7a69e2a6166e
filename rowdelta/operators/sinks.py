"""Results as files, and files as results.

A single file is written by the driver from a local iterator, next to its name and then moved there, so it is whole or
absent. `write_sections` writes a folder from all executors, which is the way for large results.
"""

from __future__ import annotations

import csv
import json
import os
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdelta.errors import CorruptedInputError, InvalidInputError, UnsupportedFormatError
from rowdelta.operators.results import CompareResult
from rowdelta.sources.readers import session


def dumps(value: Any, **how) -> str:
    return json.dumps(value, ensure_ascii=False, default=str, **({"separators": (",", ":")} | how))


@contextmanager
def atomic(path) -> Iterator[Any]:
    """A text file that takes its name only once it is whole."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            yield f
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def suffix(path, *allowed: str) -> str:
    out = Path(path).suffix.lower()
    if out not in allowed:
        raise UnsupportedFormatError(f"{path}: only {', '.join(allowed)}")
    return out


def write_result(result: CompareResult, output) -> None:
    """.json: one object; .jsonl and .csv: a line for each row, (section, value)."""
    kind = suffix(output, ".json", ".jsonl", ".csv")
    with atomic(output) as f:
        if kind == ".json":
            f.write(dumps(result.to_dict(), indent=2, separators=(",", ": ")))
            return
        rows = ((r.section, r.value) for r in result.rows().toLocalIterator())
        if kind == ".csv":
            out = csv.writer(f)
            out.writerow(("section", "value"))
            out.writerows(rows)
        else:
            f.writelines(f'{{"section":{dumps(s)},"value":{v}}}\n' for s, v in rows)


def write_sections(result: CompareResult, folder: str, format: str = "json") -> None:  # noqa: A002
    """(section, value) as a folder of part files."""
    if format not in ("json", "csv", "parquet"):
        raise UnsupportedFormatError(f"{format!r}: only json, csv, parquet")
    result.rows().write.format(format).option("header", True).save(folder)


def iter_result_rows(output, sections: Iterable[str] | None = None) -> Iterator[dict[str, Any]]:
    """Rows of a written result, as they come, of the sections named or of all."""
    kind, wanted = suffix(output, ".jsonl", ".csv"), None if sections is None else set(sections)
    with open(output, encoding="utf-8", newline="") as f:
        rows = ({"section": r["section"], "value": json.loads(r["value"])} for r in csv.DictReader(f)) if kind == ".csv" else _json_lines(f, output)
        yield from (r for r in rows if wanted is None or r["section"] in wanted)


def iter_result_values(output, sections: Iterable[str] | None = None) -> Iterator[Any]:
    return (r["value"] for r in iter_result_rows(output, sections))


def read_result_rows(output: str, sections: Iterable[str] | None = None) -> DataFrame:
    """A result that was written as .jsonl, as a frame (section, value as JSON text)."""
    df = session().read.schema("section string, value string").json(str(output))
    return df if sections is None else df.where(F.col("section").isin(list(sections)))


def _json_lines(f, name) -> Iterator[Any]:
    for i, line in enumerate(f, 1):
        if line.strip():
            try:
                yield json.loads(line)
            except ValueError as e:
                raise CorruptedInputError(f"{name}:{i}: {e}") from e


def write_field_rows(rows: DataFrame, output, max_rows: int | None = None, max_bytes: int | None = None) -> tuple[int, int, bool]:
    """Field changes as JSON lines: rows written, bytes, and whether any was left out. A row that does not fit is passed over, later ones are tried."""
    suffix(output, ".jsonl")
    n = size = 0
    cut = False
    with atomic(output) as f:
        for r in rows.select(F.to_json(F.struct("key", "changes"), {"ignoreNullFields": "false"}).alias("v")).toLocalIterator():
            if max_rows is not None and n >= max_rows:
                cut = True
                break
            line = r.v + "\n"
            more = len(line.encode())
            if max_bytes is not None and size + more > max_bytes:
                cut = True
                continue
            f.write(line)
            n, size = n + 1, size + more
    return n, size, cut


def iter_field_diff_rows(output) -> Iterator[dict[str, Any]]:
    suffix(output, ".jsonl")
    with open(output, encoding="utf-8") as f:
        for row in _json_lines(f, output):
            if not isinstance(row, dict):
                raise InvalidInputError(f"{output}: a line that is no object")
            yield row


def read_field_rows(output: str, key_schema: str) -> DataFrame:
    """Written field changes as a frame; key_schema, such as 'id bigint', types the key."""
    return session().read.schema(f"key struct<{key_schema.replace(' ', ':')}>, changes array<struct<field:string,left:string,right:string>>").json(str(output))


class JsonlWriter:
    """Events as JSON lines, with limits on data events; metadata and summary are always written."""

    ENVELOPE = ("metadata", "summary")

    def __init__(self, fp, *, buffer: int = 1000, max_output_rows: int | None = None, max_output_bytes: int | None = None):
        if max_output_rows is not None and max_output_rows < 0:
            raise InvalidInputError("max_output_rows must not be negative")
        self.fp, self.buffer, self.max_rows, self.max_bytes = fp, max(1, buffer), max_output_rows, max_output_bytes
        self.lines: list[str] = []
        self.rows = self.bytes = self.count = 0
        self.truncated = False

    def write(self, event: dict[str, Any]) -> bool:
        line = dumps(event) + "\n"
        if event.get("type") not in self.ENVELOPE:
            size = len(line.encode())
            if (self.max_rows is not None and self.rows >= self.max_rows) or (self.max_bytes is not None and self.bytes + size > self.max_bytes):
                self.truncated = True
                return False
            self.rows, self.bytes = self.rows + 1, self.bytes + size
        self.count += 1
        self.lines.append(line)
        if len(self.lines) >= self.buffer:
            self.flush()
        return True

    def flush(self) -> None:
        self.fp.writelines(self.lines)
        self.lines.clear()


def write_jsonl_events(fp, events: Iterable[dict[str, Any]], **limits) -> int:
    """Number of events written."""
    out = JsonlWriter(fp, **limits)
    for e in events:
        out.write(e)
    out.flush()
    return out.count
