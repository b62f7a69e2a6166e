"""The event stream: what a comparison found, as typed JSON objects between a metadata and a summary event.

`*_frame` functions give events as DataFrames (phase, place, type, and the event's JSON) for large outputs; `iter_*`
functions stream them to the driver in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import rowdelta
from rowdelta.errors import CorruptedInputError, InvalidInputError
from rowdelta.operators import fields, presence
from rowdelta.operators.schema import SchemaDiffResult
from rowdelta.plans import keys
from rowdelta.plans.keys import ORDER, TOKEN, KeySpec

FORMAT, FORMAT_VERSION = "rowdelta.jsonl", "1.0"
#: Counters of a summary event, fixed names.
COUNTERS = ("left_rows", "right_rows", "common_rows", "only_left", "only_right", "changed_rows", "changed_fields", "duplicate_keys_left", "duplicate_keys_right", "schema_changes")
#: Fields that each type must have, beside `type`; fixed values.
REQUIRED = {
    "metadata": ("format", "format_version", "tool", "tool_version", "mode", "key_columns", "compared_columns", "created_at"),
    "only_left": ("key",), "only_right": ("key",), "row_changed": ("key", "changed_columns"), "field_change": ("key", "column", "left", "right"),
    "duplicate_key": ("side", "key", "count"), "schema_change": ("change", "column"), "error": ("code", "message"), "summary": COUNTERS,
}


def validate_event(event: Mapping[str, Any]) -> None:
    kind = event.get("type")
    if kind not in REQUIRED:
        raise InvalidInputError(f"unknown event type {kind!r}")
    lacking = [f for f in REQUIRED[kind] if f not in event]
    if lacking:
        raise InvalidInputError(f"a {kind} event lacks {', '.join(lacking)}")
    if kind == "metadata" and (event["format"], event["format_version"]) != (FORMAT, FORMAT_VERSION):
        raise InvalidInputError(f"format {event['format']} {event['format_version']} is not {FORMAT} {FORMAT_VERSION}")


def build_metadata_event(mode: str = "diff", key_columns=(), compared_columns=(), created_at: str | None = None) -> dict[str, Any]:
    now = created_at or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {"type": "metadata", "format": FORMAT, "format_version": FORMAT_VERSION, "tool": "rowdelta", "tool_version": rowdelta.__version__, "mode": mode, "key_columns": list(key_columns), "compared_columns": list(compared_columns), "created_at": now}


def build_summary_event(elapsed_seconds: float | None = None, peak_mb: float | None = None, **counts: int) -> dict[str, Any]:
    out = {"type": "summary", **dict.fromkeys(COUNTERS, 0), **counts}
    return out | {k: v for k, v in (("elapsed_seconds", elapsed_seconds), ("peak_mb", peak_mb)) if v is not None}


@dataclass
class EventSummary:
    """Counters of a stream. A stream's own summary, where it has one, overrides what was counted."""

    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))
    error_count: int = 0
    event_count: int = 0

    _ADDS = {"only_left": "only_left", "only_right": "only_right", "row_changed": "changed_rows", "field_change": "changed_fields", "schema_change": "schema_changes"}

    def observe(self, event: Mapping[str, Any]) -> None:
        validate_event(event)
        self.event_count += 1
        kind = event["type"]
        if kind in self._ADDS:
            self.counts[self._ADDS[kind]] += 1
        elif kind == "duplicate_key":
            self.counts[f"duplicate_keys_{event['side']}"] += 1
        elif kind == "error":
            self.error_count += 1
        elif kind == "summary":
            self.counts |= {k: event[k] for k in COUNTERS}

    def to_event(self) -> dict[str, Any]:
        return build_summary_event(**self.counts)

    def to_dict(self) -> dict[str, int]:
        return self.counts | {"error_count": self.error_count, "event_count": self.event_count}


def _key(df: DataFrame, key: KeySpec, row: str | None = None) -> Column:
    """The key as it is in the row, not normalised, as a struct."""
    at = (lambda c: F.col(row).getField(c)) if row else (lambda c: F.col(f"`{c}`"))
    named = keys.names(key)
    if named:
        return F.struct(*(at(n).alias(n) for n in named))
    if callable(key):
        return F.struct(F.col(TOKEN).getField("k0").alias("value"))
    return F.struct((at("value") if df.columns == ["value"] else F.struct(*(at(c).alias(c) for c in df.columns))).alias("value"))


def _json(**columns: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in columns.items())), {"ignoreNullFields": "false"})


def presence_frame(first: DataFrame, second: DataFrame, *, key: KeySpec, normalizer=None, include_duplicates: bool = True, order_by=None) -> DataFrame:
    """(phase, place, type, event): only_left, only_right and, with include_duplicates, duplicate_key events with the key's row count."""
    a, b = keys.sides(first, second, key, normalizer, order_by)
    by_token = presence.grouped(a, b)
    parts = []
    for phase, kind, where, df, row, place, n in (
        (1, "only_left", "nr = 0", first, "first", "o1", "nl"), (2, "only_right", "nl = 0", second, "second", "o2", "nr"),
        (3, "duplicate_key", "nl > 1", first, "first", "o1", "nl"), (4, "duplicate_key", "nr > 1", second, "second", "o2", "nr"),
    ):
        if kind == "duplicate_key" and not include_duplicates:
            continue
        more = {"side": F.lit("left" if phase == 3 else "right"), "count": F.col(n)} if kind == "duplicate_key" else {}
        parts.append(by_token.where(where).select(F.lit(phase).alias("phase"), F.col(place).alias("place"), F.lit(kind).alias("type"), _json(type=F.lit(kind), key=_key(df, key, row), **more).alias("event")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def field_frame(first: DataFrame, second: DataFrame, *, key: KeySpec, **how) -> DataFrame:
    """(phase, place, n, type, event): row_changed, then its field_change events."""
    rows = fields.field_changes(first, second, key=key, **how).where(F.size("changes") > 0)
    changed = rows.select(F.lit(5).alias("phase"), F.col(ORDER).alias("place"), F.lit(0).alias("n"), F.lit("row_changed").alias("type"), _json(type=F.lit("row_changed"), key=F.col("key"), changed_columns=F.col("changes.field")).alias("event"))
    each = rows.select(ORDER, "key", F.posexplode("changes").alias("i", "c")).select(F.lit(5), ORDER, F.col("i") + 1, F.lit("field_change"), _json(type=F.lit("field_change"), key=F.col("key"), column=F.col("c.field"), left=F.col("c.left"), right=F.col("c.right")))
    return changed.union(each)


def _stream(frame: DataFrame, *order: str) -> Iterator[dict[str, Any]]:
    for r in frame.orderBy(*order).select("event").toLocalIterator():
        yield json.loads(r.event)


def iter_compare_events(first: DataFrame, second: DataFrame, *, key: KeySpec = None, normalizer=None, include_common: bool = False, include_duplicates: bool = False, order_by=None, created_at: str | None = None) -> Iterator[dict[str, Any]]:
    yield build_metadata_event("compare" if include_common else "diff", keys.names(key), created_at=created_at)
    yield from _stream(presence_frame(first, second, key=key, normalizer=normalizer, include_duplicates=include_duplicates, order_by=order_by), "phase", "place")
    n = presence.presence_counts(*keys.sides(first, second, key, normalizer)).first()
    more = {"duplicate_keys_left": n.nl - n["first"], "duplicate_keys_right": n.nr - n.second} if include_duplicates else {}
    yield build_summary_event(left_rows=n.nl, right_rows=n.nr, common_rows=n.common, only_left=n.only_first, only_right=n.only_second, **more)


def _field_events(first, second, key, created_at, mode, order, **how) -> Iterator[dict[str, Any]]:
    columns = fields.compared_columns(first, second, key, how.get("columns"), how.get("exclude_columns"))
    yield build_metadata_event(mode, keys.names(key), columns, created_at)
    seen = EventSummary()
    for e in _stream(field_frame(first, second, key=key, **how), *order):
        seen.observe(e)
        yield e
    rows = {} if how.get("first_only") else {"left_rows": first.count(), "right_rows": second.count()}
    yield build_summary_event(**rows, changed_rows=seen.counts["changed_rows"], changed_fields=seen.counts["changed_fields"])


def iter_field_diff_events(first: DataFrame, second: DataFrame, *, key: KeySpec, created_at: str | None = None, **how) -> Iterator[dict[str, Any]]:
    """Changed rows and fields only; what is on one side is not reported here."""
    return _field_events(first, second, key, created_at, "field_diff", ("phase", "place", "n"), **how)


def iter_sorted_field_diff_events(first: DataFrame, second: DataFrame, *, key: KeySpec, created_at: str | None = None, validate_sorted: bool = True, **how) -> Iterator[dict[str, Any]]:
    """In key order, the first row of each key on both sides; row counts in the summary stay 0."""
    if validate_sorted:
        from rowdelta.streaming.merge import require_sorted

        require_sorted(first, key, "first"), require_sorted(second, key, "second")
    return _field_events(first, second, key, created_at, "sorted_field_diff", ("place", "n"), **how, first_only=True)


def field_diff_row_events(rows: Iterable[Mapping[str, Any]]) -> Iterator[dict[str, Any]]:
    """From field-diff rows, for instance those of a file (sinks.iter_field_diff_rows)."""
    for r in rows:
        yield {"type": "row_changed", "key": r["key"], "changed_columns": [c["field"] for c in r["changes"]]}
        for c in r["changes"]:
            yield {"type": "field_change", "key": r["key"], "column": c["field"], "left": c["left"], "right": c["right"]}


def field_diff_file_events(output) -> Iterator[dict[str, Any]]:
    from rowdelta.operators import sinks

    return field_diff_row_events(sinks.iter_field_diff_rows(output))


def schema_diff_result_events(result: SchemaDiffResult, created_at: str | None = None) -> Iterator[dict[str, Any]]:
    yield build_metadata_event("schema_diff", created_at=created_at)
    one = lambda types: types[0] if len(types) == 1 else types
    out = [{"change": "column_added", "column": c} for c in result.added_columns] + [{"change": "column_removed", "column": c} for c in result.removed_columns]
    out += [{"change": "type_changed", "column": c["column"], "left_type": one(c["left_types"]), "right_type": one(c["right_types"])} for c in result.type_changes]
    out += [{"change": "nullable_changed", **c} for c in result.nullable_changes]
    yield from ({"type": "schema_change", **e} for e in out)
    yield build_summary_event(left_rows=result.left_schema.row_count, right_rows=result.right_schema.row_count, schema_changes=len(out))


def compare_and_field_events(first: DataFrame, second: DataFrame, *, key: KeySpec, created_at: str | None = None, order_by=None, include_duplicates: bool = False, **how) -> Iterator[dict[str, Any]]:
    """Presence and field changes of one comparison, in one stream."""
    columns = fields.compared_columns(first, second, key, how.get("columns"), how.get("exclude_columns"))
    yield build_metadata_event("diff", keys.names(key), columns, created_at)
    frame = presence_frame(first, second, key=key, include_duplicates=include_duplicates, order_by=order_by)
    yield from _stream(frame, "phase", "place")
    seen = EventSummary()
    for e in _stream(field_frame(first, second, key=key, order_by=order_by, **how), "place", "n"):
        seen.observe(e)
        yield e
    n = presence.presence_counts(*keys.sides(first, second, key)).first()
    more = {"duplicate_keys_left": n.nl - n["first"], "duplicate_keys_right": n.nr - n.second} if include_duplicates else {}
    changed = {k: seen.counts[k] for k in ("changed_rows", "changed_fields")}
    yield build_summary_event(left_rows=n.nl, right_rows=n.nr, common_rows=n.common, only_left=n.only_first, only_right=n.only_second, **more, **changed)


def iter_event_rows(output, validate_sequence: bool = True) -> Iterator[dict[str, Any]]:
    """Events of a file; the first has to be metadata and the last a summary."""
    last = None
    with open(output, encoding="utf-8") as f:
        for i, line in enumerate(f, 1):
            if not line.strip():
                continue
            try:
                event = json.loads(line)
            except ValueError as e:
                raise CorruptedInputError(f"{output}:{i}: {e}") from e
            try:
                if not isinstance(event, dict):
                    raise InvalidInputError("an event is an object")
                validate_event(event)
                if validate_sequence and last is None and event["type"] != "metadata":
                    raise InvalidInputError("the first event is not metadata")
                if validate_sequence and last == "summary":
                    raise InvalidInputError("an event after the summary")
            except InvalidInputError as e:
                raise InvalidInputError(f"{output}:{i}: {e}") from e
            last = event["type"]
            yield event
    if validate_sequence and last != "summary":
        raise InvalidInputError(f"{output}: the last event is not a summary")


def summarize_events(events: Iterable[Mapping[str, Any]]) -> EventSummary:
    out = EventSummary()
    for e in events:
        out.observe(e)
    return out


def summarize_event_file(output, validate_sequence: bool = True) -> EventSummary:
    return summarize_events(iter_event_rows(output, validate_sequence))


def event_counts(frame: DataFrame) -> DataFrame:
    """(type, n) of an event frame."""
    return frame.groupBy("type").agg(F.count("*").alias("n"))


