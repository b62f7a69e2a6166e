"""Results: lazy frames, and counters that are computed once when asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rowdelta.errors import InvalidInputError

#: Sections in the order in which they are written, a fixed value.
SECTIONS = ("only_in_first", "only_in_second", "common", "duplicates_first", "duplicates_second")


@dataclass(frozen=True)
class CompareStats:
    """Rows, distinct keys and surplus rows. Duplicate counts stay 0 unless duplicates are asked for."""

    first_count: int = 0
    second_count: int = 0
    unique_first_count: int = 0
    unique_second_count: int = 0
    only_in_first_count: int = 0
    only_in_second_count: int = 0
    common_count: int = 0
    duplicate_first_count: int = 0
    duplicate_second_count: int = 0
    mode: str = "memory"
    strategy: str = "hash"

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def plain(value: Any) -> Any:
    """Rows as dictionaries; a row of one column `value` as that value."""
    if isinstance(value, Row):
        d = {k: plain(v) if isinstance(v, Row | list) else v for k, v in value.asDict().items()}
        return d["value"] if list(d) == ["value"] else d
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value


@dataclass
class CompareResult:
    """Sections as DataFrames of the input's columns, in order of first appearance if that was asked for."""

    sections: dict[str, DataFrame | None]
    counter: Callable[[], CompareStats]
    metadata: dict[str, Any] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    #: Makes (section, value) of all sections from one grouping, where the comparison offers that.
    whole: Callable[[], DataFrame] | None = None

    @cached_property
    def stats(self) -> CompareStats:
        return self.counter()

    def section(self, name: str) -> DataFrame | None:
        if name == "unique":
            return self.unique
        if name not in SECTIONS:
            raise InvalidInputError(f"no section {name!r}; there are {', '.join(SECTIONS)}, unique")
        return self.sections.get(name)

    only_in_first = property(lambda self: self.section("only_in_first"))
    only_in_second = property(lambda self: self.section("only_in_second"))
    common = property(lambda self: self.section("common"))
    duplicates_first = property(lambda self: self.section("duplicates_first"))
    duplicates_second = property(lambda self: self.section("duplicates_second"))

    @property
    def unique(self) -> DataFrame:
        """The symmetric difference, the left part first."""
        return self.sections["only_in_first"].unionByName(self.sections["only_in_second"], allowMissingColumns=True)

    def iter_section(self, name: str) -> Iterator[Any]:
        """Values of a section; of a result that was written as lines, from the file instead of another run."""
        df, output = self.section(name), str(self.metadata.get("output") or "")
        if df is not None and name != "unique" and output.endswith((".jsonl", ".csv")):
            from rowdelta.operators import sinks

            return sinks.iter_result_values(output, [name])
        return iter(()) if df is None else (plain(r) for r in df.toLocalIterator())

    def iter_unique(self) -> Iterator[Any]:
        yield from self.iter_section("only_in_first")
        yield from self.iter_section("only_in_second")

    def rows(self) -> DataFrame:
        """(section, value): all sections in one frame, values as JSON, in order of sections and of their rows."""
        if self.whole is not None:
            return self.whole()
        parts = [d.select(F.lit(s).alias("section"), json_value(d).alias("value")) for s in SECTIONS if (d := self.sections.get(s)) is not None]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def to_dict(self) -> dict[str, Any]:
        """Everything, on the driver: for results that are known to be small."""
        out = {s: None if self.sections.get(s) is None else list(self.iter_section(s)) for s in SECTIONS}
        return out | {"unique": [*out["only_in_first"], *out["only_in_second"]], "stats": self.stats.to_dict(), "metadata": self.metadata, "warnings": self.warnings}


def json_value(df: DataFrame, row: str | None = None):
    """A row of df as JSON text, or the struct `row` of such a row: an object, or the bare value of the one column `value`."""
    if df.columns == ["value"]:
        value = F.col(row).getField("value") if row else F.col("value")
        kind = df.schema["value"].dataType.typeName()
        if kind in ("struct", "array", "map"):
            return F.coalesce(F.to_json(value, {"ignoreNullFields": "false"}), F.lit("null"))
        text = F.to_json(F.struct(value.alias("value")), {"ignoreNullFields": "false"})
        return F.substring(text, F.lit(len('{"value":') + 1), F.length(text) - F.lit(len('{"value":') + 1))
    return F.to_json(row if row else F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
