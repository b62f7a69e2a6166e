"""Connectors: named sources that open as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, is_dataclass
from pathlib import Path
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame

from rowdelta.errors import InvalidInputError
from rowdelta.sources import readers


@runtime_checkable
class SourceConnector(Protocol):
    name: str

    def open(self) -> DataFrame: ...

    def describe(self) -> dict[str, Any]: ...


def _record(item: Any) -> Any:
    if isinstance(item, Mapping):
        return dict(item)
    if is_dataclass(item) and not isinstance(item, type):
        return asdict(item)
    return dict(vars(item)) if hasattr(item, "__dict__") else None


class IterableConnector:
    """Rows that the driver holds: mappings, dataclasses or objects become columns, anything else one column `value`. Rows keep their order."""

    name = "iterable"

    def __init__(self, source: Iterable[Any], schema=None):
        self.source, self.schema = source, schema

    def open(self) -> DataFrame:
        spark, items = readers.session(), list(self.source)
        if self.schema is not None:
            return spark.createDataFrame(items, self.schema)
        if not items:
            return spark.createDataFrame([], "value string")
        records = [_record(i) for i in items]
        if all(r is not None for r in records):
            names = list(dict.fromkeys(k for r in records for k in r))
            return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], names)
        return spark.createDataFrame([(list(i) if isinstance(i, tuple | set | frozenset) else i,) for i in items], ["value"])

    def describe(self) -> dict[str, Any]:
        return {"name": self.name}


class DataFrameConnector:
    name = "dataframe"

    def __init__(self, source: DataFrame):
        self.source = source

    def open(self) -> DataFrame:
        return self.source

    def describe(self) -> dict[str, Any]:
        return {"name": self.name, "columns": self.source.columns}


class TableConnector:
    name = "table"

    def __init__(self, source: str):
        self.source = source

    def open(self) -> DataFrame:
        return readers.session().table(self.source)

    def describe(self) -> dict[str, Any]:
        return {"name": self.name, "source": self.source}


class FileConnector:
    name = "file"
    format = "auto"

    def __init__(self, source, **how):
        self.source, self.how = source, ({"format": self.format} if self.format != "auto" else {}) | how

    def open(self) -> DataFrame:
        return readers.read_file(self.source, **self.how)

    def describe(self) -> dict[str, Any]:
        return {"name": self.name, "source": str(self.source), **self.how}


class CSVConnector(FileConnector):
    name = format = "csv"


class TSVConnector(FileConnector):
    name = format = "tsv"


class JSONLConnector(FileConnector):
    name = format = "jsonl"


class ParquetConnector(FileConnector):
    name = format = "parquet"


class TextConnector(FileConnector):
    name = format = "txt"


class ConnectorRegistry:
    def __init__(self):
        self._known: dict[str, Callable[..., SourceConnector]] = {}

    @staticmethod
    def _name(name: str) -> str:
        out = name.strip().lower().replace("-", "_")
        if not out:
            raise InvalidInputError("a connector needs a name")
        return out

    def register(self, name: str, factory: Callable[..., SourceConnector]) -> None:
        self._known[self._name(name)] = factory

    def create(self, name: str, *args, **how) -> SourceConnector:
        if self._name(name) not in self._known:
            raise InvalidInputError(f"no connector {name!r}; there are {', '.join(self.names())}")
        return self._known[self._name(name)](*args, **how)

    def names(self) -> list[str]:
        return sorted(self._known)


def default_registry() -> ConnectorRegistry:
    out = ConnectorRegistry()
    every = {
        "iterable": IterableConnector, "file": FileConnector, "csv": CSVConnector, "jsonl": JSONLConnector, "parquet": ParquetConnector, "pq": ParquetConnector,
        "tsv": TSVConnector, "tab": TSVConnector, "txt": TextConnector, "text": TextConnector, "dataframe": DataFrameConnector, "table": TableConnector,
    }
    for name, factory in every.items():
        out.register(name, factory)
    return out


_REGISTRY = default_registry()
register_connector, list_connectors, create_connector = _REGISTRY.register, _REGISTRY.names, _REGISTRY.create


def connect(source: Any, kind: str | None = None, **how) -> SourceConnector:
    """A connector as it is; by kind; a DataFrame, a path or rows by what they are."""
    if kind is not None:
        return create_connector(kind, source, **how)
    if isinstance(source, DataFrame):
        return DataFrameConnector(source)
    if isinstance(source, SourceConnector):
        return source
    if isinstance(source, str | Path):
        return FileConnector(source, **how)
    return IterableConnector(source, **how)
