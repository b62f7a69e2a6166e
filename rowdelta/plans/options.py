"""Execution options: checked, turned into join hints, and reported in metadata.

Spark picks the physical strategy. The names of the backends are hints, the limits of memory and disk belong to the
cluster; both are recorded, so that a caller sees what became of them.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame

from rowdelta.errors import InvalidInputError
from rowdelta.functions.sizes import parse_size

MODES = ("memory", "disk", "auto")
RESULT_MODES = ("memory", "file")
STRATEGIES = {
    "sqlite": "sqlite", "hash_partition": "hash_partition", "external_sort": "external_sort", "auto": "auto",
    "partition": "hash_partition", "hash": "hash_partition", "external": "external_sort", "sort": "external_sort",
}
#: Join hints of the strategies.
HINTS = {"hash_partition": "shuffle_hash", "external_sort": "merge", "sqlite": "merge"}
#: Bytes that an item is reckoned at, and the part of a memory limit that may be used.
ITEM_BYTES, MEMORY_PART = 512, 0.7


def ensure(value: str, allowed, what: str) -> str:
    name = value.lower().replace("-", "_")
    if name not in allowed:
        raise InvalidInputError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return name


@dataclass(frozen=True)
class Plan:
    mode: str
    backend: str
    strategy: str
    result_mode: str
    partition_count: int
    chunk_size: int
    hint: str | None
    reason: str
    memory_limit: int | None = None
    disk_limit: int | None = None
    temp_dir: str | None = None
    unsupported: tuple[str, ...] = ()

    def metadata(self) -> dict[str, Any]:
        return asdict(self)

    def hinted(self, df: DataFrame) -> DataFrame:
        """df with the strategy's join hint, where disk is the backend."""
        return df.hint(self.hint) if self.hint and self.backend == "disk" else df


def plan(*, mode: str = "memory", disk_strategy: str = "sqlite", result_mode: str = "memory", chunk_size: int = 100_000, partition_count: int | None = None, memory_limit=None, disk_limit=None, temp_dir=None, items: int | None = None, common: bool = False, duplicates: bool = False, preserve_order: bool = True) -> Plan:
    """Checked options. items: estimated rows of both sides, if known."""
    mode, result_mode = ensure(mode, MODES, "mode"), ensure(result_mode, RESULT_MODES, "result_mode")
    wanted = STRATEGIES[ensure(disk_strategy, STRATEGIES, "disk_strategy")]
    if chunk_size <= 0:
        raise InvalidInputError("chunk_size must be positive")
    if partition_count is not None and partition_count <= 0:
        raise InvalidInputError("partition_count must be positive")
    memory, disk = parse_size(memory_limit), parse_size(disk_limit)
    backend, reason = mode, "asked for"
    if mode == "auto":
        if result_mode == "file":
            backend, reason = "disk", "the result goes to a file"
        elif temp_dir:
            backend, reason = "disk", "a folder for temporary files is given"
        elif memory is not None and (items is None or items * ITEM_BYTES > int(memory * MEMORY_PART)):
            backend, reason = "disk", "the input may not fit the memory limit"
        else:
            backend, reason = "memory", "nothing asks for disk"
    strategy = "hash" if backend == "memory" else wanted
    if strategy == "auto":
        many = items is not None and items > 1_000_000
        if result_mode == "file" or preserve_order:
            strategy = "sqlite"
        elif disk is not None:
            strategy = "external_sort"
        elif items is None or not many:
            strategy = "sqlite"
        elif common and not duplicates and items > 20_000_000:
            strategy = "external_sort"
        else:
            strategy = "hash_partition"
    unsupported = tuple(k for k, v in (("memory_limit", memory), ("disk_limit", disk), ("temp_dir", temp_dir)) if v is not None)
    return Plan(mode, backend, strategy, result_mode, partition_count or 16, chunk_size, HINTS.get(strategy), reason, memory, disk, str(temp_dir) if temp_dir else None, unsupported)
