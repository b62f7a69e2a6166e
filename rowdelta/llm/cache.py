"""What a worker process keeps from task to task: one operator's coder at a time, with a bounded dictionary in two generations.

Spark lends a worker to one operator after another, so what the last one kept would lie beside what the next one needs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable
from typing import Any

_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """make(), for as long as this process asks for nothing else."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def released() -> None:
    """For operators that keep nothing and hold much. What is free goes back to the system, where the C library can do so."""
    _kept.clear()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Generations:
    """A dictionary in two generations, of which the older is dropped when the younger is full. Holds `most` entries, and those of one batch more. What a batch uses moves to the younger generation."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def holding(self, keys: set, make: Callable[[list], dict]) -> dict:
        """A dictionary with all the keys; make() gives the values of those that are not held."""
        if len(self.young) > self.most // 2:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        lacking = keys.difference(young)
        if old:
            for k in lacking.intersection(old):
                young[k] = old[k]
            lacking = lacking.difference(old)
        if lacking:
            young.update(make(list(lacking)))
        return young
