"""Normalisers: functions from Column to Column, so they stay in generated code.

White space is Unicode's, as Java's UNICODE_CHARACTER_CLASS has it, and the separators 0x1C to 0x1F.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Normalizer = Callable[[Column], Column]

_SPACE = "(?U)[\\s\\x1c-\\x1f]+"
#: What `remove_special` keeps, a fixed value: digits, Latin and Russian letters.
_KEEP = "[^0-9A-Za-zА-Яа-яЁё]+"


def string_normalizer(*, lower: bool = False, strip: bool = True, remove_spaces: bool = False, remove_special: bool = False, cast: str | Callable[[Column], Column] = "string") -> Normalizer:
    """Casts, strips, lowers, removes white space and special characters, in this order; NULL stays NULL."""

    def apply(c: Column) -> Column:
        c = cast(c) if callable(cast) else c.cast(cast)
        if strip:
            c = F.regexp_replace(c, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")
        if lower:
            c = F.lower(c)
        if remove_spaces:
            c = F.regexp_replace(c, _SPACE, "")
        if remove_special:
            c = F.regexp_replace(c, _KEEP, "")
        return c

    return apply


def compose_normalizers(*normalizers: Normalizer) -> Normalizer:
    """Left to right."""
    return lambda c: reduce(lambda x, f: f(x), normalizers, c)
