"""Byte sizes as people write them."""

from __future__ import annotations

import re

from rowdelta.errors import InvalidInputError

UNITS = ("B", "KB", "MB", "GB", "TB")


def parse_size(value: int | str | None) -> int | None:
    """'1.5 MB' to bytes, by powers of 1024."""
    if value is None or isinstance(value, int):
        return value
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", value)
    unit = (m[2].upper() or "B") if m else ""
    if unit not in UNITS:
        raise InvalidInputError(f"not a size: {value!r}; units are {', '.join(UNITS)}")
    return int(float(m[1]) * 1024 ** UNITS.index(unit))
