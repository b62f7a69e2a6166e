"""Bloom filters, as an object on the driver and as a relation of bit positions.

Positions are taken from MD5 of a seed and the value's text, so both forms, and any SQL engine, set the same bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowdelta.errors import InvalidInputError
from rowdelta.functions.normalize import Normalizer
from rowdelta.plans import keys

WARNING = "candidates are approximate: a false positive hides a difference"


def sizing(expected_items: int, false_positive_rate: float = 0.01) -> tuple[int, int]:
    """(bits, hashes) that are best for so many items."""
    if expected_items <= 0:
        raise InvalidInputError("expected_items must be positive")
    if not 0 < false_positive_rate < 1:
        raise InvalidInputError("false_positive_rate must lie between 0 and 1")
    m = math.ceil(-expected_items * math.log(false_positive_rate) / math.log(2) ** 2)
    return max(8, m), max(1, round(m / expected_items * math.log(2)))


@dataclass
class BloomFilter:
    expected_items: int
    false_positive_rate: float = 0.01
    bit_count: int = field(init=False)
    hash_count: int = field(init=False)

    def __post_init__(self):
        self.bit_count, self.hash_count = sizing(self.expected_items, self.false_positive_rate)
        self.bits = bytearray(-(-self.bit_count // 8))

    def positions(self, value: Any) -> list[int]:
        return [int(hashlib.md5(f"{seed}:{value}".encode()).hexdigest()[:15], 16) % self.bit_count for seed in range(self.hash_count)]

    def add(self, value: Any) -> None:
        for p in self.positions(value):
            self.bits[p >> 3] |= 1 << (p & 7)

    def __contains__(self, value: Any) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.positions(value))


def build_bloom_filter(values: Iterable[Any], *, expected_items: int | None = None, false_positive_rate: float = 0.01, normalizer: Callable[[Any], Any] | None = None) -> BloomFilter:
    """normalizer: a plain function of a value; ask the filter for values that went through it too."""
    values = list(values) if expected_items is None else values
    size = expected_items or max(1, len(values))
    values = values if normalizer is None else map(normalizer, values)
    out = BloomFilter(size, false_positive_rate)
    for v in values:
        out.add(v)
    return out


def positions(value: Column, bit_count: int, hash_count: int) -> Column:
    """Distinct bit positions of a value, as an array."""
    seeds = F.array(*(F.lit(s) for s in range(hash_count)))
    at = lambda s: F.conv(F.substring(F.md5(F.concat(s.cast("string"), F.lit(":"), value.cast("string"))), 1, 15), 16, 10).cast("long") % F.lit(bit_count)
    return F.array_distinct(F.transform(seeds, at))


def filter_bits(df: DataFrame, value: Column, bit_count: int, hash_count: int) -> DataFrame:
    """(bit) of all values: the filter as a relation, of bit_count rows at most."""
    return df.select(F.explode(positions(value, bit_count, hash_count)).alias("bit")).distinct()


def not_in_filter(df: DataFrame, value: Column, bits: DataFrame, bit_count: int, hash_count: int) -> DataFrame:
    """Rows of which at least one bit is not set; NULL values are never in a filter.

    Only distinct values and their positions are shuffled; whole rows join the values that lack a bit last.
    """
    asked = df.select(value.alias("__asked")).distinct().select("__asked", F.explode_outer(positions(F.col("__asked"), bit_count, hash_count)).alias("bit"))
    lacking = asked.join(bits.withColumn("set", F.lit(1)), "bit", "left").groupBy("__asked").agg(F.count("*").alias("asked"), F.count("set").alias("set"))
    lacking = lacking.where(F.col("set") < F.col("asked")).select("__asked")
    return df.join(lacking, value.eqNullSafe(lacking["__asked"]), "left_semi")


@dataclass
class Candidates:
    only_in_first: DataFrame
    only_in_second: DataFrame
    metadata: dict[str, Any]
    warnings: list[str]


def probabilistic_diff_candidates(first: DataFrame, second: DataFrame, *, key=None, normalizer: Normalizer | None = None, expected_items: int | None = None, false_positive_rate: float = 0.01) -> Candidates:
    """Rows whose key is not in the other side's filter; no row is folded, none is a false alarm, few are missed."""
    n = expected_items or max(1, first.count(), second.count())
    m, k = sizing(n, false_positive_rate)

    def value(df: DataFrame) -> Column:
        parts = keys.parts(df, key, normalizer)
        return parts[0].cast("string") if len(parts) == 1 else F.to_json(F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"})

    bits = [filter_bits(d, value(d), m, k) for d in (first, second)]
    return Candidates(not_in_filter(first, value(first), bits[1], m, k), not_in_filter(second, value(second), bits[0], m, k), {"bit_count": m, "hash_count": k, "expected_items": n}, [WARNING])
