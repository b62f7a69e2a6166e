"""Approximate pairing of strings: each left string, in order, takes the best right one that is still free.

The pairing is sequential by nature, so it runs within blocks: rows that share a block key are paired with each other
only. Without a block key there is one block, and its size is checked before it is given to one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowdelta.errors import InvalidInputError
from rowdelta.functions.normalize import Normalizer
from rowdelta.plans import keys

#: Strings of a block's two sides, beyond which it is refused.
MOST = 20_000
WARNING = "fuzzy pairing is approximate and greedy"

try:
    from rapidfuzz.fuzz import WRatio as _ratio

    SCORER = "WRatio"
except ImportError:
    SCORER = "difflib"

    def _ratio(a: str, b: str) -> float:
        return SequenceMatcher(None, a, b).ratio() * 100


def pair(left: list[str], right: list[str], threshold: float) -> list[tuple[int | None, int | None, float | None]]:
    """(left, right, score) by index; unmatched ones have None. Ties go to the lowest right index."""
    free, out = dict.fromkeys(range(len(right))), []
    for i, a in enumerate(left):
        best, score = None, -1.0
        for j in free:
            s = _ratio(a, right[j])
            if s > score:
                best, score = j, s
        if best is not None and score >= threshold:
            del free[best]
            out.append((i, best, round(score, 4)))
        else:
            out.append((i, None, None))
    return out + [(None, j, None) for j in free]


@dataclass
class FuzzyResult:
    pairs: DataFrame
    metadata: dict[str, Any]
    warnings: list[str] = field(default_factory=lambda: [WARNING])

    common = property(lambda self: self.pairs.where("first IS NOT NULL AND second IS NOT NULL"))
    only_in_first = property(lambda self: self.pairs.where("second IS NULL").select("first"))
    only_in_second = property(lambda self: self.pairs.where("first IS NULL").select("second"))


def compare_fuzzy_strings(first: DataFrame, second: DataFrame, *, column: str = "value", threshold: float = 90, normalizer: Normalizer | None = None, block: Callable[[Column], Column] | None = None, order_by=None) -> FuzzyResult:
    """(first, second, score): pairs of at least `threshold` of 100, and the unmatched of both sides."""
    if not 0 <= threshold <= 100:
        raise InvalidInputError("threshold must lie between 0 and 100")

    def side(df: DataFrame, n: int) -> DataFrame:
        c = df[column].cast("string")
        t = normalizer(c) if normalizer else c
        return df.select(F.lit(n).alias("side"), c.alias("value"), F.coalesce(t, F.lit("None")).alias("text"), (block(c) if block else F.lit(0)).alias("block"), keys.ordered(df, order_by).alias("o"))

    both = side(first, 0).union(side(second, 1))
    largest = both.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    if largest > MOST:
        raise InvalidInputError(f"a block of {largest} strings; pass a finer block (at most {MOST})")
    numbered = both.select("side", "value", "text", "block", F.col("o"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", kind="stable")
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        found = pair(a.text.tolist(), b.text.tolist(), threshold)
        pick = lambda s, i: None if i is None else s.value.iloc[i]
        return pd.DataFrame([(pick(a, i), pick(b, j), s) for i, j, s in found], columns=["first", "second", "score"])

    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("block").orderBy("side", "o")).alias("n")
    pairs = numbered.select("side", "value", "text", "block", place).groupBy("block").applyInPandas(run, "first string, second string, score double")
    return FuzzyResult(pairs, {"threshold": threshold, "scorer": SCORER, "strategy": "fuzzy"})
