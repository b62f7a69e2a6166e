"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins, so no vertex, link or component ever gathers in one task
or on the driver. The minima are written before they are joined: both sides of a join are then plain scans, and a star
with very many leaves is a skewed join that adaptive execution splits (a grouped minimum right below the join
would bind its partitions). The number of rounds grows with the logarithm of the longest path.

Cases: an empty table gives an empty result; loops and null ends are ignored, repeated links count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdelta.llm import scratch


#: Rows of a table that one task writes, and tasks at least: rounds are many, and their tables mostly small.
ROWS, TASKS = 50_000, 4


def _written(df: DataFrame, tag: str, rows: int) -> DataFrame:
    """df, of about so many rows, in as few files as that takes."""
    return scratch.written(df.coalesce(TASKS + rows // ROWS), tag)


def _ordered(df: DataFrame, u: str, v: str) -> DataFrame:
    return df.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v")


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def large_star(stars: DataFrame, rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """(links, minima): every larger neighbour is linked to the least of a vertex and its neighbours."""
    both = stars.select(F.col("u").alias("x"), F.col("v").alias("y")).union(stars.select("v", "u"))
    least = _written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least", rows)
    return _ordered(both.where("y > x").join(least, "x").select("y", "m"), "y", "m"), least


def small_star(large: DataFrame, rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """(links, minima): every smaller neighbour, and the vertex itself, is linked to the least of them."""
    least = _written(large.groupBy("u").agg(F.min("v").alias("m")), "least", rows)
    return _ordered(large.join(least, "u").select("v", "m").union(least.select("u", "m")), "v", "m"), least


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link that is not a loop; component is the smallest node reachable.

    links: two columns of one orderable type.
    """
    spark = links.sparkSession
    stars = scratch.written(_ordered(links, a, b).where("u IS NOT NULL AND v IS NOT NULL").distinct(), "links")
    state = _state(stars)
    while state[0]:
        found, least = large_star(stars, state[0])
        large = _written(found.distinct(), "large", state[0])
        scratch.dropped(spark, stars, least)
        found, least = small_star(large, state[0])
        stars, before = _written(found.distinct(), "small", state[0]), state
        scratch.dropped(spark, large, least)
        state = _state(stars)
        if state == before:
            break
    out = stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())
    out.scratch_path = stars.scratch_path
    return out
