"""Connected components by alternating large-star and small-star; every step is a join or an aggregation.

The centre of a star is one key with as many rows as it has neighbours; `join_one` keeps it out of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralake.llm.common import join_one, materialize


def _star(edges: DataFrame, large: bool, step: int, total: int) -> DataFrame:
    """edges: (u, v), u > v. Large: every larger neighbour of u is tied to the least of u's neighbourhood; small: u and its lesser neighbours are."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), f"least{step}")
    tied = both.filter("v > u") if large else both
    moved = join_one(tied, least, ["u"], "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionAll(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, component), component the least id that can be reached; ids without links are not in it."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before, step, total = None, 0, edges.count()
    while True:
        large = materialize(_star(edges, True, step, total), f"large{step}")
        edges = materialize(_star(large, False, step, total), f"small{step}")
        # Both steps keep the components; when a round leaves the same set of stars, every node is tied to its least.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, step = now, step + 1
    lows = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(lows.select("id", F.col("id").alias("component")))
