"""Connected components of an edge table by alternating large-star and small-star steps.

Each step regroups edges under the smallest neighbour; the number of edges never grows and the number of rounds is
logarithmic in practice. Every round is written to the shared folder, so a lost executor costs one round at most, and
nothing but a count and a checksum of the edges comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.session import staged


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``edges`` (a, b); loops and nulls are no edges."""
    pairs = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, mark = _kept(pairs)
    for _ in range(max_rounds):
        # large star: each larger neighbour of u goes to u's smallest neighbour or u itself
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = _smallest(both).select("u", F.least("u", "m").alias("m"))
        large = (both.filter(F.col("v") > F.col("u")).join(best, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter(F.col("u") != F.col("v")).distinct())
        # small star: the smaller neighbours of u and u itself go to the smallest
        best = _smallest(large)
        small = (large.join(best, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(best.select("u", F.col("m").alias("v")))
                 .filter(F.col("u") != F.col("v")).distinct())
        state, now = _kept(small)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    stars = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    table = staged(edges, "components")
    row = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return table, tuple(row)
