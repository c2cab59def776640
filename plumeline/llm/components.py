"""Connected components of a large edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _lowest(pairs: DataFrame) -> DataFrame:
    """Each pair's u with the least of its own id and its neighbours'; sums before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = _lowest(large)
    small = large.join(low, "u")
    return (
        small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(low.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def components(edges: DataFrame, scratch: Scratch, name: str = "edges") -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node that it reaches.

    edges has columns a and b. A hub's neighbours are never gathered: its minimum is a partial
    aggregate, joined back by a join that adaptive execution can split. Every round is a written
    table, so lineage stays short; rounds grow with the logarithm of a component's size. Null ends
    are ignored, as are loops and repeated edges.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = scratch.write(e.where("u <> v").distinct(), f"{name}0")
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, k = mark(e), 0
    while before[0]:
        e = scratch.write(_round(e), f"{name}{k + 1}")
        scratch.drop(f"{name}{k}")
        now, k = mark(e), k + 1
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
