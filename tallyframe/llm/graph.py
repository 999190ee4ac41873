"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage


def _smallest(both: DataFrame) -> DataFrame:
    """Per node the smallest of itself and its neighbours: grouped on the map side, so hubs are no burden."""
    return both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.min("u")).alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach from each node that has one.

    Large-star and small-star steps alternate until the edges stay the same: every node then hangs on its
    component's smallest node. Rounds grow with the logarithm of a component's size, also for chains.
    """
    now = cut_lineage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    )
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_smallest(both), F.col("u") == F.col("n"))
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        small = large.join(_smallest(large), F.col("u") == F.col("n"))
        now = cut_lineage(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(large.groupBy("u").agg(F.min("v").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        after = mark(now)
        if after == before:
            break
        before = after
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
