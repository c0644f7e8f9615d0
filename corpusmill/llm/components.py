"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _pointed(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation: larger (or smaller) neighbours point to the least one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    near = both.join(least, "a")
    if large:
        out = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, least): each node that is not the least of its component.

    Large-star and small-star operations alternate until the edges are stars.
    Each round's edges are written, so rounds do not pile up lineage. Minima
    are pre-aggregated before the shuffle, which keeps a hub's rows few.
    """
    now = stored(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while True:
        now = stored(_pointed(_pointed(now, True), False), "edges")
        # stars: nothing that is pointed at points on, and nothing points twice
        open_ = now.select("b").distinct().join(now.select(F.col("a").alias("b")), "b", "left_semi")
        if open_.isEmpty() and now.groupBy("a").count().where(F.col("count") > 1).isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("least"))
