"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    links = _both(edges)
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to its least neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v: longs) as (node, root): root is the least node of the component; nodes without a link are absent.

    Large-star and small-star steps alternate until nothing changes, a logarithmic number of rounds. Each step is a
    grouped minimum and a join whose one side has one row a node, so a node with very many links is split by the
    adaptive skew join; each round is written to the shared folder.
    """
    now, before = materialize(edges.where("u <> v").distinct(), "links"), None
    while True:
        after = materialize(_small_star(_large_star(now)), "links")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now, before = after, state
