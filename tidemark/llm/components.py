"""Connected components by alternating stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import checkpointed

HEAVY = 4096


def joined(many: DataFrame, one: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """many with the columns of one, which has a row per key and tells by `n` how many rows of many have it.

    Keys of more than a HEAVY-th of all rows are fewer than HEAVY, so their rows of one are
    broadcast and no task gets all rows of such a key; the others are joined by a shuffle.
    total is the number of rows of many, or more; if not given it is added up from n.
    """
    total = one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar() if total is None else F.lit(total)
    heavy = one.where(F.col("n") * HEAVY > total).drop("n")
    names = F.broadcast(heavy.select(F.col(key).alias("__key")))
    light = many.join(names, F.col(key) == F.col("__key"), "left_anti").join(one.where(F.col("n") * HEAVY <= total).drop("n"), key)
    return light.unionByName(many.join(F.broadcast(heavy), key))


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Link each node's neighbours to the least of them: the larger ones, or those up to the node."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    # after the large stars a node has few smaller neighbours, but a hub has all of its own before
    linked = joined(near, least, "a", total) if large else near.join(least, "a")
    if large:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one link to a root, and no root has any: then the links tell the components."""
    twice = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    roots = edges.select(F.col("b").alias("__root")).distinct()
    return not twice.unionByName(edges.join(roots, F.col("a") == F.col("__root"), "left_semi").select("a")).head(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) of longs; root is the component's least node.

    Large-star and small-star turn the graph into stars in a number of rounds that
    grows with the logarithm of a component; both steps are checkpointed, so plans stay
    small. Only a row of a link that is not yet part of a star comes to the driver.
    """
    now = checkpointed(edges.select("a", "b").where("a != b").distinct())
    total = 2 * now.count()  # a round makes no more rows than it is given, both ways round
    while True:
        now = checkpointed(_stars(now, True, total))
        now = checkpointed(_stars(now, False, total))
        if _are_stars(now):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
