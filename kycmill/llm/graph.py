"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Edges in a partition: few edges are kept in few partitions, which saves files and tasks in the later rounds.
EDGES = 50_000


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").distinct()


def _least(edges: DataFrame, parts: int) -> DataFrame:
    """The least neighbour of every ``a``; tasks combine before the shuffle, so a hub sends a row per task.

    It is cut off before it is joined back, so that Spark can split a hub's edges in the join.
    """
    return checkpointed(edges.groupBy("a").agg(F.min("b").alias("m"))).coalesce(parts)


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.join(_least(both, parts), "a").filter("b > a")
    return _distinct(joined.select(F.col("b").alias("a"), F.least("a", "m").alias("b")))


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down, parts)
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _distinct(moved.unionByName(least.withColumnRenamed("m", "b")))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the least node of the component) for every node that is not a root itself.

    ``edges`` has columns ``a`` and ``b`` of any orderable type; nulls, loops and repeats are ignored. Large
    and small stars alternate until the edges stay the same; each round is a checkpoint, so a lost executor
    costs one round at most. No list of neighbours is ever gathered.
    """
    now = checkpointed(_distinct(edges.select("a", "b").dropna()))
    state = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state or found[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = found
        parts = 1 + found[0] // EDGES
        now = checkpointed(_small_star(_large_star(now.coalesce(parts), parts), parts))
