"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored


def components(edges: DataFrame) -> DataFrame:
    """id, root for every end of an edge (columns a, b, longs): ends that a path joins have the same root.

    In each round every vertex moves to its neighbour (or itself) of the least random rank, and the edges between
    different targets stay. The ranks change from round to round, so chains shrink by a constant share and a star goes
    in one round. Nothing is gathered per vertex but a minimum.
    """
    live = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moved = None
    turn = 0
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def rank(end: str):
            return F.struct(F.xxhash64(F.col(end), F.lit(turn)).alias("rank"), F.col(end).alias("id"))

        least = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
        step = stored(least.select(F.col("a").alias("id"), F.least("near", rank("a"))["id"].alias("to")))
        left, right = step.select(F.col("id").alias("a"), F.col("to").alias("ta")), step.select(
            F.col("id").alias("b"), F.col("to").alias("tb"))
        joined = stored(live.join(left, "a").join(right, "b").filter("ta <> tb").select(
            F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        if moved is None:
            moved = step
        else:
            then = step.select(F.col("id").alias("to"), F.col("to").alias("then"))
            longer = stored(moved.join(then, "to", "left").select("id", F.coalesce("then", "to").alias("to")))
            released(moved, step)
            moved = longer
        released(live)
        live = joined
        turn += 1
    released(live)
    if moved is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)
    return moved.withColumnRenamed("to", "root")
