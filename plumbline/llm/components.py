"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped, tasks_for


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in `edges` (a, b): component is the smallest node reachable.

    Each round is two minima by node with map-side combining, two joins and two distincts, then a checkpoint. The minima
    are checkpointed before they are joined, so both sides of a join come from plain exchanges and adaptive execution
    can split the partition of a node with very many links. Rounds grow with the logarithm of a component's diameter.
    The links left go to as many tasks as they are worth, and what a round no longer reads is deleted, so that rounds on
    few links write few files. An empty table gives an empty table; self links and repeated links are ignored.
    """
    two = lambda df, a, b: df.select(F.col(a).alias("a"), F.col(b).alias("b"))
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state, tasks = None, 1
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        tasks = tasks_for(now[0])
        if now[0] == 0 or now == state:
            break
        state = now
        few = e.coalesce(tasks)  # a > b in each link, here and in what the round makes of it
        back = two(few, "b", "a")
        least = cut(few.unionByName(back).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")).coalesce(tasks))
        large = cut(two(back.join(least, F.col("a") == F.col("k")), "b", "m").coalesce(tasks).distinct().coalesce(tasks))
        dropped(e, least)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k").coalesce(tasks))
        linked = large.join(least, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("s"))
        e = cut(two(linked, "s.a", "s.m").where("a <> b").coalesce(tasks).distinct().coalesce(tasks))
        dropped(large, least)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    e = e.coalesce(tasks)
    roots = e.select(F.col("b").alias("node")).distinct().coalesce(tasks)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
