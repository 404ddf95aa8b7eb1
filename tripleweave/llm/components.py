"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a group-by and a join on one key, so hot nodes are pre-aggregated before the shuffle
and a skewed join can be split. Links never come to the driver; each round is written to the shared
folder and the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.scratch import dropped, written


def _least(pairs: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """The least neighbour of each node, as a table: a join with it can be split where a node has very many."""
    spent.append(written(pairs.groupBy("u").agg(F.min("v").alias("m")), "least"))
    return spent[-1]


def _large_star(links: DataFrame, spent: list[DataFrame]) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, spent).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, spent: list[DataFrame]) -> DataFrame:
    down = written(links, "down")  # every link goes from the larger to the smaller node
    spent.append(down)
    least = _least(down, spent)
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node that has a link to another: root is the component's smallest node.

    links: columns ``u`` and ``v``, of one type with an order; direction, repeats and self-links don't matter; rows with a null are left out.
    """
    now = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(now)
    while state[0]:
        spent = [now]
        then = written(_small_star(_large_star(now, spent), spent), "links")
        dropped(*spent)
        now, (before, state) = then, (state, _state(then))
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
