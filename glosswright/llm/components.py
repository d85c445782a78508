"""Connected components of a table of links, by alternating large and small stars.

Each round is two aggregations and joins over the links alone; the rounds grow with the logarithm of the longest
chain. A node with many links (a hub) finds its smallest neighbour through a bounded broadcast, so no task gets its
links whole (see common.join_hot). Few links go to few tasks. Nothing is collected but the number of links that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot

#: Links of one task, and tasks at least.
LINKS, TASKS = 200_000, 8


def _large_star(e: DataFrame, n: int, tasks: int) -> DataFrame:
    """Every larger neighbour of u is linked to u's smallest neighbour (u itself included)."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")).coalesce(tasks)
    found = join_hot(both.filter("v > u"), low, "u", "n", 2 * n)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(2 * tasks).distinct().coalesce(tasks)


def _small_star(e: DataFrame, n: int, tasks: int) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them. Links point from larger to smaller."""
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).coalesce(tasks)
    others = join_hot(e, low, "u", "n", n).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(low.select("u", F.col("m").alias("v"))).coalesce(2 * tasks).distinct().coalesce(tasks)


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node with a link to another one."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    e = cut(links.select(hi.alias("u"), lo.alias("v")).filter("u > v").distinct())
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = mark(e)
    for _ in range(most_rounds):
        tasks = max(TASKS, -(-was[0] // LINKS))
        e = cut(_large_star(e.coalesce(tasks), was[0], tasks))
        e = cut(_small_star(e, e.count(), tasks))
        now = mark(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
