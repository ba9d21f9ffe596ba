"""Connected components of a table of links, without gathering any of them on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node that has a link.

    In each round a node points to the least of its neighbours and itself, and then to where that points; nodes that point
    to one are contracted, so that links within them vanish and those left are links of fewer nodes. The state of a round
    is a written table. Links may repeat and may be given in one direction; null ends are left out.
    """
    stash = common.Stash(links.sparkSession)
    given = links.where(f"{u} is not null and {v} is not null").select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
    labels = None
    edges = stash(given.distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("to"))
        to = stash(near.select("node", F.col("to").alias("mid")).join(common.sorted_side(near.select(F.col("node").alias("mid"), "to")), "mid").select("node", "to"))
        if labels is None:
            labels = stash(to.withColumnRenamed("to", "root"))
        else:
            was = labels
            labels = stash(was.join(common.sorted_side(to.withColumnRenamed("node", "root")), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
            stash.drop(was)
        left = edges.join(common.sorted_side(to.select(F.col("node").alias("u"), F.col("to").alias("a"))), "u").join(common.sorted_side(to.select(F.col("node").alias("v"), F.col("to").alias("b"))), "v")
        fewer = stash(left.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        stash.drop(edges)
        stash.drop(to)
        edges = fewer
        if edges.isEmpty():
            return labels


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node`` and ``root`` after more links ``u``, ``v``, which join whole classes."""
    stash = common.Stash(links.sparkSession)
    name = lambda end: common.sorted_side(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")))
    named = links.join(name("u"), "u", "left").join(name("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    top = components(stash(named.where("u <> v").distinct()))
    every = roots.union(links.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(common.sorted_side(roots), "node", "left_anti").select("node", F.col("node").alias("root")))
    return stash(every.join(common.sorted_side(top.select(F.col("node").alias("root"), F.col("root").alias("top"))), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
