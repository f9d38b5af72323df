"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogrid.llm.common import written


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _parents(links: DataFrame, level: int) -> DataFrame:
    """(node, parent): the first of the node and its neighbours, by number at first and by a digest later."""

    def rank(node: str) -> Column:
        return F.struct((F.col(node) if level == 0 else F.xxhash64(node, F.lit(level))).alias("at"), F.col(node).alias("node"))

    least = _both_ways(links).groupBy("a").agg(F.min(rank("b")).alias("least"))
    return least.select(F.col("a").alias("node"), F.least(F.col("least"), rank("a"))["node"].alias("parent"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its smallest node.

    Every level moves the links to the nodes' parents, which at least halves the nodes as a rule; stars, as leaders and
    their copies form, are done in one. A hot node is one row a task before the shuffle, and the joins can be split.
    """
    links = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", narrow=True
    )
    levels = []
    while not levels or links.limit(1).count():
        parents = written(_parents(links, len(levels)), "parents", narrow=True)
        levels.append(parents)
        moved = links.join(parents.toDF("a", "p"), "a").join(parents.toDF("b", "q"), "b").where("p <> q")
        links = written(moved.select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct(), "links", narrow=True)

    def follow(known: DataFrame, parents: DataFrame) -> DataFrame:
        step = known.join(parents.toDF("at", "to"), F.col("parent") == F.col("at"), "left")
        return step.select("node", F.coalesce("to", "parent").alias("parent"))

    roots = reduce(follow, levels[1:], levels[0])
    if len(levels) == 1:  # all neighbours agree on a parent, so it is the smallest node
        return roots.withColumnRenamed("parent", "component")
    roots = written(roots, "roots", narrow=True)
    names = roots.groupBy("parent").agg(F.min("node").alias("component"))
    return written(roots.join(names, "parent").select("node", "component"), "components", narrow=True)
