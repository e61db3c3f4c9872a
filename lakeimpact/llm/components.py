"""Connected components of a table of links, by contracting it step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import Scratch


def components(links: DataFrame, work: Scratch, name: str) -> DataFrame:
    """(a, b) links of bigint ids -> (node, component), the smallest id reachable.

    Each step points every node to its smallest neighbour, then to where that one points, and
    renames the links accordingly; equal links merge and loops go, so at least half of the nodes
    that still have links disappear per step. Steps are written tables; nodes without links
    are not in the result. Sides that meet a busy node come from tables or plain exchanges,
    so the runtime can split them.
    """
    edges = work.cut(links.select("a", "b").filter("a <> b").distinct(), f"{name}-links-0")
    labels = None
    for step in range(1, 200):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        near = both.groupBy("node").agg(F.least("node", F.min("other")).alias("to"))
        near = work.cut(near, f"{name}-near-{step}")
        jump = near.select(F.col("node").alias("to"), F.col("to").alias("far"))
        to = work.cut(
            near.join(jump, "to", "left").select("node", F.coalesce("far", "to").alias("to")), f"{name}-to-{step}"
        )
        labels = (
            to.select("node", F.col("to").alias("component"))
            if labels is None
            else labels.join(to.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")
            )
        )
        labels = work.cut(labels, f"{name}-labels-{step}")
        first = to.select(F.col("node").alias("a"), F.col("to").alias("x"))
        second = to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        renamed = edges.join(first, "a").select("b", "x").join(second, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        left = renamed.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = work.write(left, f"{name}-links-{step}")
        work.drop(f"{name}-near-{step}", f"{name}-to-{step}", f"{name}-links-{step - 1}", f"{name}-labels-{step - 1}")
        if not more:
            return labels
        edges = work.read(f"{name}-links-{step}", left.schema)
    raise RuntimeError("components did not converge")
