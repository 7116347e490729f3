"""Connected components of a link table, by hooking to the smallest neighbour and pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, component (the smallest node reachable), for nodes with links.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends and contracts the links to
    the ends; at least half of the nodes that still have links vanish each round. Nothing is collected but row counts.
    """
    edges = staged(links.where("a <> b").select("a", "b").distinct(), "links")
    known: DataFrame | None = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component"))
        hook = _ends(hook)
        known = hook if known is None else staged(_follow(known, hook), "components")
        end_a = hook.select(F.col("node").alias("a"), F.col("component").alias("end_a"))
        end_b = hook.select(F.col("node").alias("b"), F.col("component").alias("end_b"))
        edges = staged(
            edges.join(end_a, "a").join(end_b, "b").where("end_a <> end_b").select(F.col("end_a").alias("a"), F.col("end_b").alias("b")).distinct(),
            "links",
        )
        if edges.isEmpty():
            return known


def _follow(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """Each component of lower replaced by its component in upper, where it has one."""
    ends = upper.select(F.col("node").alias("component"), F.col("component").alias("end"))
    return lower.join(ends, "component", "left").select("node", F.coalesce("end", "component").alias("component"))


def _ends(hook: DataFrame) -> DataFrame:
    """Hooks form trees that lead to smaller nodes; doubling reaches their ends in logarithmically many joins."""
    while True:
        hook = staged(hook, "hooks")
        up = hook.select(F.col("node").alias("component"), F.col("component").alias("end"))
        next_hook = hook.join(up, "component").select("node", F.col("end").alias("component"), (F.col("end") != F.col("component")).alias("moved"))
        next_hook = staged(next_hook, "hooks")
        if next_hook.where("moved").isEmpty():
            return next_hook.drop("moved")
        hook = next_hook.drop("moved")
