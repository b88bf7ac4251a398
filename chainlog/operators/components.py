"""Connected components of an undirected graph, by contracting it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(node, component) of every node that has an edge (a, b); a component is named by its least node.

    A round hooks each node to the least of its neighbours and itself, in an order that is dealt anew by a hash in every round,
    and a node with one neighbour to that; then it jumps to what its target is hooked to, and edges are drawn between what
    their ends have become. So a round leaves about a third of the nodes of a chain, whatever their names, and next to none of
    stars: rounds grow with the logarithm of the nodes. Only what is left of the graph is joined and written in a round; names
    go down through the rounds' hooks at the end. write(df, purpose) makes a table, so no plan grows and lost executors cost
    one round at most. Edges with a null end are left out. Nothing but the sign of an empty table comes to the driver.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    edges = write(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        placed = _order(len(hooks))
        near = edges.groupBy("a").agg(F.min(placed("b")).alias("near"), F.count("*").alias("k"))
        target = F.when(F.col("k") == 1, F.col("near")["n"]).otherwise(F.least("near", placed("a"))["n"])
        hop = write(near.select(F.col("a").alias("node"), target.alias("to")), "hops")
        hooks.append(write(_jumped(hop, placed), "hooks"))
        ends = lambda x: hooks[-1].select(F.col("node").alias(x), F.col("to").alias(f"to_{x}"))
        edges = edges.join(ends("a"), "a").join(ends("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        edges = write(edges.where("a <> b").distinct(), "edges")
    return _named(hooks, write) if hooks else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _order(number: int) -> Callable[[str], Column]:
    """A column's place in a round's order, with the value itself as n."""
    return lambda c: F.struct(F.xxhash64(F.lit(number), c).alias("h"), F.col(c).alias("n"))


def _jumped(hop: DataFrame, placed: Callable[[str], Column]) -> DataFrame:
    """(node, to) after a jump; of two nodes that are hooked to each other, both become the lesser."""
    on = hop.select(F.col("node").alias("to"), F.col("to").alias("far"))
    both = F.col("far") == F.col("node")
    return hop.join(on, "to").select("node", F.when(both, F.least(placed("node"), placed("to"))["n"]).otherwise(F.col("far")).alias("to"))


def _named(hooks: list[DataFrame], write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(node, component) from the hooks of all rounds: least names are gathered upwards, in tables that shrink with the rounds,
    and handed down again. A node that a round's graph no longer has is a whole component and keeps what it gathered."""
    names = hooks[0].select("node", F.col("node").alias("component"))
    for hook in hooks:
        up = names.join(hook, "node", "left").groupBy(F.coalesce("to", "node").alias("node"))
        names = write(up.agg(F.min("component").alias("component")), "names")
    for hook in reversed(hooks):
        down = hook.join(names.withColumnRenamed("node", "to"), "to").select("node", "component")
        names = write(down.unionByName(names.join(hook.select("node"), "node", "left_anti")), "names")
    return names
