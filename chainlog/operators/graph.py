"""The graph of contract creations: closure from seeds, levels, and labels along it."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .components import connected_components
from .filters import creations


def creation_edges(trace: DataFrame) -> DataFrame:
    """(from, to) of creations, addresses cut to 42 characters; failed ones, which have no child, are left out."""
    df = creations(trace).select(F.substring("from", 1, 42).alias("from"), F.col("to"))
    return df.where("`from` IS NOT NULL AND `to` IS NOT NULL").distinct()


def create_closure(edges: DataFrame, seeds: DataFrame, deny: DataFrame | None = None, prune: str = "after") -> DataFrame:
    """(address): the seeds and all that created them or was created by them, and so on: the components that have a seed.

    prune says whether denied addresses go at the end, when others may have been reached through them, or before. Components
    come from rounds that contract the graph, so a chain of creations takes rounds by the logarithm of its length.
    """
    seeds = seeds.select("address").where("address IS NOT NULL").distinct()
    pairs = edges.select(F.col("from").alias("a"), F.col("to").alias("b"))
    if deny is not None and prune == "before":
        gone = deny.select("address").distinct()
        pairs = pairs.join(gone, pairs["a"] == gone["address"], "left_anti").join(gone, pairs["b"] == gone["address"], "left_anti")
        seeds = seeds.join(gone, "address", "left_anti")
    found = connected_components(pairs, written)
    own = found.join(seeds, found["node"] == seeds["address"], "left_semi").select("component").distinct()
    known = written(found.join(own, "component", "left_semi").select(F.col("node").alias("address")).unionByName(seeds).distinct(), "known")
    return deny_list(known, deny) if deny is not None else known


def deny_list(addresses: DataFrame, deny: DataFrame) -> DataFrame:
    return addresses.join(deny.select("address").distinct(), "address", "left_anti")


def level_expand(transactions: DataFrame, edges: DataFrame, seeds: DataFrame, deny: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Levels over captured data: the frontier's transactions, the creations in them, the contracts these add, and so on.

    transactions: (hash, contract) of what touches a contract; edges: (hash, from, to) of creations in a transaction. Gives
    the hashes, each with the level that first reached it, and the contracts.
    """
    frontier = known = written(seeds.select("address").distinct(), "contracts")
    seen = written(transactions.select("hash").limit(0).withColumn("level", F.lit(0)), "hashes")
    for level in count(1):
        new = transactions.join(frontier, transactions["contract"] == frontier["address"], "left_semi").select("hash").distinct()
        new = written(new.join(seen, "hash", "left_anti").withColumn("level", F.lit(level)), "new-hashes")
        if new.isEmpty():
            return seen, known
        seen = written(seen.unionByName(new), "hashes")
        inside = edges.join(seen, "hash", "left_semi").select("from", "to").where("`from` IS NOT NULL AND `to` IS NOT NULL")
        grown = create_closure(inside, known)
        frontier = grown.join(known, "address", "left_anti")
        known = grown
        if deny is not None:
            frontier, known = deny_list(frontier, deny), deny_list(known, deny)
        frontier, known = written(frontier, "frontier"), written(known, "contracts")
        if frontier.isEmpty():
            return seen, known


def label_by_relative(creations: DataFrame, contracts: DataFrame, factory_labels: DataFrame) -> DataFrame:
    """(address, inherited_label) of contracts that a labelled contract of the DApp created.

    A label that ends in Factory gives its child what stands before that and one more character; any other gives itself and
    " deployment". A child created twice takes the label of its last creation by (blockNumber, tracePos). A creator without a
    label gives none.
    """
    own = creations.join(contracts.select(F.col("address").alias("__c")).distinct(), F.col("from") == F.col("__c"), "left_semi").where("`to` IS NOT NULL")
    labels = factory_labels.select(F.lower("key").alias("__creator"), F.col("value").alias("__label"))
    df = own.join(labels, F.lower("from") == F.col("__creator"))
    is_factory = F.contains(F.substring(F.col("__label"), -7, 7), F.lit("Factory"))
    label = F.when(is_factory, F.substr("__label", F.lit(1), F.greatest(F.length("__label") - 8, F.lit(0)))).otherwise(F.concat("__label", F.lit(" deployment")))
    return df.groupBy(F.lower("to").alias("address")).agg(F.max_by(label, F.struct("blockNumber", "tracePos")).alias("inherited_label"))
