"""Unions, deduplication and set operators of the transaction lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_last(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the last by the order. A max of one struct, so it is combined before the shuffle."""
    rest = [c for c in df.columns if c != key and c not in order]
    last = df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("__last"))
    return last.select(*[key if c == key else F.col(f"__last.`{c}`").alias(c) for c in df.columns])


def keep_last_row(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The same for rows with columns that cannot be compared, such as maps or variants."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def with_transaction_index(df: DataFrame, index: DataFrame) -> DataFrame:
    """transactionIndex by hash from (hash, ix); tx_index_missing where there is none."""
    ix = index.select(F.col("hash").alias("__hash"), F.col("ix").cast("long").alias("transactionIndex"))
    return df.join(ix, F.col("hash") == F.col("__hash"), "left").drop("__hash").withColumn("tx_index_missing", F.col("transactionIndex").isNull())


def block_chunks(contracts: DataFrame, first: int, last: int, size: int = 10_000) -> DataFrame:
    """(contract, from_block, to_block): the ranges in which logs are asked for, a row each."""
    start = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"), F.lit(size).cast("long")))
    return contracts.withColumn("from_block", start).withColumn("to_block", F.least(F.col("from_block") + size - 1, F.lit(last).cast("long")))
