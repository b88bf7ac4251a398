"""Addresses that a trace names: selection for ABI lookup, first and last blocks, and their dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import flag_in_set


def address_selection(trace: DataFrame) -> DataFrame:
    """Contracts whose ABIs are wanted: emitters of events, and targets of calls and delegate calls."""
    called = F.when(F.col("calltype").isin("CALL", "DELEGATECALL"), F.col("to"))
    return trace.select(F.explode(F.array("address", called)).alias("address")).where("address IS NOT NULL").distinct()


def address_blocks(df: DataFrame, columns: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """(address, first_block, last_block) over the columns that there are."""
    have = [c for c in columns if c in df.columns]
    each = df.select("blockNumber", *[F.lower(F.col(c).cast("string")).alias(c) for c in have]).unpivot("blockNumber", have, "column", "address")
    out = each.where("address IS NOT NULL AND address <> ''").groupBy("address").agg(F.min("blockNumber").alias("first_block"), F.max("blockNumber").alias("last_block"))
    return out if wanted is None else out.join(wanted.select(F.lower("address").alias("address")).distinct(), "address", "left_semi")


def combined_blocks(frames: list[DataFrame]) -> DataFrame:
    """Over categories: the least of their last blocks, at which an address is looked up, besides the first and last of all."""
    every = reduce(DataFrame.unionByName, frames)
    return every.groupBy("address").agg(F.min("first_block").alias("first_block"), F.max("last_block").alias("last_block"), F.min("last_block").alias("lookup_block"))


def as_of(lookups: DataFrame, states: DataFrame, value: str, span: int = 100_000) -> DataFrame:
    """(address, block, value, known): what was last captured of an address at or before a block. lookups: (address, block);
    states: (address, block, value), of which several at one block count as the greatest.

    Captures and lookups of a span of so many blocks meet in one task, become one row for each block, and the last capture is
    carried on; what a span begins with comes from the last captures of the spans before. So a window holds a row for each block
    of an address's span, or for each of its spans, however often it was captured or is asked for. Rows travel and are sorted
    once, over as many tasks as the session's shuffles have. Lookups that repeat are one; a null address or block has none.
    """
    there = "address IS NOT NULL AND block IS NOT NULL"
    captures = states.where(there).select("address", "block", F.struct(F.col(value).alias("v")).alias("state"), F.lit(False).alias("asked"))
    asked = lookups.where(there).select("address", "block", F.lit(None).cast(captures.schema["state"].dataType).alias("state"), F.lit(True).alias("asked"))
    tasks = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = captures.unionByName(asked).withColumn("span", F.floor(F.col("block") / span)).repartition(tasks, "address", "span")
    latest = F.max(F.when(~F.col("asked"), F.struct("block", "state")))
    last = rows.groupBy("address", "span").agg(latest["state"].alias("state"))
    before = Window.partitionBy("address").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = last.select("address", "span", F.last("state", ignorenulls=True).over(before).alias("start"))
    each = rows.groupBy("address", "span", "block").agg(F.max("state").alias("state"), F.bool_or("asked").alias("asked"))
    upto = Window.partitionBy("address", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    found = each.withColumn("own", F.last("state", ignorenulls=True).over(upto)).where("asked").join(starts, ["address", "span"])
    state = F.coalesce("own", "start")
    return found.select("address", "block", state["v"].alias(value), state.isNotNull().alias("known"))


def address_dictionary(blocks: DataFrame, contracts: DataFrame, code: DataFrame, labels: DataFrame) -> DataFrame:
    """(address, dapp_flag, type, contract_label). code: captured (address, block, code); an address without code at or before
    its lookup block is an EOA. labels: (address, contract_label)."""
    lookups = blocks.select("address", F.col("lookup_block").alias("block"))
    found = as_of(lookups, code.select(F.lower("address").alias("address"), "block", "code"), "code").select("address", "code")
    kind = blocks.select("address").distinct().join(found, "address", "left")
    kind = kind.withColumn("type", F.when(F.coalesce("code", F.lit("0x")) == "0x", "EOA").otherwise("CA")).drop("code")
    kind = flag_in_set(kind, "address", contracts.select("address"), "__dapp")
    kind = kind.join(labels.select(F.col("address").alias("__l"), "contract_label"), F.col("address") == F.col("__l"), "left").drop("__l")
    return kind.select("address", F.when(F.col("__dapp"), "dapp").otherwise("non_dapp").alias("dapp_flag"), "type", "contract_label")


def address_union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select("address") for f in frames]).distinct()
