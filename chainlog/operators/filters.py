"""Predicates of the categories, as semi and anti joins where a set decides. Sets are DataFrames of one column, `address`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CREATES = ("CREATE", "CREATE2")

#: Error texts that mark a transaction as reverted. Fixed values.
REVERTED = (
    "execution reverted",
    "out of gas",
    "invalid jump destination",
    "contract creation code storage out of gas",
    "write protection",
    "invalid opcode: INVALID",
)


def in_set(df: DataFrame, column: str, addresses: DataFrame) -> DataFrame:
    return df.join(addresses.select(F.col("address").alias("__member")).distinct(), F.col(column) == F.col("__member"), "left_semi")


def not_in_set(df: DataFrame, column: str, addresses: DataFrame) -> DataFrame:
    """Rows that are not in the set; those with a null stay."""
    return df.join(addresses.select(F.col("address").alias("__member")).distinct(), F.col(column) == F.col("__member"), "left_anti")


def flag_in_set(df: DataFrame, column: str, members: DataFrame, flag: str) -> DataFrame:
    """A boolean column: whether the column's value is in the set of one column."""
    one = members.select(F.col(members.columns[0]).alias("__member")).distinct().withColumn("__in", F.lit(True))
    return df.join(one, F.col(column) == F.col("__member"), "left").withColumn(flag, F.coalesce("__in", F.lit(False))).drop("__member", "__in")


def new_transactions(found: DataFrame, seen: DataFrame) -> DataFrame:
    return found.join(seen.select("hash").distinct(), "hash", "left_anti")


def events(trace: DataFrame) -> DataFrame:
    return trace.where("address IS NOT NULL")


def calls(trace: DataFrame, types: tuple[str, ...], zero_value: bool | None) -> DataFrame:
    """Calls of some types, with value zero or not; a null value counts as not zero. None takes both."""
    df = trace.where(F.col("calltype").isin(*types))
    if zero_value is None:
        return df
    return df.where(is_zero(F.col("callvalue")) == zero_value)


def is_zero(value: Column) -> Column:
    return F.coalesce(value.isin("0", "0x0"), F.lit(False))


def creations(trace: DataFrame) -> DataFrame:
    return trace.where(F.col("calltype").isin(*CREATES))


def reverted_transactions(trace: DataFrame, errors: tuple[str, ...] = REVERTED) -> DataFrame:
    """The hashes of transactions with one of the exact errors in any step."""
    return trace.where(F.col("error").isin(*errors)).select("hash").distinct()
