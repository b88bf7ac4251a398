"""The object-centric event log: objects, events, and relations between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: Columns that the log is built from, as far as a category has them.
WANTED = ("Activity", "timeStamp", "txHash", "tracePos", "sender", "target", "token", "tokenType_name", "orderId", "orderType", "address", "contract_name", "market", "marketType")

#: (column, object type, qualifier) of the relations.
BRANCHES = (
    ("sender", "EOA", "EOA_FROM"),
    ("target", "EOA", "EOA_TO"),
    ("token", "TOKEN", "TOKEN"),
    ("orderId", "ORDER", "ORDER"),
    ("address", "CONTRACT", "CONTRACT"),
    ("market", "MARKET", "MARKET"),
)
KINDS = {"TOKEN": ("token", "tokenType_name"), "ORDER": ("orderId", "orderType"), "CONTRACT": ("address", "contract_name"), "MARKET": ("market", "marketType")}


def ocel_base(frames: list[DataFrame], wanted: tuple[str, ...] = WANTED) -> DataFrame:
    """The categories in one frame, with the wanted columns that any of them has, nulls elsewhere."""
    parts = [df.select(*[c for c in wanted if c in df.columns]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def event_id() -> Column:
    """Unique, as a step's position is unique in its transaction, and made without a shuffle."""
    return F.concat(F.lit("EID_"), F.col("txHash"), F.lit("_"), F.col("tracePos").cast("string"))


def eoa_objects(df: DataFrame) -> DataFrame:
    ends = [F.col(c).cast("string") for c in ("sender", "target") if c in df.columns]
    ids = df.select(F.explode(F.array(*ends)).alias("id")).where("id IS NOT NULL").distinct()
    return ids.select(F.concat(F.lit("EOA_"), "id").alias("ocel:oid"), F.lit("EOA").alias("ocel:type"), F.lit("EOA").alias("category"))


def kind_objects(df: DataFrame, kind: str, order: tuple[str, ...] = ("timeStamp", "tracePos")) -> DataFrame:
    """Objects of a kind with the first category that is known of them, by the order."""
    column, category = KINDS[kind]
    place = F.struct(*[c for c in order if c in df.columns], category)
    first = F.min_by(F.col(category), F.when(F.col(category).isNotNull(), place))
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(first.cast("string").alias("category"))
    return out.select(F.concat(F.lit(f"{kind}_"), F.col(column).cast("string")).alias("ocel:oid"), F.lit(kind).alias("ocel:type"), "category")


def ocel_objects(df: DataFrame, order: tuple[str, ...] = ("timeStamp", "tracePos")) -> DataFrame:
    """All objects: each step names those it touches, and each is kept once with its first known category. A kind is left out if
    one of its two columns is missing.

    What is passed on between tasks is each object once with each of its categories, without the steps' places, and made a table.
    Places are compared only for objects with several categories, in a second pass over the steps if there are any.
    """
    have = set(df.columns)
    pairs = [(c, "EOA", F.lit("EOA")) for c in ("sender", "target") if c in have]
    pairs += [(c, kind, F.col(category).cast("string")) for kind, (c, category) in KINDS.items() if {c, category} <= have]
    named = F.array(*[F.struct(F.concat(F.lit(f"{kind}_"), F.col(c).cast("string")).alias("oid"), F.lit(kind).alias("type"), category.alias("category")) for c, kind, category in pairs])
    each = df.select(*[c for c in order if c in have], F.explode(named).alias("o")).where("o.oid IS NOT NULL")
    keys = [F.col("o.oid").alias("ocel:oid"), F.col("o.type").alias("ocel:type")]
    known = each.select(*keys, "o.category").distinct().groupBy("ocel:oid", "ocel:type").agg(F.count("category").alias("n"), F.max("category").alias("category"))
    known = written(known, "objects")
    settled = known.where("n <= 1").drop("n")
    several = known.where("n > 1").select("ocel:oid", "ocel:type")
    if several.isEmpty():
        return settled
    place = F.struct(*[c for c in order if c in have], "category")
    first = F.min_by("category", F.when(F.col("category").isNotNull(), place))
    placed = each.select("*", *keys, "o.category").drop("o").join(several, ["ocel:oid", "ocel:type"], "left_semi")
    return settled.unionByName(placed.groupBy("ocel:oid", "ocel:type").agg(first.alias("category")))


def ocel_e2o(df: DataFrame) -> DataFrame:
    """Relations, all in one pass: a row for each known object of each event. Rows with anything unknown are left out."""
    ends = F.array(*[
        F.struct(F.concat(F.lit(f"{kind}_"), F.col(c).cast("string")).alias("oid"), F.lit(kind).alias("type"), F.lit(q).alias("qualifier"))
        for c, kind, q in BRANCHES if c in df.columns
    ])
    known = F.col("tracePos").isNotNull() & F.col("Activity").isNotNull() & F.col("timeStamp").isNotNull()
    each = df.where(known).select(event_id().alias("ocel:eid"), F.col("Activity").alias("ocel:activity"), F.col("timeStamp").alias("ocel:timestamp"), F.explode(ends).alias("o"))
    each = each.where("o.oid IS NOT NULL AND `ocel:eid` IS NOT NULL")
    return each.select("ocel:eid", "ocel:activity", "ocel:timestamp", F.col("o.oid").alias("ocel:oid"), F.col("o.type").alias("ocel:type"), F.col("o.qualifier").alias("ocel:qualifier"))


def ocel_events(df: DataFrame) -> DataFrame:
    out = df.select(event_id().alias("ocel:eid"), F.col("Activity").alias("ocel:activity"), F.col("timeStamp").alias("ocel:timestamp"), "tracePos")
    return out.dropna("any").drop("tracePos")


def places(df: DataFrame, by_index: bool = False) -> DataFrame:
    """(ocel:eid, place): where a step stands in the log, by numbers: time, within a block by transaction if asked for, position."""
    index = [F.col("transactionIndex")] if by_index and "transactionIndex" in df.columns else []
    place = F.struct(F.col("timeStamp").alias("time"), *index, F.col("tracePos").cast("long").alias("position"))
    return df.select(event_id().alias("ocel:eid"), place.alias("place")).where("`ocel:eid` IS NOT NULL").dropDuplicates(["ocel:eid"])


def in_log_order(df: DataFrame, by_index: bool = False) -> DataFrame:
    """Rows of a log as sinks want them: by time, within a block by transaction if asked for, then by position."""
    return df.orderBy("timeStamp", *["transactionIndex"] * by_index, *["tracePos"] * ("tracePos" in df.columns))
