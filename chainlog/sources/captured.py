"""Readers of captured responses. There is no live connector: what a node or an explorer answered is kept as files, which
Spark reads in parallel, and every stage starts from those."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import keep_last, union_sources

log = logging.getLogger("chainlog")
LIST = "status string, message string, result array<struct<hash:string,blockNumber:string,timeStamp:string,contractAddress:string>>"


def transaction_list(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(hash, blockNumber, timeStamp, contractAddress, source) of captured list responses, one JSON document a line.

    Responses that did not succeed (status other than "1") have no rows. Pages overlap at their border block, so a hash can
    come twice; `transactions` keeps the last.
    """
    pages = spark.read.schema(LIST).json(path).where("status = '1'")
    rows = pages.select(F.explode("result").alias("t")).select("t.*")
    return rows.select("hash", F.col("blockNumber").cast("long").alias("blockNumber"), F.col("timeStamp").cast("long").alias("timeStamp"), "contractAddress", F.lit(source).alias("source"))


def there(spark: SparkSession, path: str) -> bool:
    """Whether something was captured under this name."""
    try:
        spark.read.text(path)
    except AnalysisException:
        log.warning("nothing was captured in %s", path)
        return False
    return True


def _number(c: Column) -> Column:
    """A block number as nodes (0x...) or explorers (decimal) write it."""
    return F.when(F.startswith(c, F.lit("0x")), F.conv(F.substring(c, 3, 16), 16, 10)).otherwise(c).cast("long")


def logs(spark: SparkSession, path: str) -> DataFrame:
    """(transactionHash, blockNumber, address) of captured log responses, one JSON document a line; those without a result
    have no rows. Ranges that were asked for again may repeat a log."""
    pages = spark.read.schema("result array<struct<transactionHash:string,blockNumber:string,address:string>>").json(path)
    rows = pages.select(F.explode("result").alias("l")).select("l.*")
    return rows.select("transactionHash", _number(F.col("blockNumber")).alias("blockNumber"), F.lower("address").alias("address"))


ASKED = "request struct<address:string,from_block:string,to_block:string>"


def list_pages(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(source, contract, from_block, to_block, ok, n, last_block) of captured list responses that say what was asked for:
    {"request": {"address": ..., "from_block": ..., "to_block": ...}, "status": ..., "result": [...]}.

    An answer that there are no transactions is a whole page; any other failure is none.
    """
    raw = spark.read.schema(f"{ASKED}, {LIST}").json(path)
    ok = (F.col("status") == "1") | F.coalesce(F.startswith("message", F.lit("No transactions found")), F.lit(False))
    return _pages(raw, source, ok)


def log_pages(spark: SparkSession, path: str) -> DataFrame:
    """The same of captured log responses; one without a result is no page. Nodes do not cut pages."""
    raw = spark.read.schema(f"{ASKED}, result array<struct<blockNumber:string>>").json(path)
    return _pages(raw, "events", F.col("result").isNotNull())


def _pages(raw: DataFrame, source: str, ok: Column) -> DataFrame:
    last = F.array_max(F.transform("result", lambda t: _number(t["blockNumber"])))
    asked = [F.lower("request.address").alias("contract"), *[_number(F.col(f"request.{c}")).alias(c) for c in ("from_block", "to_block")]]
    return raw.select(F.lit(source).alias("source"), *asked, F.coalesce(ok, F.lit(False)).alias("ok"), F.coalesce(F.size("result"), F.lit(0)).cast("long").alias("n"), last.alias("last_block"))


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """(number, timestamp) of captured block responses: {"result": {"number": ..., "timestamp": ...}}."""
    df = spark.read.schema("result struct<number:string,timestamp:string>").json(path).select("result.*")
    return df.select(_number(F.col("number")).alias("number"), _number(F.col("timestamp")).alias("timestamp")).where("number IS NOT NULL").dropDuplicates(["number"])


def tx_index(spark: SparkSession, path: str) -> DataFrame:
    """(hash, ix) of captured transactions: {"hash": ..., "transactionIndex": ...}."""
    df = spark.read.schema("hash string, transactionIndex string").json(path)
    return df.select("hash", _number(F.col("transactionIndex")).alias("ix")).where("hash IS NOT NULL AND ix IS NOT NULL").dropDuplicates(["hash"])


def code(spark: SparkSession, path: str) -> DataFrame:
    """(address, block, code) of captured code responses: {"address": ..., "block": ..., "result": "0x..."}."""
    df = spark.read.schema("address string, block string, result string").json(path)
    return df.select(F.lower("address").alias("address"), _number(F.col("block")).alias("block"), F.col("result").alias("code"))


def transactions_of_logs(logs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The same from captured logs (transactionHash, blockNumber, address) and blocks (number, timestamp)."""
    df = logs.join(blocks.select(F.col("number").alias("__n"), F.col("timestamp").cast("long").alias("timeStamp")), F.col("blockNumber") == F.col("__n"))
    return df.select(F.col("transactionHash").alias("hash"), F.col("blockNumber").cast("long").alias("blockNumber"), "timeStamp", F.col("address").alias("contractAddress"), F.lit("events").alias("source")).distinct()


def transactions(normal: DataFrame | None, internal: DataFrame | None, events: DataFrame | None) -> DataFrame:
    """One row for each hash over the sources that there are; of several, the one of the last source, in this order."""
    have = [df.withColumn("__rank", F.lit(i)) for i, df in enumerate((normal, internal, events)) if df is not None]
    if not have:
        raise ValueError("no source of transactions")
    return keep_last(union_sources(*have), "hash", "__rank", "blockNumber").drop("__rank")


def touches(*sources: DataFrame) -> DataFrame:
    """(hash, contract): every contract that a transaction was listed for, over all sources."""
    return union_sources(*sources).select("hash", F.col("contractAddress").alias("contract")).distinct()


def traces(spark: SparkSession, path: str) -> DataFrame:
    """(hash, trace_json) of captured trace responses, one JSON document a line: {"hash": ..., "response": {...}}.

    Responses without result.type are invalid and have no row.
    """
    raw = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    df = raw.select(F.try_variant_get("v", "$.hash", "string").alias("hash"), F.to_json(F.try_variant_get("v", "$.response", "variant")).alias("trace_json"), F.try_variant_get("v", "$.response.result.type", "string").alias("kind"))
    return df.where("hash IS NOT NULL AND kind IS NOT NULL").select("hash", "trace_json")


def abis(spark: SparkSession, path: str) -> DataFrame:
    """(address, abi) of captured ABI responses: {"address": ..., "status": ..., "result": "<abi>"}; unverified contracts have none."""
    df = spark.read.schema("address string, status string, result string").json(path)
    return df.where("status = '1' AND try_parse_json(result) IS NOT NULL").select(F.lower("address").alias("address"), F.col("result").alias("abi")).dropDuplicates(["address"])


def mappings(spark: SparkSession, path: str) -> DataFrame:
    """(map_name, key, value) of a JSON object of objects."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    return whole.select(F.explode("m").alias("map_name", "pairs")).select("map_name", F.explode("pairs").alias("key", "value"))


def mapping(table: DataFrame, name: str) -> DataFrame:
    return table.where(F.col("map_name") == name).select("key", "value")


def wanted_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that there are, in the order wanted; the scan reads no others."""
    return df.select(*[c for c in columns if c in df.columns])
