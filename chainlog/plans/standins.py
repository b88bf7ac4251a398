"""The synthetic tables read as chain data, so that every operator has a table to run on.

An order is a transaction and a line a step of it: flag R is a call, A a delegate call, N a creation. A line with status O is
an emitted event of the contract of its supplier. Customers are plain accounts; suppliers of nations 0 to 9 are the DApp's
contracts; regions made nations and nations made suppliers. All are DataFrames over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat trace: hash, step, blockNumber, calltype, from, to, address, callvalue, error, name, ..."""
    return _steps(_lines(spark, sf_dir))


def _steps(df: DataFrame, *more: str) -> DataFrame:
    contract = F.concat(F.lit("C"), F.col("l_suppkey"))
    event = F.col("l_linestatus") == "O"
    kind = F.when(F.col("l_returnflag") == "R", "CALL").when(F.col("l_returnflag") == "A", "DELEGATECALL").otherwise("CREATE")
    return df.select(
        F.concat(F.lit("t"), "l_orderkey").alias("hash"),
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("step"),
        F.col("l_linenumber").alias("tracePos"),
        F.col("l_shipdate").alias("timeStamp"),
        F.pmod("l_orderkey", F.lit(1000)).alias("blockNumber"),
        F.when(~event, kind).alias("calltype"),
        F.concat(F.lit("u"), "o_custkey").alias("from"),
        F.when(~event, contract).alias("to"),
        F.when(event, contract).alias("address"),
        F.when(F.col("l_tax") == 0.08, None).when(F.col("l_discount") == 0, "0").otherwise(F.col("l_quantity").cast("long").cast("string")).alias("callvalue"),
        F.when(F.col("l_quantity") == 1, "out of gas").when(F.col("l_quantity") == 2, "other").alias("error"),
        F.when(F.col("l_linenumber") != 3, F.concat(F.lit("<Function f"), F.col("l_linenumber"), F.lit("(uint256)>"))).alias("name"),
        F.col("l_partkey").alias("token"),
        F.col("l_orderkey").alias("orderId"),
        *more,
    )


#: The same for DuckDB.
STEPS = """steps AS (
  SELECT 't' || l_orderkey AS hash, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || strftime(l_shipdate, '%Y%m%d') AS step,
         l_linenumber AS "tracePos", l_shipdate AS "timeStamp", l_orderkey % 1000 AS "blockNumber",
         CASE WHEN l_linestatus <> 'O' THEN CASE l_returnflag WHEN 'R' THEN 'CALL' WHEN 'A' THEN 'DELEGATECALL' ELSE 'CREATE' END END AS calltype,
         'u' || o_custkey AS "from", CASE WHEN l_linestatus <> 'O' THEN 'C' || l_suppkey END AS "to", CASE WHEN l_linestatus = 'O' THEN 'C' || l_suppkey END AS address,
         CASE WHEN l_tax = 0.08 THEN NULL WHEN l_discount = 0 THEN '0' ELSE l_quantity::BIGINT::VARCHAR END AS callvalue,
         CASE WHEN l_quantity = 1 THEN 'out of gas' WHEN l_quantity = 2 THEN 'other' END AS error,
         CASE WHEN l_linenumber <> 3 THEN '<Function f' || l_linenumber || '(uint256)>' END AS name, l_partkey AS token, l_orderkey AS "orderId"
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
)"""


def dapp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").where("s_nationkey < 10").select(F.concat(F.lit("C"), "s_suppkey").alias("address"))


DAPP = "dapp AS (SELECT 'C' || s_suppkey AS address FROM supplier WHERE s_nationkey < 10)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, from, to): a region made its nations, a nation its suppliers, each in a transaction of its own."""
    nations = read(spark, sf_dir, "nation").select(F.concat(F.lit("R"), "n_regionkey").alias("from"), F.concat(F.lit("N"), "n_nationkey").alias("to"))
    suppliers = read(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("from"), F.concat(F.lit("C"), "s_suppkey").alias("to"))
    return nations.unionByName(suppliers).select(F.concat(F.lit("x"), "to").alias("hash"), "from", "to")


EDGES = """edges AS (
  SELECT 'R' || n_regionkey AS "from", 'N' || n_nationkey AS "to" FROM nation UNION ALL SELECT 'N' || s_nationkey, 'C' || s_suppkey FROM supplier
)"""


def creations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges as creation steps, with a place in time."""
    df = edges(spark, sf_dir).withColumnRenamed("hash", "txHash")
    return df.withColumns({"calltype": F.lit("CREATE"), "blockNumber": F.length("to").cast("long"), "tracePos": F.lit(1)})


def named(spark: SparkSession, pairs: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(pairs.items()), "key string, value string")


def factory_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are labelled: those with an even key as factories."""
    even = F.pmod("n_nationkey", F.lit(2)) == 0
    return read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("key"), F.when(even, F.concat("n_name", F.lit(" Factory"))).otherwise(F.col("n_name")).alias("value"))


def known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").select(F.concat(F.lit("C"), "s_suppkey").alias("key"), F.concat(F.lit("known "), "s_name").alias("value"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps as rows of the event log, with renamed columns and categories of objects from part and supplier.

    Lines are joined as they are, with orders first as they lie together already; the steps' texts are made after that.
    """
    event = F.col("l_linestatus") == "O"
    parts = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_brand")).alias("tokenType_name"))
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("contract_name"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("__order"), F.col("o_orderpriority").alias("orderType"))
    lines = _lines(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("__order"), "left")
    lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").join(suppliers, F.when(event, F.col("l_suppkey")) == F.col("s_suppkey"), "left")
    df = _steps(lines, "tokenType_name", "contract_name", "orderType").withColumnsRenamed({"hash": "txHash"})
    df = df.withColumns({"Activity": F.coalesce("calltype", F.lit("event")), "sender": F.col("from"), "target": F.lit(None).cast("string"), "tracePos": F.col("step")})
    market = F.when(F.pmod("token", F.lit(7)) != 0, F.pmod("token", F.lit(50)))
    return df.withColumn("market", market).withColumn("marketType", F.concat(F.lit("m"), F.pmod("market", F.lit(3))))


LOG = """log AS (
  SELECT s.hash AS "txHash", step AS "tracePos", "timeStamp", coalesce(calltype, 'event') AS "Activity", "from" AS sender, token, "orderId", address,
         CASE WHEN p_size > 5 THEN p_brand END AS "tokenType_name", s_name AS contract_name, o_orderpriority AS "orderType",
         CASE WHEN token % 7 <> 0 THEN token % 50 END AS market, 'm' || (CASE WHEN token % 7 <> 0 THEN token % 50 END % 3) AS "marketType"
  FROM steps s LEFT JOIN part ON p_partkey = token LEFT JOIN supplier ON 'C' || s_suppkey = address LEFT JOIN orders ON o_orderkey = "orderId"
)"""
