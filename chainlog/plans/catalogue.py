"""A query for each operator over the synthetic tables, with its DuckDB equivalent."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import abi, decoding
from ..operators import addresses, base, coverage, enrich, filters, graph, ocel, relational, trace
from . import standins as st

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *parts: str):
    """Registers a query under its function's name; parts are the common tables that its SQL names."""

    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + sql
        return f

    return keep


# event log

E2O = """SELECT 'EID_' || "txHash" || '_' || "tracePos" AS "ocel:eid", "Activity" AS "ocel:activity", "timeStamp" AS "ocel:timestamp", p || id AS "ocel:oid", t AS "ocel:type", q AS "ocel:qualifier" FROM (
  SELECT *, sender AS id, 'EOA_' AS p, 'EOA' AS t, 'EOA_FROM' AS q FROM log
  UNION ALL SELECT *, token::VARCHAR, 'TOKEN_', 'TOKEN', 'TOKEN' FROM log
  UNION ALL SELECT *, "orderId"::VARCHAR, 'ORDER_', 'ORDER', 'ORDER' FROM log
  UNION ALL SELECT *, address, 'CONTRACT_', 'CONTRACT', 'CONTRACT' FROM log
  UNION ALL SELECT *, market::VARCHAR, 'MARKET_', 'MARKET', 'MARKET' FROM log) WHERE id IS NOT NULL"""


@query(E2O, st.STEPS, st.LOG)
def ocel_e2o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocel.ocel_e2o(st.log(spark, sf_dir))


def _kind_sql(kind: str) -> str:
    column, category = ocel.KINDS[kind]
    return f"""SELECT '{kind}_' || "{column}" AS "ocel:oid", '{kind}' AS "ocel:type",
      first("{category}" ORDER BY "timeStamp", "tracePos") FILTER ("{category}" IS NOT NULL) AS category FROM log WHERE "{column}" IS NOT NULL GROUP BY "{column}\""""


EOA = """SELECT DISTINCT 'EOA_' || sender AS "ocel:oid", 'EOA' AS "ocel:type", 'EOA' AS category FROM log"""


@query(" UNION ALL ".join([EOA, *map(_kind_sql, ocel.KINDS)]), st.STEPS, st.LOG)
def ocel_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocel.ocel_objects(st.log(spark, sf_dir))


@query(EOA, st.STEPS, st.LOG)
def ocel_objects_eoa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocel.eoa_objects(st.log(spark, sf_dir))


def _kind_query(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ocel.kind_objects(st.log(spark, sf_dir), kind)

    run.__name__ = f"ocel_objects_{kind.lower()}"
    return query(_kind_sql(kind), st.STEPS, st.LOG)(run)


for _kind in ocel.KINDS:
    _kind_query(_kind)


@query("""SELECT 'EID_' || "txHash" || '_' || "tracePos" AS "ocel:eid", "Activity" AS "ocel:activity", "timeStamp" AS "ocel:timestamp" FROM log""", st.STEPS, st.LOG)
def ocel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocel.ocel_events(st.log(spark, sf_dir))


@query(
    """SELECT coalesce(calltype, 'event') AS "Activity", "timeStamp", step AS "tracePos", NULL::BIGINT AS token, NULL::BIGINT AS "orderId", address FROM steps WHERE address IS NOT NULL
    UNION ALL SELECT calltype, "timeStamp", step, token, "orderId", NULL FROM steps WHERE calltype = 'CALL'""",
    st.STEPS,
)
def ocel_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = st.steps(spark, sf_dir).withColumn("Activity", F.coalesce("calltype", F.lit("event"))).withColumn("tracePos", F.col("step"))
    emitted = filters.events(df).select("Activity", "timeStamp", "tracePos", "address", "callvalue")
    called = df.where("calltype = 'CALL'").select("Activity", "timeStamp", "tracePos", "token", "orderId")
    return ocel.ocel_base([emitted, called])


# transaction lists

SOURCES = """sources AS (
  SELECT event_id // 4 AS hash, user_id AS "blockNumber", event_id AS seq, 'normal' AS source, 0 AS rank FROM events
  UNION ALL SELECT event_id // 4, user_id, event_id, 'internal', 1 FROM events WHERE event_type IN ('purchase', 'error')
  UNION ALL SELECT event_id // 4, NULL, event_id, 'events', 2 FROM events WHERE event_type = 'click'
)"""


def _sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    e = st.read(spark, sf_dir, "events")
    base_cols = lambda df, *c: df.select(F.expr("event_id DIV 4").alias("hash"), *c, F.col("event_id").alias("seq"))
    parts = (
        base_cols(e, F.col("user_id").alias("blockNumber")),
        base_cols(e.where("event_type IN ('purchase', 'error')"), F.col("user_id").alias("blockNumber")),
        base_cols(e.where("event_type = 'click'")),
    )
    return [df.withColumns({"source": F.lit(s), "rank": F.lit(i)}) for i, (df, s) in enumerate(zip(parts, ("normal", "internal", "events")))]


@query('SELECT hash, "blockNumber", seq, source, rank FROM sources', SOURCES)
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.union_sources(*_sources(spark, sf_dir))


@query('SELECT hash, "blockNumber", seq, source, rank FROM sources QUALIFY row_number() OVER (PARTITION BY hash ORDER BY rank DESC, seq DESC) = 1', SOURCES)
def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.keep_last(relational.union_sources(*_sources(spark, sf_dir)), "hash", "rank", "seq")


@query("SELECT hash, \"blockNumber\" FROM sources WHERE source = 'normal' QUALIFY row_number() OVER (PARTITION BY hash ORDER BY seq DESC) = 1", SOURCES)
def tx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.keep_last(_sources(spark, sf_dir)[0], "hash", "seq").drop("seq", "source", "rank")


@query("""SELECT 'C' || s_suppkey AS contract, f AS from_block, least(f + 9999, 54321) AS to_block FROM supplier, generate_series(100::BIGINT, 54321::BIGINT, 10000::BIGINT) AS g(f)""")
def block_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.block_chunks(st.read(spark, sf_dir, "supplier").select(F.concat(F.lit("C"), "s_suppkey").alias("contract")), 100, 54321)


CUT = 40
#: Lines as transactions of suppliers' contracts, asked for in ranges of 100 blocks; a page is cut at CUT rows. Some pages fail;
#: for two of three contracts the rest of a cut page is asked for again.
PAGES = f"""per_block AS (SELECT l_suppkey AS s, l_orderkey % 1000 // 100 AS k, l_orderkey % 1000 AS b, count(*) AS c FROM lineitem GROUP BY ALL),
running AS (SELECT *, sum(c) OVER (PARTITION BY s, k ORDER BY b) AS upto FROM per_block),
pages AS (SELECT s, k, (s + k) % 7 <> 0 AS ok, max(upto) AS n, min(b) FILTER (upto >= {CUT}) AS last_block FROM running GROUP BY s, k)"""


@query(f"""SELECT 'C' || s AS contract, min(b)::BIGINT AS from_block, max(b)::BIGINT AS to_block FROM (
  SELECT s, b, b - row_number() OVER (PARTITION BY s ORDER BY b) AS island FROM (SELECT s_suppkey AS s, b FROM supplier, range(0, 1000) t(b)) w
  WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.s = w.s AND p.k = w.b // 100 AND (p.ok AND (p.n < {CUT} OR w.b < p.last_block) OR p.n >= {CUT} AND p.s % 3 <> 0 AND w.b >= p.last_block))
) GROUP BY s, island""", PAGES)
def missing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.col("l_orderkey") % 1000
    lines = st.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.floor(block / 100).alias("k"), block.alias("b"))
    upto = F.sum("c").over(Window.partitionBy("s", "k").orderBy("b"))
    pages = lines.groupBy("s", "k", "b").agg(F.count("*").alias("c")).withColumn("upto", upto)
    pages = pages.groupBy("s", "k").agg(F.max("upto").alias("n"), F.min(F.when(F.col("upto") >= CUT, F.col("b"))).alias("last_block"))
    pages = pages.select("*", F.concat(F.lit("C"), "s").alias("contract"), (F.col("k") * 100).alias("from_block"), (F.col("k") * 100 + 99).alias("to_block"))
    first = pages.withColumns({"ok": (F.col("s") + F.col("k")) % 7 != 0, "n": F.least("n", F.lit(CUT).cast("long"))})
    again = pages.where(F.col("last_block").isNotNull() & (F.col("s") % 3 != 0)).withColumns({"from_block": F.col("last_block"), "ok": F.lit(True), "n": F.lit(0).cast("long")})
    wanted = st.read(spark, sf_dir, "supplier").select(F.concat(F.lit("C"), "s_suppkey").alias("contract"), F.lit(0).cast("long").alias("from_block"), F.lit(999).cast("long").alias("to_block"))
    return coverage.missing_ranges(coverage.covered_ranges(first.unionByName(again), CUT), wanted)


@query("SELECT o_orderkey AS hash, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def new_tx_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = st.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"), "o_custkey")
    return filters.new_transactions(found, st.read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("hash")))


@query("""SELECT o_orderkey AS hash, o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey * 7 END AS "transactionIndex", o_orderkey % 3 = 0 AS tx_index_missing FROM orders""")
def tx_index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = st.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"), "o_custkey")
    return relational.with_transaction_index(orders, orders.where("hash % 3 <> 0").select("hash", (F.col("hash") * 7).alias("ix")))


# categories


def _category(name: str, column: str, member: bool, where_sql: str, choose):
    shown = ["hash", "step", "calltype", "address", "to", "callvalue"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        keep = filters.in_set if member else filters.not_in_set
        return keep(choose(st.steps(spark, sf_dir)), column, st.dapp(spark, sf_dir)).select(*shown)

    run.__name__ = name
    test = "EXISTS" if member else "NOT EXISTS"
    query(f'SELECT hash, step, calltype, address, "to", callvalue FROM steps s WHERE {where_sql} AND {test} (SELECT 1 FROM dapp WHERE dapp.address = s."{column}")', st.STEPS, st.DAPP)(run)


NOT_ZERO = "coalesce(callvalue <> '0', true)"
for _side, _member in (("dapp", True), ("non_dapp", False)):
    _category(f"{_side}_events", "address", _member, "address IS NOT NULL", filters.events)
    _category(f"{_side}_calls", "to", _member, f"calltype = 'CALL' AND {NOT_ZERO}", lambda df: filters.calls(df, ("CALL",), False))
    _category(f"{_side}_delegatecalls", "to", _member, "calltype = 'DELEGATECALL' AND callvalue = '0'", lambda df: filters.calls(df, ("DELEGATECALL",), True))


@query("SELECT hash, step, callvalue FROM steps WHERE calltype = 'CALL' AND callvalue = '0'", st.STEPS)
def zero_value_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.calls(st.steps(spark, sf_dir), ("CALL",), True).select("hash", "step", "callvalue")


@query("SELECT hash, step, \"from\", \"to\" FROM steps WHERE calltype = 'CREATE'", st.STEPS)
def creations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.creations(st.steps(spark, sf_dir)).select("hash", "step", "from", "to")


def _creations(dapp: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = filters.creations(st.steps(spark, sf_dir)).select("hash", "step", "to")
        return enrich.creations_of((filters.in_set if dapp else filters.not_in_set)(made, "to", st.dapp(spark, sf_dir)), dapp)

    run.__name__ = "creations_dapp" if dapp else "creations_non_dapp"
    sql = f"""SELECT hash AS "txHash", step, "to", {str(dapp).lower()} AS dapp, 'create new contract' AS "Activity" FROM steps
      WHERE calltype = 'CREATE' AND "to" {"" if dapp else "NOT"} IN (SELECT address FROM dapp)"""
    query(sql, st.STEPS, st.DAPP)(run)


_creations(True)
_creations(False)


@query("SELECT DISTINCT hash FROM steps WHERE error = 'out of gas'", st.STEPS)
def reverted_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.reverted_transactions(st.steps(spark, sf_dir))


# projections


@query(
    """SELECT l_orderkey AS hash, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_shipdate AS shipped, 'c' || l_suppkey AS "to", 'a' || l_partkey AS "from",
    CASE WHEN l_linestatus = 'O' THEN 'ev' || l_suppkey END AS address, l_returnflag AS calltype,
    CASE WHEN l_linenumber <> 4 THEN l_quantity::BIGINT END AS gas, CASE WHEN l_linenumber = 4 THEN '0xXYZ' ELSE printf('0x%x', l_quantity::BIGINT) END AS gas_raw,
    (l_partkey::HUGEINT * 18446744073709551616 + l_suppkey)::VARCHAR AS callvalue FROM lineitem"""
)
def base_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = st.read(spark, sf_dir, "lineitem")
    hexed = lambda c: F.concat(F.lit("0x"), F.hex(F.col(c).cast("long")))
    raw = lines.select(
        F.col("l_orderkey").alias("hash"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_shipdate").alias("shipped"),
        F.lit("1530000000").alias("timeStamp"), F.concat(F.lit("C"), "l_suppkey").alias("to"), F.concat(F.lit("A"), "l_partkey").alias("from"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("EV"), "l_suppkey")).alias("address"), F.col("l_returnflag").alias("type"),
        F.when(F.col("l_linenumber") == 4, "0xXYZ").otherwise(F.lower(hexed("l_quantity"))).alias("gas"),
        F.concat(F.lit("0x"), F.hex("l_partkey"), F.lpad(F.hex("l_suppkey"), 16, "0")).alias("value"),
    )
    df = base.base_transform(raw)
    return df.select("hash", "line", "part", "supp", "shipped", "to", "from", "address", "calltype", "gas", "gas_raw", "callvalue")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE event_id * user_id END AS gas,
    CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '0xXYZ' ELSE printf('0x%x', event_id * user_id) END AS gas_raw FROM events""")
def hex_to_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod("event_id", F.lit(5))
    text = F.when(kind == 0, None).when(kind == 1, "0xXYZ").otherwise(F.concat(F.lit("0x"), F.lower(F.hex(F.col("event_id") * F.col("user_id")))))
    return base.hex_to_int(st.read(spark, sf_dir, "events").select("event_id", text.alias("gas")), ["gas", "not_there"])


@query(
    """SELECT hash AS "txHash", step, coalesce(name, 'undecoded event') AS "Activity", lower(address) AS address_lower, true AS flag_log_entry,
    hash IN (SELECT hash FROM steps WHERE error = 'out of gas') AS flag_reverted, true AS flag_dapp_contract FROM steps WHERE address IS NOT NULL""",
    st.STEPS,
)
def events_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = st.steps(spark, sf_dir)
    out = enrich.initial_events(filters.events(df).select("hash", "step", "name", "address"), True, filters.reverted_transactions(df))
    return out.drop("address")


@query(
    """SELECT hash AS "txHash", step, lower("to") AS address_lower, CASE WHEN calltype LIKE '%CALL%' AND name IS NOT NULL THEN regexp_extract(name, '<Function ([^(]*)[(]', 1) ELSE calltype END AS "Activity",
    hash IN (SELECT hash FROM steps WHERE error = 'out of gas') AS flag_reverted, false AS flag_dapp_contract, 'message_call' AS flag FROM steps WHERE calltype IS NOT NULL""",
    st.STEPS,
)
def calls_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = st.steps(spark, sf_dir)
    out = enrich.initial_calls(df.where("calltype IS NOT NULL").select("hash", "step", "name", "to", "calltype"), False, filters.reverted_transactions(df))
    return out.drop("to", "name", "calltype")


ACTIVITIES = {"click": "open page", "purchase": "transfer tokens", "view": "see page"}


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'open page' WHEN 'purchase' THEN 'transfer tokens' WHEN 'view' THEN 'see page' ELSE event_type END AS \"Activity\" FROM events")
def rename_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = st.read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("Activity"))
    return enrich.rename_attribute(df, "Activity", "Activity", st.named(spark, ACTIVITIES))


PARTS = """parts AS (SELECT p_partkey, p_brand AS "Activity", CASE WHEN p_size > 10 THEN p_type END AS "tokenType_name", CASE WHEN p_size % 3 = 0 THEN p_name END AS contract_name FROM part)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = st.read(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_brand").alias("Activity"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("tokenType_name"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("contract_name"))


SPLIT = ("Brand#12", "Brand#23", "Brand#34", "Brand#1", "Brand#2", "Brand#3")
SPLIT_SQL = ", ".join(f"'{s}'" for s in SPLIT)


@query(f"""SELECT p_partkey, CASE WHEN "Activity" NOT IN ({SPLIT_SQL}) AND contract_name IS NOT NULL THEN "Activity" || ' / ' || contract_name END AS combined FROM parts""", PARTS)
def combine_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.combine_attributes(_parts(spark, sf_dir), "Activity", "contract_name", "combined", " / ", SPLIT).select("p_partkey", "combined")


@query(f"""SELECT p_partkey, CASE WHEN "Activity" IN ({SPLIT_SQL}) AND contract_name IS NOT NULL THEN "Activity" || ', contract: ' || contract_name END AS "Activity_contract_sensitive" FROM parts""", PARTS)
def contract_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.contract_sensitive(_parts(spark, sf_dir), SPLIT).select("p_partkey", "Activity_contract_sensitive")


@query("""SELECT p_partkey, "Activity" || ', token type: ' || "tokenType_name" AS "Activity_token_sensitive" FROM parts""", PARTS)
def token_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.token_sensitive(_parts(spark, sf_dir)).select("p_partkey", "Activity_token_sensitive")


@query(
    f"""SELECT p_partkey, "Activity" AS "Activity_raw", coalesce(CASE WHEN "Activity" IN ({SPLIT_SQL}) AND contract_name IS NOT NULL THEN "Activity" || ', contract: ' || contract_name END,
    "Activity" || ', token type: ' || "tokenType_name", "Activity") AS "Activity" FROM parts""",
    PARTS,
)
def activity_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.activity_override(enrich.token_sensitive(enrich.contract_sensitive(_parts(spark, sf_dir), SPLIT))).select("p_partkey", "Activity_raw", "Activity")


@query("SELECT c_custkey, '0x' || lower(hex(encode(c_name))) AS \"orderId\" FROM customer")
def bytes_to_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = st.read(spark, sf_dir, "customer").select("c_custkey", F.encode("c_name", "utf-8").alias("orderId"))
    return base.bytes_to_hex(df, ["orderId", "tradeGroupId"])


# markets: an event of type purchase makes a market

MADE = """made AS (SELECT event_id AS market, CASE WHEN event_id % 4 <> 3 THEN event_id % 4 END AS kind,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN '{"k":' || json_extract_string(props, '$.k') || ',"d":"text ' || event_id || '"}' ELSE '{"k":' || json_extract_string(props, '$.k') || ',"d":"text ' || event_id END AS info
  FROM events WHERE event_type = 'purchase')"""


def _markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = st.read(spark, sf_dir, "events")
    text = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"d":"text '), F.col("event_id").cast("string"))
    info = F.when(F.pmod("event_id", F.lit(7)) == 0, None).when(F.pmod("event_id", F.lit(2)) == 0, F.concat(text, F.lit('"}'))).otherwise(text)
    kind = F.pmod("event_id", F.lit(4))
    return e.select("event_id", F.col("event_id").alias("market"), F.when(F.col("event_type") == "purchase", "create market").otherwise("other").alias("Activity"), F.when(kind != 3, kind).alias("marketType"), info.alias("extraInfo"), "user_id")


@query("SELECT market, CASE kind WHEN 0 THEN 'yes-no' WHEN 1 THEN 'categorical' ELSE 'scalar' END AS \"marketType\" FROM made WHERE kind IS NOT NULL", MADE)
def market_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.market_type(_markets(spark, sf_dir))


INFO = """info AS (SELECT market, CASE WHEN info IS NULL THEN NULL WHEN market % 2 = 0 THEN info ELSE info || '"}' END AS j, false AS extra_info_broken FROM made)"""


@query("SELECT market, json_extract_string(j, '$.k') AS k, json_extract_string(j, '$.d') AS d, extra_info_broken FROM info", MADE, INFO)
def extra_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.extra_info(_markets(spark, sf_dir), {"k": "$.k", "d": "$.d"})


@query("""SELECT event_id AS market, false AS extra_info_broken, json_extract_string(props, '$.k') AS "info_k", CASE WHEN event_id % 2 = 0 THEN 'x' || event_id END AS "info_a.b",
  CASE WHEN event_id % 2 = 0 THEN '[1,' || event_id || ']' END AS "info_a.c", CASE WHEN event_id % 3 = 0 THEN '{"q":' || event_id || '}' WHEN event_id % 3 = 1 THEN 'plain' END AS "info_a.mixed"
  FROM events""")
def free_extra_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with different and nested keys, lists, and a key that is an object, a text or not there."""
    e, id_ = st.read(spark, sf_dir, "events"), F.col("event_id")
    mixed = F.when(id_ % 3 == 0, F.concat(F.lit('"mixed":{"q":'), id_, F.lit("}"))).when(id_ % 3 == 1, F.lit('"mixed":"plain"'))
    pair = F.when(id_ % 2 == 0, F.concat(F.lit('"b":"x'), id_, F.lit('","c":[1,'), id_, F.lit("]")))
    text = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"a":{'), F.concat_ws(",", pair, mixed), F.lit("}}"))
    return enrich.extra_info(e.select(id_.alias("market"), F.lit("create market").alias("Activity"), text.alias("extraInfo")))


@query("SELECT market, json_extract_string(j, '$.d') AS repaired FROM info", MADE, INFO)
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _markets(spark, sf_dir).where("Activity = 'create market'")
    return df.select("market", F.try_variant_get(enrich.repaired_json(F.col("extraInfo")), "$.d", "string").alias("repaired"))


@query("""SELECT e.event_id, e.m AS market, json_extract_string(j, '$.d') AS d FROM (SELECT event_id, CASE WHEN user_id % 5 <> 0 THEN event_id - event_id % 3 END AS m FROM events) e
  LEFT JOIN (SELECT CASE WHEN market % 11 <> 0 THEN market END AS market, j FROM info) i ON i.market IS NOT DISTINCT FROM e.m""", MADE, INFO)
def market_info_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _markets(spark, sf_dir)
    info = enrich.extra_info(df, {"d": "$.d"}).select(F.when(F.col("market") % 11 != 0, F.col("market")).alias("market"), "d")
    left = df.select("event_id", F.when(F.col("user_id") % 5 != 0, F.col("event_id") - F.col("event_id") % 3).alias("market"))
    return enrich.join_market(left, info)


@query("""SELECT e.event_id, e.market, e."marketType", CASE t.kind WHEN 0 THEN 'yes-no' WHEN 1 THEN 'categorical' WHEN 2 THEN 'scalar' END AS "marketType_propagated"
  FROM (SELECT event_id, event_id - event_id % 2 AS market, CASE WHEN event_id % 4 <> 3 THEN event_id % 4 END AS "marketType" FROM events) e LEFT JOIN (SELECT * FROM made WHERE kind IS NOT NULL) t ON t.market = e.market""", MADE)
def market_type_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _markets(spark, sf_dir)
    left = df.select("event_id", (F.col("event_id") - F.col("event_id") % 2).alias("market"), "marketType")
    return enrich.join_market(left, enrich.market_type(df))


@query("""SELECT event_id, CASE k WHEN 0 THEN 'to_function_internal' WHEN 1 THEN 'hash_functionAttribute' WHEN 2 THEN 'value' ELSE 'from_function_internal' END AS call_param,
  CASE k WHEN 0 THEN '_to' WHEN 1 THEN 'hash_eventAttribute' WHEN 2 THEN '_value' ELSE 'from' END AS event_param FROM (SELECT event_id, event_id % 4 AS k FROM events)""")
def param_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [(i, decoding.call_param_name(n), decoding.event_param_name(n)) for i, n in enumerate(("_to", "hash", "_value", "from"))]
    table = spark.createDataFrame(names, "k int, call_param string, event_param string")
    df = st.read(spark, sf_dir, "events").select("event_id", F.pmod("event_id", F.lit(4)).alias("k"))
    return df.join(table, "k").drop("k")


# creation graph

CLOSURE = """, reach(a) AS (SELECT 'N1' UNION SELECT CASE WHEN e."from" = r.a THEN e."to" ELSE e."from" END FROM reach r JOIN edges e ON r.a IN (e."from", e."to"))"""


@query("SELECT a AS address FROM reach WHERE a <> 'R1'", st.EDGES + CLOSURE)
def create_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, deny = (spark.createDataFrame([(x,)], "address string") for x in ("N1", "R1"))
    return graph.create_closure(st.edges(spark, sf_dir).select("from", "to"), seeds, deny)


@query("SELECT address FROM (SELECT 'C' || s_suppkey AS address FROM supplier) WHERE address NOT IN (SELECT address FROM dapp)", st.DAPP)
def deny_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = st.read(spark, sf_dir, "supplier").select(F.concat(F.lit("C"), "s_suppkey").alias("address"))
    return graph.deny_list(every, st.dapp(spark, sf_dir))


@query("""SELECT 'x' || "to" AS hash, CASE WHEN 'N1' IN ("from", "to") THEN 1 WHEN "to" LIKE 'N%' THEN 2 ELSE 3 END AS level FROM edges e WHERE EXISTS (SELECT 1 FROM reach WHERE a = e."to")""", st.EDGES + CLOSURE)
def level_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = st.edges(spark, sf_dir)
    touched = e.select("hash", F.explode(F.array("from", "to")).alias("contract"))
    return graph.level_expand(touched, e, spark.createDataFrame([("N1",)], "address string"))[0]


LABELS = """labels AS (SELECT 'C' || s_suppkey AS address, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || ' deployment' END AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


@query("SELECT lower(address) AS address, label AS inherited_label FROM labels", LABELS)
def label_by_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = st.creations(spark, sf_dir).where("`to` LIKE 'C%'")
    return graph.label_by_relative(made, made.select(F.col("from").alias("address")), _lowered(st.factory_labels(spark, sf_dir)))


def _lowered(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("key", F.lower("key"))


@query(
    """SELECT step, lower(s.address) AS address_lower, CASE WHEN substr(s.address, 2)::BIGINT % 10 = 0 THEN 'known ' || s_name ELSE label END AS contract_name
    FROM steps s JOIN labels l ON l.address = s.address JOIN supplier ON 'C' || s_suppkey = s.address""",
    st.STEPS,
    LABELS,
)
def label_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = filters.events(st.steps(spark, sf_dir)).select("step", F.lower("address").alias("address_lower"))
    made = st.creations(spark, sf_dir).where("`to` LIKE 'C%'")
    owners = made.select(F.col("from").alias("address"))
    return enrich.label_contracts(df, made, owners, _lowered(st.factory_labels(spark, sf_dir)), _lowered(st.known_labels(spark, sf_dir)))


# addresses

BLOCKS = """(SELECT lower(a) AS address, min("blockNumber") AS first_block, max("blockNumber") AS last_block FROM (
  SELECT "blockNumber", unnest(["from", "to", address]) AS a FROM steps WHERE {where}) WHERE a IS NOT NULL GROUP BY 1)"""


@query("SELECT * FROM " + BLOCKS.format(where="true"), st.STEPS)
def addr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.address_blocks(st.steps(spark, sf_dir), ["from", "to", "address", "_owner"])


COMBINED = f"""combined AS (SELECT address, min(first_block) AS first_block, max(last_block) AS last_block, min(last_block) AS lookup_block FROM (
  SELECT * FROM {BLOCKS.format(where="address IS NOT NULL")} UNION ALL SELECT * FROM {BLOCKS.format(where="calltype IS NOT NULL")}) GROUP BY address)"""


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = st.steps(spark, sf_dir)
    return addresses.combined_blocks([addresses.address_blocks(x, ["from", "to", "address"]) for x in (df.where("address IS NOT NULL"), df.where("calltype IS NOT NULL"))])


@query("SELECT * FROM combined", st.STEPS, COMBINED)
def addr_blocks_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _combined(spark, sf_dir)


@query(
    """SELECT c.address, CASE WHEN EXISTS (SELECT 1 FROM dapp d WHERE lower(d.address) = c.address) THEN 'dapp' ELSE 'non_dapp' END AS dapp_flag,
    CASE WHEN k.block <= c.lookup_block THEN 'CA' ELSE 'EOA' END AS type, l.label AS contract_label FROM combined c
    LEFT JOIN (SELECT lower('C' || s_suppkey) AS a, s_suppkey % 997 AS block FROM supplier) k ON k.a = c.address LEFT JOIN labels l ON lower(l.address) = c.address""",
    st.STEPS,
    COMBINED,
    st.DAPP,
    LABELS,
)
def address_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = st.read(spark, sf_dir, "supplier")
    code = suppliers.select(F.concat(F.lit("C"), "s_suppkey").alias("address"), F.pmod("s_suppkey", F.lit(997)).alias("block"), F.lit("0x60").alias("code"))
    made = st.creations(spark, sf_dir).where("`to` LIKE 'C%'")
    labels = graph.label_by_relative(made, made.select(F.col("from").alias("address")), _lowered(st.factory_labels(spark, sf_dir)))
    dapp = st.dapp(spark, sf_dir).select(F.lower("address").alias("address"))
    return addresses.address_dictionary(_combined(spark, sf_dir), dapp, code, labels.withColumnRenamed("inherited_label", "contract_label"))


@query("""SELECT l.address, l.block, s.code, s.code IS NOT NULL AS known FROM (SELECT DISTINCT 'C' || l_suppkey AS address, l_orderkey % 1000 AS block FROM lineitem WHERE l_linestatus = 'O') l
  ASOF LEFT JOIN (SELECT 'C' || l_suppkey AS address, l_orderkey % 1000 AS block, max('0x' || l_partkey) AS code FROM lineitem WHERE l_linestatus <> 'O' GROUP BY ALL) s ON l.address = s.address AND l.block >= s.block""")
def code_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open lines ask for a supplier's code, the others captured it."""
    block = (F.col("l_orderkey") % 1000).alias("block")
    lines = st.read(spark, sf_dir, "lineitem").select(F.concat(F.lit("C"), "l_suppkey").alias("address"), block, F.concat(F.lit("0x"), "l_partkey").alias("code"), "l_linestatus")
    return addresses.as_of(lines.where("l_linestatus = 'O'"), lines.where("l_linestatus <> 'O'"), "code", span=100)


@query("""SELECT DISTINCT address FROM (SELECT address FROM steps UNION ALL SELECT "to" FROM steps WHERE calltype IN ('CALL', 'DELEGATECALL')) WHERE address IS NOT NULL""", st.STEPS)
def address_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.address_selection(st.steps(spark, sf_dir))


@query("SELECT 'u' || c_custkey AS address FROM customer UNION SELECT 'u' || o_custkey FROM orders")
def address_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda t, c: st.read(spark, sf_dir, t).select(F.concat(F.lit("u"), c).alias("address"))
    return addresses.address_union(name("customer", "c_custkey"), name("orders", "o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(st.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(st.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))


@query('SELECT coalesce(calltype, \'event\') AS "Activity", count(*) AS n FROM steps GROUP BY 1', st.STEPS)
def activity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.activity_counts(st.steps(spark, sf_dir).select(F.coalesce("calltype", F.lit("event")).alias("Activity")))


@query("""SELECT "from", count(*) AS n FROM edges WHERE "from" LIKE 'N%' GROUP BY 1""", st.EDGES)
def factories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = st.edges(spark, sf_dir)
    return enrich.factories(e, e.where("`from` LIKE 'N%'").select(F.col("from").alias("address")))


# nested traces: an order's root call, with its lines as calls (those on even line numbers emit a log) or as logs of the root


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    log_ = lambda: F.struct(F.col("l_suppkey").cast("string").alias("address"), F.array(F.col("step")).alias("topics"), F.lit("0x").alias("data"))
    df = st.steps(spark, sf_dir).withColumn("l_suppkey", F.coalesce("to", "address"))
    own = F.when(F.col("tracePos") % 2 == 0, F.array(log_()))
    call = F.struct(F.col("calltype").alias("type"), F.col("to").alias("to"), F.col("step").alias("input"), own.alias("logs"))
    by_step = lambda when, what: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("step", what.alias("x"))))), lambda s: s["x"])
    each = df.groupBy("hash").agg(by_step(F.col("calltype").isNotNull(), call).alias("calls"), by_step(F.col("calltype").isNull(), log_()).alias("logs"))
    root = F.struct(F.lit("CALL").alias("type"), F.col("hash").alias("to"), "calls", "logs")
    return each.select("hash", F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), root.alias("result"))).alias("trace_json"))


NODES = """inner_calls AS (
  SELECT hash, step, calltype, "to", ("tracePos" % 2 = 0)::INTEGER AS has_log, row_number() OVER w AS i, count(*) OVER (PARTITION BY hash) AS n,
         coalesce(sum(1 + ("tracePos" % 2 = 0)::INTEGER) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM steps WHERE calltype IS NOT NULL WINDOW w AS (PARTITION BY hash ORDER BY step)
),
totals AS (SELECT h.hash, coalesce(max(c.n), 0) AS n, coalesce(sum(1 + has_log), 0) AS size FROM (SELECT DISTINCT hash FROM steps) h LEFT JOIN inner_calls c ON c.hash = h.hash GROUP BY h.hash),
nodes AS (
  SELECT hash, 1::INTEGER AS "tracePos", '1' AS "tracePosDepth", NULL::INTEGER AS "eventPos", 'CALL' AS type, hash AS "to", NULL AS topic FROM totals
  UNION ALL SELECT hash, (before + 2)::INTEGER, '1.' || i, NULL, calltype, "to", NULL FROM inner_calls
  UNION ALL SELECT hash, (before + 3)::INTEGER, '1.' || i || '.1', 1, NULL, NULL, step FROM inner_calls WHERE has_log = 1
  UNION ALL SELECT hash, (1 + size + j)::INTEGER, '1.' || (n + j), j::INTEGER, NULL, NULL, step FROM (
    SELECT s.hash, step, row_number() OVER (PARTITION BY s.hash ORDER BY step) AS j FROM steps s WHERE calltype IS NULL) l JOIN totals USING (hash)
)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.flatten_traces(_traces(spark, sf_dir))


@query('SELECT hash, "tracePos", "tracePosDepth", "eventPos", type, "to", topic FROM nodes', st.STEPS, NODES)
def trace_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("hash", "tracePos", "tracePosDepth", "eventPos", "type", "to", F.get("topics", F.lit(0)).alias("topic"))


@query('SELECT hash, "tracePos", type FROM nodes', st.STEPS, NODES)
def trace_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("hash", "tracePos", "type")


@query('SELECT hash, "tracePos", "tracePosDepth" FROM nodes', st.STEPS, NODES)
def trace_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("hash", "tracePos", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("tracePosDepth"))


@query('SELECT hash, topic, "eventPos" FROM nodes WHERE topic IS NOT NULL', st.STEPS, NODES)
def event_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).where("topics IS NOT NULL").select("hash", F.get("topics", F.lit(0)).alias("topic"), "eventPos")


@query("""SELECT hash, CASE WHEN type IS NULL THEN 'logs' ELSE 'calls' END AS part, CASE WHEN type IS NULL THEN "eventPos" ELSE split_part("tracePosDepth", '.', 2)::INTEGER END AS item_pos, type
  FROM nodes WHERE "tracePosDepth" <> '1' AND NOT contains("tracePosDepth"[3:], '.')""", st.STEPS, NODES)
def explode_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = _traces(spark, sf_dir).select("hash", F.try_variant_get(F.parse_json("trace_json"), "$.result", "variant").alias("node"))
    out = trace.explode_level(roots)
    return out.select("hash", "part", (F.col("item_pos") + 1).alias("item_pos"), F.try_variant_get("node", "$.type", "string").alias("type"))


# decoding: numbers of the events table are put into data and must come out again


def word(c: Column) -> Column:
    """A number as the hex digits of a 32-byte word."""
    return F.lpad(F.lower(F.hex(c)), 64, "0")


CONTRACT_ABI = [
    {"type": "event", "name": "Deposited", "inputs": [{"name": "user", "type": "uint256", "indexed": True}, {"name": "hash", "type": "uint256", "indexed": False}, {"name": "parts", "type": "uint256[2]", "indexed": False}]},
    {"type": "function", "name": "tradeWithLimit", "inputs": [{"name": "_market", "type": "uint256"}, {"name": "to", "type": "address"}, {"name": "gas", "type": "uint256"}]},
]
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"


def _abis(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("0xC1", json.dumps(CONTRACT_ABI))], "address string, abi string")


def _logs(spark: SparkSession, sf_dir: str, own: bool) -> DataFrame:
    """Deposits of one contract, or transfers (of coins and of single tokens by turns) of another; every tenth topic is unknown."""
    e = st.read(spark, sf_dir, "events")
    hexed = lambda c: F.concat(F.lit("0x"), word(c))
    if own:
        first = F.when(F.col("event_id") % 10 == 0, "0x" + "11" * 32).otherwise(abi.event_topic(CONTRACT_ABI[0]))
        return e.select("event_id", F.lit("0xc1").alias("address"), F.array(first, hexed(F.col("user_id"))).alias("topics"), F.concat(F.lit("0x"), word(F.col("event_id")), word(F.col("user_id")), word(F.col("event_id") + 7)).alias("data"))
    single = F.col("event_id") % 2 == 1
    topics = F.array(F.lit(TRANSFER), hexed(F.col("user_id")), hexed(F.col("event_id")))
    topics = F.when(single, F.concat(topics, F.array(hexed(F.col("event_id") * 3)))).otherwise(topics)
    return e.select("event_id", F.lit("0xc2").alias("address"), topics.alias("topics"), F.when(single, "0x").otherwise(hexed(F.col("event_id") * 3)).alias("data"))


DEPOSITS = """SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN 'Deposited' END AS name, CASE WHEN event_id % 10 <> 0 THEN user_id::VARCHAR END AS "user", CASE WHEN event_id % 10 <> 0 THEN event_id::VARCHAR END AS hash_attribute,
  CASE WHEN event_id % 10 <> 0 THEN '["' || user_id || '","' || (event_id + 7) || '"]' END AS parts, event_id % 10 <> 0 AS decoded FROM events"""


def _deposits(df: DataFrame) -> DataFrame:
    p = F.col("params")
    return df.select("event_id", "name", p["user"].alias("user"), p["hash_eventAttribute"].alias("hash_attribute"), p["parts"].alias("parts"), "decoded")


@query(DEPOSITS)
def decode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deposits(decoding.decode_events(_logs(spark, sf_dir, True), _abis(spark)))


@query(DEPOSITS)
def decode_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deposits(decoding.decode_logs(_logs(spark, sf_dir, True), _abis(spark), allow_undecoded=True))


@query("""SELECT event_id, 'Transfer' AS name, CASE WHEN event_id % 2 = 1 THEN 'ABI_ERC_721' ELSE 'ABI_ERC_20' END AS abi_source, printf('0x%040x', user_id) AS sender, printf('0x%040x', event_id) AS receiver, (event_id * 3)::VARCHAR AS amount FROM events""")
def decode_events_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = decoding.decode_events(_logs(spark, sf_dir, False), _abis(spark))
    p = F.col("params")
    return df.select("event_id", "name", "abi_source", p["_from"].alias("sender"), p["_to"].alias("receiver"), F.coalesce(p["_value"], p["_tokenId"]).alias("amount"))


@query("""SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN '<Function tradeWithLimit(uint256,address,uint256)>' END AS name, CASE WHEN event_id % 10 <> 0 THEN user_id::VARCHAR END AS market,
  CASE WHEN event_id % 10 <> 0 THEN printf('0x%040x', event_id) END AS receiver, CASE WHEN event_id % 10 <> 0 THEN (event_id * 5)::VARCHAR END AS gas_attribute FROM events""")
def decode_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = st.read(spark, sf_dir, "events")
    selector = F.when(F.col("event_id") % 10 == 0, "0x00000000").otherwise(abi.selector(CONTRACT_ABI[1]))
    calls = e.select("event_id", F.lit("0xC1").alias("to"), F.concat(selector, word(F.col("user_id")), word(F.col("event_id")), word(F.col("event_id") * 5)).alias("input"))
    p = F.col("params")
    return decoding.decode_functions(calls, _abis(spark)).select("event_id", "name", p["market"].alias("market"), p["to_function_internal"].alias("receiver"), p["gas_functionAttribute"].alias("gas_attribute"))


TUPLE = [{"name": "id", "type": "uint256"}, {"name": "parts", "type": "uint256[]"}]
#: A contract for each of four users' remainders, each with its own event and function of tuples, texts and unnamed inputs.
ORDER_ABIS = {
    f"0xd{i}": [
        {"type": "event", "name": f"Order{i}", "inputs": [{"name": "who", "type": "address", "indexed": True}, {"name": "key", "type": "tuple", "components": TUPLE, "indexed": True}, {"name": "note", "type": "string", "indexed": False}, {"name": "order", "type": "tuple", "components": TUPLE, "indexed": False}, {"name": "", "type": "uint256", "indexed": False}]},
        {"type": "function", "name": f"place{i}", "inputs": [{"name": "", "type": "address"}, {"name": "_orders", "type": "tuple[]", "components": TUPLE}, {"name": "", "type": "bytes"}]},
    ]
    for i in range(4)
}


def _order_abis(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, json.dumps(entries)) for a, entries in ORDER_ABIS.items()], "address string, abi string")


def _by_contract(make) -> Column:
    """make(entries) of the contract that a user's remainder names."""
    out = F.lit(None).cast("string")
    for i, entries in enumerate(ORDER_ABIS.values()):
        out = F.when(F.col("user_id") % 4 == i, F.lit(make(entries))).otherwise(out)
    return out


@query("""SELECT event_id, 'Order' || user_id % 4 AS name, printf('0x%040x', user_id) AS who, printf('0x%064x', event_id) AS key, 'key' AS undecoded, 'hello' AS note,
  '["' || event_id || '",["' || (event_id + 1) || '","' || (event_id + 2) || '"]]' AS "order", user_id::VARCHAR AS unnamed FROM events""")
def decode_events_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = st.read(spark, sf_dir, "events")
    n = lambda x: word(F.lit(x))
    text = F.rpad(F.lower(F.hex(F.lit("hello"))), 64, "0")
    order = [word(F.col("event_id")), n(0x40), n(2), word(F.col("event_id") + 1), word(F.col("event_id") + 2)]
    data = F.concat(F.lit("0x"), n(0x60), n(0xA0), word(F.col("user_id")), n(5), text, *order)
    first = _by_contract(lambda entries: abi.event_topic(entries[0]))
    first = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("0x"), F.upper(F.substring(first, 3, 64)))).otherwise(first)
    topics = F.array(first, *[F.concat(F.lit("0x"), word(F.col(c))) for c in ("user_id", "event_id")])
    logs = e.select("event_id", F.concat(F.lit("0xD"), F.col("user_id") % 4).alias("address"), topics.alias("topics"), data.alias("data"))
    p = F.col("params")
    return decoding.decode_events(logs, _order_abis(spark)).select("event_id", "name", p["who"].alias("who"), p["key"].alias("key"), F.array_join("undecoded_params", ",").alias("undecoded"), p["note"].alias("note"), p["order"].alias("order"), p["arg4"].alias("unnamed"))


@query("""SELECT event_id, '<Function place' || user_id % 4 || '(address,(uint256,uint256[])[],bytes)>' AS name, printf('0x%040x', user_id) AS first_unnamed,
  '[["' || event_id || '",[]],["' || user_id || '",["' || event_id || '"]]]' AS orders, '0x0102' AS last_unnamed FROM events""")
def decode_functions_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = st.read(spark, sf_dir, "events")
    n = lambda x: word(F.lit(x))
    one, other = [word(F.col("event_id")), n(0x40), n(0)], [word(F.col("user_id")), n(0x40), n(1), word(F.col("event_id"))]
    body = [word(F.col("user_id")), n(0x60), n(0x1A0), n(2), n(0x40), n(0xA0), *one, *other, n(2), F.rpad(F.lit("0102"), 64, "0")]
    calls = e.select("event_id", F.concat(F.lit("0xD"), F.col("user_id") % 4).alias("to"), F.concat(_by_contract(lambda entries: abi.selector(entries[1])), *body).alias("input"))
    p = F.col("params")
    return decoding.decode_functions(calls, _order_abis(spark)).select("event_id", "name", p["arg0"].alias("first_unnamed"), p["orders"].alias("orders"), p["arg2"].alias("last_unnamed"))


@query("""SELECT event_id, 1 AS event_pos, printf('0x%040x', user_id) AS address, printf('0x%064x', event_id) AS topic, printf('0x%016x', user_id) AS data FROM events""")
def decode_structlogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = st.read(spark, sf_dir, "events")
    callee = F.lpad(F.lower(F.hex("user_id")), 40, "0")
    steps = F.array(
        F.struct(F.lit("CALL").alias("op"), F.lit(1).alias("depth"), F.array(callee, F.lit("0f")).alias("stack"), F.array(F.lit("")).alias("memory")),
        F.struct(F.lit("LOG1").alias("op"), F.lit(2).alias("depth"), F.array(word(F.col("event_id")), F.lit("08"), F.lit("18")).alias("stack"), F.array(word(F.col("user_id"))).alias("memory")),
    )
    return decoding.extract_struct_logs(e.select("event_id", F.to_json(steps).alias("struct_logs"), F.lit("0xc0").alias("to"))).select("event_id", "event_pos", "address", F.get("topics", F.lit(0)).alias("topic"), "data")


@query("""SELECT event_id, i::INTEGER AS event_pos, CASE WHEN i IN (1, 2, 4) THEN '0x' || repeat('c0', 20) WHEN i = 3 THEN printf('0x%040x', event_id) ELSE printf('0x%040x', user_id + 1) END AS address,
  printf('0x%064x', i) AS topic FROM events, range(1, 7) t(i)""")
def struct_log_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs before and in a delegate call, in a call made there, after it, and in a creation with a delegate call inside."""
    e = st.read(spark, sf_dir, "events")
    step = lambda op, depth, *stack: F.struct(F.lit(op).alias("op"), F.lit(depth).alias("depth"), F.array(*stack).alias("stack"), F.array(F.lit("")).alias("memory"))
    log_ = lambda i, depth: step("LOG1", depth, word(F.lit(i)), F.lit("0x0"), F.lit("0x0"))
    opens = lambda op, depth, to: step(op, depth, word(to), F.lit("0x9"))
    steps = [log_(1, 1), opens("DELEGATECALL", 1, F.col("user_id")), log_(2, 2), opens("CALL", 2, F.col("event_id")), log_(3, 3), log_(4, 1)]
    steps += [step("CREATE2", 1), log_(5, 2), opens("CALLCODE", 2, F.lit(7)), log_(6, 3), step("POP", 1, word(F.col("user_id") + 1))]
    traces = e.select("event_id", F.to_json(F.array(*steps)).alias("struct_logs"), F.lit("0x" + "C0" * 20).alias("to"))
    return decoding.extract_struct_logs(traces).select("event_id", "event_pos", "address", F.get("topics", F.lit(0)).alias("topic"))


TOPICS = (
    ("Transfer(address,address,uint256)", TRANSFER),
    ("Approval(address,address,uint256)", "0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925"),
    ("ApprovalForAll(address,address,bool)", "0x17307eab39ab6107e8899845ad3d59bd9653f200f220920489ca2b5937696c31"),
    ("Sent(address,address,address,uint256,bytes,bytes)", "0x06b541ddaa720db2b10a4d0cdac39b8d360425fc073085fac19bc82614677987"),
    ("Minted(address,address,uint256,bytes,bytes)", "0x2fe5be0146f74c5bce36c0b80911af6c7d86ff27e89d5cfa61fc681327954e5d"),
    ("Burned(address,address,uint256,bytes,bytes)", "0xa78a9be3a7b862d26933ad85fb11d80ef66b8f972d7cbba06621d583943a4098"),
    ("AuthorizedOperator(address,address)", "0xf4caeb2d6ca8932a215a353d0703c326ec2d81fc68170f320eb2ab49e9df61f9"),
    ("RevokedOperator(address,address)", "0x50546e66e5f44d728365dc3908c63bc5cfeeab470722c1677e3073a6ac294aa1"),
    ("TransferSingle(address,address,address,uint256,uint256)", "0xc3d58168c5ae7397731d063d5bbf3d657854427343f4c083240f7aacaa2d0f62"),
    ("TransferBatch(address,address,address,uint256[],uint256[])", "0x4a39dc06d4c0dbc64b70af90fd698a233a518aa5d07e595d983b8c0526c8f7fb"),
    ("URI(string,uint256)", "0x6bb7ff708619ba0610cba295a58592e0451dee2622938c8755667688daf3529b"),
    ("Mint(address,uint256)", "0x0f6798a560793a54c3bcfe86a93cde1e73087d944c0ea20544137d4121396885"),
    ("Burn(address,uint256)", "0xcc16f5dbb4873280815c1ee09dbd06736cffcc184412cf7a71a0fdb75d397ca5"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TOPICS) + ") AS t(signature, topic0)")
def topic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.topic_table(spark).select("signature", "topic0").distinct()
