"""One small chain, from captured responses to the written event log."""

import json
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chainlog.__main__ import main
from chainlog.functions import abi
from chainlog.operators import enrich, ocel, relational
from chainlog.plans.config import Config
from chainlog.plans.pipeline import Captured, run
from chainlog.sources import captured, sinks

ROOT, CHILD, USER, OTHER = ("0x" + c * 40 for c in "abcd")
DEPOSIT = {"type": "event", "name": "Deposited", "inputs": [{"name": "sender", "type": "address", "indexed": True}, {"name": "orderId", "type": "bytes4", "indexed": False}, {"name": "orderType", "type": "uint8", "indexed": False}]}
BUY = {"type": "function", "name": "buy", "inputs": [{"name": "_market", "type": "address"}]}


def word(kind, value):
    return abi.encode_values([kind], [value]).hex()


def trace_of(n):
    log = {"address": ROOT.upper().replace("X", "x"), "topics": [abi.event_topic(DEPOSIT), "0x" + word("address", USER)], "data": "0x" + word("bytes4", b"ab12") + word("uint8", n)}
    unknown = {"address": OTHER, "topics": ["0x" + "99" * 32], "data": "0x"}
    calls = [
        {"type": "CREATE", "from": ROOT, "to": CHILD, "gas": "0x1"},
        {"type": "CREATE", "from": OTHER, "to": None, "error": "out of gas" if n == 2 else None},
        {"type": "CALL", "from": USER, "to": ROOT, "value": "0x0", "input": abi.selector(BUY) + word("address", CHILD)},
        {"type": "DELEGATECALL", "from": ROOT, "to": OTHER},
    ]
    return {"type": "CALL", "from": USER, "to": ROOT, "value": "0x5", "input": "0x", "gas": "0x4A817C800", "calls": calls, "logs": [log, unknown]}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("captured")
    row = lambda h, b: {"hash": h, "blockNumber": str(b), "timeStamp": str(1530000000 + b), "contractAddress": ROOT}
    write = lambda name, xs: (d / name).write_text("".join(json.dumps(x) + "\n" for x in xs))
    write("normal.json", [{"status": "1", "result": [row("t1", 1), row("t2", 2)]}, {"status": "0", "message": "NOTOK"}, {"status": "1", "result": [row("t2", 2), row("late", 99)]}])
    write("internal.json", [{"status": "1", "result": [row("t2", 2)]}])
    write("traces.json", [{"hash": f"t{n}", "response": {"result": trace_of(n)}} for n in (1, 2)] + [{"hash": "late", "response": {"result": trace_of(3)}}, {"hash": "bad", "response": {"error": "x"}}])
    write("abis.json", [{"address": ROOT.upper(), "status": "1", "result": json.dumps([DEPOSIT, BUY])}, {"address": OTHER, "status": "0", "result": "not verified"}])
    (d / "mappings.json").write_text(json.dumps({"event_map_dapp": {"Deposited": "deposit Ether"}, "calls_zero_value_map_dapp": {"buy": "call to buy"}, "factory_contract_map": {ROOT: "MarketXFactory"}, "split_zero_value_calls": {"call to buy": ""}}))
    return str(d)


def data(spark, d):
    tx = captured.transactions(captured.transaction_list(spark, f"{d}/normal.json", "normal"), captured.transaction_list(spark, f"{d}/internal.json", "internal"), None)
    index = spark.createDataFrame([("t1", 4)], "hash string, ix long")
    return Captured(tx, captured.traces(spark, f"{d}/traces.json"), captured.abis(spark, f"{d}/abis.json"), captured.mappings(spark, f"{d}/mappings.json"), index)


def test_sources(spark, files):
    d = data(spark, files)
    assert {(r["hash"], r["source"]) for r in d.transactions.collect()} == {("t1", "normal"), ("t2", "internal"), ("late", "normal")}
    assert {r["hash"] for r in d.traces.collect()} == {"t1", "t2", "late"}
    assert [r["address"] for r in d.abis.collect()] == [ROOT]
    assert captured.mapping(d.mappings, "event_map_dapp").collect() == [("Deposited", "deposit Ether")]


def test_all_stages(spark, files, tmp_path):
    config = Config(dapp=(ROOT,), max_block=10, sensitive_events=True)
    log = run(spark, config, data(spark, files), str(tmp_path))
    at = lambda stage, name: spark.read.parquet(f"{tmp_path}/output/{stage}/{name}.parquet")
    trace = at("extraction", "trace")
    assert trace.count() == 14 and trace.where("transactionIndex = 4").count() == 7 and trace.where("tx_index_missing").count() == 7
    assert {r["address"] for r in at("extraction", "contracts").collect()} == {ROOT, CHILD}
    events = at("transformation", "dapp_events").collect()
    assert {(r["Activity"], r["sender"], r["orderId"], r["orderType"], r["flag_reverted"]) for r in events} == {("deposit Ether", USER, "0x" + b"ab12".hex(), "1", False), ("deposit Ether", USER, "0x" + b"ab12".hex(), "2", True)}
    zero = at("transformation", "dapp_zero_value_calls").first()
    assert (zero["Activity"], zero["Activity_raw"], zero["market"], zero["contract_name"]) == ("call to buy, contract: MarketXFactory", "call to buy", CHILD, "MarketXFactory")
    undecoded = at("transformation", "non_dapp_events").first()
    assert undecoded["Activity"] == "undecoded event" and not undecoded["decoded"]
    assert at("transformation", "dapp_creations").first()["Activity"] == "create new contract"
    objects = {tuple(r) for r in log["ocel_objects"].collect()}
    assert {("EOA_" + USER, "EOA", "EOA"), ("CONTRACT_" + ROOT, "CONTRACT", "MarketXFactory"), ("MARKET_" + CHILD, "MARKET", None)} <= objects
    ids = [r["ocel:eid"] for r in log["ocel_events"].collect()]
    assert len(ids) == len(set(ids))
    again = run(spark, Config(dapp=(ROOT,), max_block=10, stages=frozenset({"transformation"})), data(spark, files), str(tmp_path), xml=False)
    assert again["ocel_events"].count() == len(ids)


def test_levels_choose_transactions(spark, files, tmp_path):
    d = data(spark, files)
    touches = spark.createDataFrame([("t1", ROOT.upper().replace("X", "x")), ("t2", OTHER)], "hash string, contract string")
    only = Captured(d.transactions, d.traces, d.abis, d.mappings, d.tx_index, touches)
    config = Config(dapp=(ROOT,), max_block=10, stages=frozenset({"extraction", "decoding"}))
    assert run(spark, config, only, str(tmp_path)) == {}
    trace = spark.read.parquet(f"{tmp_path}/output/extraction/trace.parquet")
    assert {r["hash"] for r in trace.select("hash").distinct().collect()} == {"t1"}
    lists = [captured.transaction_list(spark, f"{files}/{n}.json", n) for n in ("normal", "internal")]
    assert captured.touches(*lists).count() == 3


def test_command_line(spark, files, tmp_path):
    (tmp_path / "config.json").write_text(json.dumps({"contracts": {"dapp": [ROOT]}, "block_range": {"min_block": 0, "max_block": 10}}))
    main([str(tmp_path / "config.json"), files, str(tmp_path / "out")])
    assert spark.read.parquet(f"{tmp_path}/out/output/transformation/ocel_events.parquet").count() > 0
    assert list((tmp_path / "out/output/transformation/log.xmlocel").glob("part-*"))


def test_transactions_from_logs_only(spark, files, tmp_path):
    """A transaction that no list has, only a log; with captured indexes, code, and an order by numbers."""
    d = tmp_path / "captured"
    d.mkdir()
    write = lambda name, xs: (d / name).write_text("".join(json.dumps(x) + "\n" for x in xs))
    for name in ("normal.json", "abis.json", "mappings.json"):
        (d / name).write_text(Path(f"{files}/{name}").read_text())
    inner = [{"type": "CALL", "from": USER, "to": ROOT, "value": "0x1", "input": "0x"} for _ in range(12)]
    write("traces.json", [{"hash": h, "response": {"result": {"type": "CALL", "from": USER, "to": ROOT, "value": "0x5", "input": "0x", "calls": inner}}} for h in ("t1", "only_log")])
    write("logs.json", [{"result": [{"transactionHash": "only_log", "blockNumber": "0x3", "address": ROOT}]}, {"result": None}, {"result": [{"transactionHash": "only_log", "blockNumber": "0x3", "address": ROOT.upper()}]}])
    write("blocks.json", [{"result": {"number": "0x3", "timestamp": hex(1530000001)}}])
    write("tx_index.json", [{"hash": "t1", "transactionIndex": "0x9"}, {"hash": "only_log", "transactionIndex": "2"}])
    write("code.json", [{"address": ROOT, "block": "0x1", "result": "0x60"}, {"address": USER, "block": 1, "result": "0x"}])
    (tmp_path / "config.json").write_text(json.dumps({"contracts": {"dapp": [ROOT]}, "block_range": {"min_block": 0, "max_block": 10}, "misc": {"order_by_tx_index": True}}))
    main([str(tmp_path / "config.json"), str(d), str(tmp_path / "out")])
    at = lambda name: spark.read.parquet(f"{tmp_path}/out/output/{name}.parquet")
    trace = at("extraction/trace")
    assert {(r["hash"], r["transactionIndex"]) for r in trace.select("hash", "transactionIndex").distinct().collect()} == {("t1", 9), ("only_log", 2)}
    ids = [line.split('"')[1] for line in "".join(p.read_text() for p in sorted((tmp_path / "out/output/transformation/log.xmlocel").glob("part-*"))).split("\n") if line.startswith("<event id")]
    assert ids == [f"EID_{h}_{i}" for h in ("only_log", "t1") for i in range(1, 14)]
    assert {(r["address"], r["dapp_flag"], r["type"], r["contract_label"]) for r in at("transformation/address_dictionary").collect()} == {(ROOT, "dapp", "CA", "MarketXFactory"), (USER, "non_dapp", "EOA", None)}


@pytest.mark.parametrize("version", ["2.0", "1.0"])
def test_xml(spark, tmp_path, version):
    objects = spark.createDataFrame([("EOA_a&b", "EOA", "EOA"), ("TOKEN_1", "TOKEN", None)], "`ocel:oid` string, `ocel:type` string, category string")
    when = F.lit("2020-01-02 03:04:05").cast("timestamp")
    events = spark.createDataFrame([("e1", 'say "<hi>"'), ("e2", "go")], "`ocel:eid` string, `ocel:activity` string").withColumn("ocel:timestamp", when)
    e2o = spark.createDataFrame([("e1", "EOA_a&b", "EOA", "EOA_FROM"), ("e1", "TOKEN_1", "TOKEN", "TOKEN")], "`ocel:eid` string, `ocel:oid` string, `ocel:type` string, `ocel:qualifier` string")
    sinks.write_ocel_xml(objects, events, e2o, f"{tmp_path}/log", version)
    root = ET.fromstring("".join(p.read_text() for p in sorted(Path(f"{tmp_path}/log").glob("part-*"))))
    assert len(root.find("events")) == 2 and len(root.find("objects")) == 2
    if version == "2.0":
        first = next(e for e in root.find("events") if e.get("id") == "e1")
        assert first.get("type") == 'say "<hi>"' and {r.get("object-id") for r in first.iter("relationship")} == {"EOA_a&b", "TOKEN_1"}
        assert {t.get("name") for t in root.find("object-types")} == {"EOA", "TOKEN"} and len(root.find("event-types")) == 2


def test_tables_with_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], {"k": "v"})], "i int, xs array<string>, m map<string,string>")
    sinks.write_table(df, f"{tmp_path}/t", csv=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/t_csv").first()["i"] == "1" and spark.read.parquet(f"{tmp_path}/t").first()["xs"] == ["a", "b"]


RAW = {
    "ethereum_node": {"protocol": "http://", "host": "127.0.0.1", "port": 8081},
    "contracts": {"dapp": ["0xAB"], "non_dapp": ["0x00"]},
    "block_range": {"min_block": 1, "max_block": 5},
    "extraction": {"normal_transactions": True, "internal_transactions": False, "transactions_by_events": True},
    "output": {"dapp": {"events": True, "calls": False}, "non_dapp": {"creations": False}},
    "stages": {"extraction": False},
    "misc": {"sensitive_events": True, "log_folder": "x"},
}


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(RAW))
    c = Config.load(str(tmp_path / "c.json"))
    assert c.dapp == ("0xab",) and c.node_url == "http://127.0.0.1:8081" and c.sources == {"normal_transactions", "transactions_by_events"}
    assert ("dapp", "calls") not in c.output and ("non_dapp", "creations") not in c.output and ("dapp", "events") in c.output
    assert c.stages == {"decoding", "transformation"} and c.sensitive_events and c.log_folder == "x"


@pytest.mark.parametrize("bad", [{"contracts": {}}, {"contracts": {"dapp": [""]}}, {"block_range": {"min_block": 9, "max_block": 1}}, {"stages": {"decoding": "yes"}}])
def test_bad_config(bad):
    with pytest.raises(ValueError):
        Config.from_dict(RAW | bad)


def test_market_null_matches_null(spark):
    left = spark.createDataFrame([(1, None), (2, "m"), (3, "z")], "i int, market string")
    right = spark.createDataFrame([(None, 7), ("m", 8), ("m", 9)], "market string, i int")
    got = sorted((r["i"], r["i_propagated"]) for r in enrich.join_market(left, right).collect())
    assert [g for g in got if g[1] is not None] == [(1, 7), (2, 8), (2, 9)] and (3, None) in got


def test_market_null_may_match_nothing(spark):
    left = spark.createDataFrame([(1, None), (2, "m")], "i int, market string")
    right = spark.createDataFrame([(None, 7), ("m", 8)], "market string, i int")
    assert sorted((r["i"], r["i_propagated"]) for r in enrich.join_market(left, right, null_matches=False).collect()) == [(1, None), (2, 8)]


def test_broken_json_and_missing_columns(spark):
    df = spark.createDataFrame([("create market", "a", '{"d": "cut he'), ("create market", "b", None), ("create market", "c", "{nonsense"), ("other", "d", "{}")], "Activity string, market string, extraInfo string")
    got = {r["market"]: (r["d"], r["extra_info_broken"]) for r in enrich.extra_info(df, {"d": "$.d"}).collect()}
    assert got == {"a": ("cut he", False), "b": (None, False), "c": (None, True)}
    assert enrich.rename_attribute(df, "absent", "new", df).columns == df.columns
    assert enrich.contract_sensitive(df, ("x",)).first()["Activity_contract_sensitive"] is None
    assert enrich.label_contracts(df, df, df, df, df) is df


def test_keep_last(spark):
    df = spark.createDataFrame([("h", 1, "a", None), ("h", 2, None, 5), ("g", 1, "b", 1)], "hash string, rank int, name string, n int")
    assert {tuple(r) for r in relational.keep_last(df, "hash", "rank").collect()} == {("h", 2, None, 5), ("g", 1, "b", 1)}
    assert {tuple(r) for r in relational.keep_last_row(df, "hash", "rank").collect()} == {("h", 2, None, 5), ("g", 1, "b", 1)}


def test_first_known_category(spark):
    df = spark.createDataFrame([("t", None, 1), ("t", "second", 2), ("t", "third", 3), ("u", None, 1), (None, "x", 1)], "token string, tokenType_name string, tracePos int")
    assert {(r[0], r[2]) for r in ocel.kind_objects(df, "TOKEN").collect()} == {("TOKEN_t", "second"), ("TOKEN_u", None)}
    with_time = df.withColumns({"Activity": F.lit("a"), "timeStamp": F.lit(1), "txHash": F.lit("h"), "transactionIndex": F.lit(0)})
    assert ocel.in_log_order(with_time, by_index=True).first()["tracePos"] == 1
    assert {r["ocel:type"] for r in ocel.ocel_objects(with_time).collect()} == {"TOKEN"}
