import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chainlog.functions import abi, decoding
from chainlog.functions.keccak import keccak256

A, B = "0x" + "0a" * 20, "0x" + "0b" * 20
TOPIC = {abi.signature(e): abi.event_topic(e) for es in abi.FALLBACK_ABIS.values() for e in es}


def topic(kind, value):
    return "0x" + abi.encode_values([kind], [value]).hex()


def test_keccak():
    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak256(b"x" * 136) != keccak256(b"x" * 135)
    assert TOPIC["Transfer(address,address,uint256)"] == "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"


KINDS = st.recursive(
    st.sampled_from(["uint256", "int64", "address", "bool", "bytes4", "bytes", "string"]),
    lambda k: st.one_of(k.map(lambda x: x + "[]"), k.map(lambda x: x + "[2]"), st.lists(k, min_size=1, max_size=3).map(lambda x: f"({','.join(x)})")),
    max_leaves=4,
)


def values(kind):
    if a := abi._array(kind):
        item, n = a
        return st.lists(values(item), min_size=n or 0, max_size=n if n is not None else 3)
    if kind[0] == "(":
        return st.tuples(*map(values, abi._split(kind[1:-1])))
    return {
        "uint256": st.integers(0, 2**256 - 1), "int64": st.integers(-(2**63), 2**63 - 1), "address": st.binary(min_size=20, max_size=20).map(lambda b: "0x" + b.hex()),
        "bool": st.booleans(), "bytes4": st.binary(min_size=4, max_size=4), "bytes": st.binary(max_size=70), "string": st.text(max_size=40),
    }[kind]


@given(st.lists(KINDS, min_size=1, max_size=3).flatmap(lambda ks: st.tuples(st.just(ks), st.tuples(*map(values, ks)))))
@settings(max_examples=150, deadline=None)
def test_round_trip(case):
    kinds, given_ = case
    assert abi.decode_values(kinds, abi.encode_values(kinds, list(given_))) == list(given_)


@pytest.mark.parametrize(
    ("kind", "data", "error"),
    [
        ("uint256", b"\0" * 31, abi.ShortData),
        ("uint8", b"\0" * 30 + b"\1\0", abi.BadPadding),
        ("address", b"\1" + b"\0" * 31, abi.BadPadding),
        ("bool", b"\0" * 31 + b"\2", abi.BadPadding),
        ("int8", b"\0" * 31 + b"\xff", abi.BadPadding),
        ("bytes4", b"\1" * 32, abi.BadPadding),
        ("bytes", abi.encode_values(["uint256", "uint256"], [32, 33]) + b"\1" * 33 + b"\0" * 31, None),
        ("bytes", abi.encode_values(["uint256", "uint256"], [32, 1]) + b"\1" * 32, abi.BadPadding),
        ("uint256[]", abi.encode_values(["uint256", "uint256"], [32, 2**200]), abi.ShortData),
        ("nonsense", b"\0" * 32, abi.AbiError),
    ],
)
def test_strictness(kind, data, error):
    if error is None:
        assert abi.decode_values([kind], data) == [b"\1" * 33]
    else:
        with pytest.raises(error):
            abi.decode_values([kind], data)


def test_tuples_in_signatures():
    inner = {"type": "tuple[3]", "components": [{"type": "uint256"}, {"type": "tuple[]", "components": [{"type": "address"}]}]}
    assert abi.signature({"name": "f", "inputs": [inner, {"type": "bytes"}]}) == "f((uint256,(address)[])[3],bytes)"


def decode(topics, data, entry=None):
    return decoding.decode_one_log(topics, data, json.dumps(entry) if entry else None)


def test_transfers_differ_by_their_indexed_values():
    t = TOPIC["Transfer(address,address,uint256)"]
    coin = decode([t, topic("address", A), topic("address", B)], topic("uint256", 5))
    token = decode([t, topic("address", A), topic("address", B), topic("uint256", 7)], "0x")
    assert coin[:2] == ("Transfer", {"_from": A, "_to": B, "_value": "5"}) and coin[4] == "ABI_ERC_20"
    assert token[1]["_tokenId"] == "7" and token[4] == "ABI_ERC_721"


def test_own_abi_wins_and_broken_data_fall_through():
    own = {"type": "event", "name": "Transfer", "inputs": [{"name": n, "type": k, "indexed": i} for n, k, i in (("a", "address", True), ("b", "address", True), ("hash", "uint256", False))]}
    t = TOPIC["Transfer(address,address,uint256)"]
    assert decode([t, topic("address", A), topic("address", B)], topic("uint256", 5), own)[1] == {"a": A, "b": B, "hash_eventAttribute": "5"}
    bad = decode([t, topic("address", A), topic("address", B)], "0x01", own)
    assert bad[0] is None and not bad[3] and "ShortData" in bad[5]


def test_logs_without_topics_and_unknown_ones():
    assert decode([], "0x")[5] == "anonymous event"
    assert decode(["0x" + "77" * 32], "0x")[5] == "unknown topic"
    all_in_data = abi.decode_log(abi.FALLBACK_ABIS["ABI_ERC_20"][0], [], "0x" + abi.encode_values(["address", "address", "uint256"], [A, B, 1]).hex())
    assert [v for _, v, _ in all_in_data] == [A, B, "1"]


def test_indexed_text_stays_encoded():
    entry = {"name": "Named", "inputs": [{"name": "label", "type": "string", "indexed": True}, {"name": "n", "type": "uint256", "indexed": False}]}
    word = "0x" + "ff" * 32
    assert abi.decode_log(entry, [word], "0x") == [("label", word, False), ("n", "0", True)]


def test_param_names():
    assert [decoding.call_param_name(n) for n in ("_x", "to", "_from", "hash", "__y")] == ["x", "to_function_internal", "from_function_internal", "hash_functionAttribute", "_y"]
    assert [decoding.event_param_name(n) for n in ("_from", "from", "name", "blockNumber")] == ["_from", "from", "name_eventAttribute", "blockNumber_eventAttribute"]


def test_bogus_abi_falls_back(spark):
    abis = spark.createDataFrame([("0xA", "rhubarb"), ("0xB", '[{"type": "event"}]')], "address string, abi string")
    t = TOPIC["Transfer(address,address,uint256)"]
    logs = spark.createDataFrame([(x, [t, topic("address", A), topic("address", B)], topic("uint256", 5)) for x in ("0xa", "0xb", "0xc")], "address string, topics array<string>, data string")
    assert [r["abi_source"] for r in decoding.decode_events(logs, abis).collect()] == ["ABI_ERC_20"] * 3


def struct_logs(spark, steps, own):
    df = spark.createDataFrame([("t", json.dumps(steps), own)], "hash string, struct_logs string, `to` string")
    return decoding.extract_struct_logs(df).orderBy("event_pos").collect()


def step(op, depth, stack=(), memory=()):
    return {"op": op, "depth": depth, "stack": list(stack), "memory": list(memory)}


def test_struct_logs(spark):
    word = "00" * 31 + "2a"
    steps = [step("CREATE", 1), step("LOG0", 2, ["20", "0"], [word]), step("STOP", 1, ["0" * 24 + "0b" * 20]), step("LOG1", 1, [word, "1", "1f"], [word])]
    got = struct_logs(spark, steps, A)
    assert [(r["event_pos"], r["address"], r["topics"], r["data"], r["error"]) for r in got] == [(1, B, [], "0x" + word, None), (2, A, ["0x" + word], "0x2a", None)]
    bad = struct_logs(spark, [steps[0], step("LOG1", 1, ["0"])], A)
    assert bad[0]["error"].startswith("StructLogError: step 1 ") and bad[0]["data"] is None
    assert [r["address"] for r in struct_logs(spark, steps, None)] == [None, None]


def test_struct_logs_in_nested_frames(spark):
    """A call that opens no frame, a call in a created contract's constructor, and logs after each return."""
    of = lambda d: "0x" + d * 20
    call = lambda d, depth: step("CALL", depth, ["0" * 24 + d * 20, "0x9"])
    log = lambda depth: step("LOG0", depth, ["0x0", "0x0"], [""])
    steps = [log(1), call("01", 1), log(1), step("CREATE2", 1), log(2), call("02", 2), log(3), log(2), step("POP", 1, ["07" * 20]), log(1), call("03", 1), log(2)]
    assert [r["address"] for r in struct_logs(spark, steps, A)] == [A, A, of("07"), of("02"), of("07"), A, of("03")]


def test_struct_logs_of_delegates(spark):
    """A delegate call emits as the frame it was made in, also inside another, in a creation and around a call; or as the callee."""
    of = lambda d: "0x" + d * 20
    opens = lambda op, d, depth: step(op, depth, ["0" * 24 + d * 20, "0x9"])
    log = lambda depth: step("LOG0", depth, ["0x0", "0x0"], [""])
    steps = [opens("DELEGATECALL", "01", 1), log(2), opens("CALLCODE", "02", 2), log(3), opens("CALL", "03", 3), log(4), opens("DELEGATECALL", "04", 4), log(5), log(2)]
    steps += [step("CREATE", 1), opens("DELEGATECALL", "05", 2), log(3), log(2), step("POP", 1, ["06" * 20]), log(1)]
    traces = spark.createDataFrame([("t", json.dumps(steps), A)], "hash string, struct_logs string, `to` string")
    got = lambda **how: [r["address"] for r in decoding.extract_struct_logs(traces, **how).orderBy("event_pos").collect()]
    assert got() == [A, A, of("03"), of("03"), A, of("06"), of("06"), A]
    assert got(delegates_are_callees=True) == [of("01"), of("02"), of("03"), of("04"), of("01"), of("05"), of("06"), A]


def test_struct_logs_of_odd_traces(spark):
    """No steps, depths that jump without an opener, a creation that never returns, an opener at the end, null fields, bad JSON."""
    log = lambda depth: step("LOG0", depth, ["0x0", "0x0"], [""])
    assert struct_logs(spark, [], A) == []
    assert [r["address"] for r in struct_logs(spark, [log(1), log(3), log(1)], A)] == [A, None, A]
    assert [r["address"] for r in struct_logs(spark, [step("CREATE", 2), log(3), log(1)], A)] == [None, None]
    assert [r["address"] for r in struct_logs(spark, [log(1), step("CALL", 1, ["1", "2"])], A)] == [A]
    assert [r["address"] for r in struct_logs(spark, [{"op": None, "depth": 1}, {"depth": None}, log(1)], A)] == [A]
    bad = spark.createDataFrame([("t", "{", A), ("u", None, A)], "hash string, struct_logs string, `to` string")
    assert decoding.extract_struct_logs(bad).count() == 0


def test_many_steps_take_time_in_proportion(spark):
    """100,000 steps with 5,000 logs in 2,500 frames."""
    log, stop = step("LOG0", 2, ["0", "0"], [""]), step("ADD", 1, ["1", "2"])
    steps = []
    for k in range(2500):
        steps += [step("CALL", 1, [f"{k:040x}", "9"]), log, *[step("ADD", 2)] * 30, log, *[stop] * 7]
    assert len(steps) == 100_000
    began = time.time()
    got = struct_logs(spark, steps, A)
    assert time.time() - began < 60
    assert [r["address"] for r in got] == [f"0x{k:040x}" for k in range(2500) for _ in range(2)]


def test_decoded_struct_logs(spark):
    entry = abi._event("Hit", "uint256 indexed n", "uint256 amount")
    n, amount = "00" * 31 + "05", "00" * 31 + "09"
    steps = json.dumps([step("PUSH1", 1), step("LOG2", 1, [n, abi.event_topic(entry)[2:], "20", "0"], [amount]), step("LOG1", 1, ["77" * 32, "0", "0"], [""])])
    traces = spark.createDataFrame([("t", steps, A)], "hash string, struct_logs string, `to` string")
    abis = spark.createDataFrame([(A, json.dumps([entry]))], "address string, abi string")
    got = decoding.decode_struct_logs(traces, abis, allow_undecoded=True).orderBy("event_pos").collect()
    assert [(r["name"], r["params"], r["decoded"]) for r in got] == [("Hit", {"n": "5", "amount": "9"}, True), (None, None, False)]
    with pytest.raises(Exception, match="undecodable"):
        decoding.decode_struct_logs(traces, abis).collect()


def test_indexed_tuples_and_arrays_stay_encoded():
    parts = [{"name": "a", "type": "uint256"}, {"name": "b", "type": "string"}]
    entry = {"name": "Set", "inputs": [{"name": "t", "type": "tuple", "components": parts, "indexed": True}, {"name": "xs", "type": "uint256[1]", "indexed": True}, {"name": "n", "type": "uint256", "indexed": True}]}
    words = ["0x" + c * 64 for c in "ab"] + ["0x" + "0" * 63 + "7"]
    assert abi.decode_log(entry, words, "0x") == [("t", words[0], False), ("xs", words[1], False), ("n", "7", True)]


def test_topics_in_upper_case():
    t = TOPIC["Transfer(address,address,uint256)"]
    upper = ["0X" + x[2:].upper() for x in (t, topic("address", A), topic("address", B))]
    assert decode(upper, topic("uint256", 5)) == decode([t, topic("address", A), topic("address", B)], topic("uint256", 5))


def test_unnamed_and_repeated_inputs():
    entry = {"name": "f", "inputs": [{"name": "", "type": "uint256"}, {"type": "uint256"}, {"name": "x", "type": "uint256"}, {"name": "_x", "type": "uint256"}]}
    data = abi.selector(entry) + abi.encode_values(["uint256"] * 4, [1, 2, 3, 4]).hex()
    assert decoding.decode_one_call(data, json.dumps(entry)) == ("<Function f(uint256,uint256,uint256,uint256)>", {"arg0": "1", "arg1": "2", "x": "3", "x_3": "4"}, True, None)
    event = {"name": "E", "inputs": [{"name": "", "type": "uint256", "indexed": False}, {"name": "", "type": "uint256", "indexed": False}]}
    got = decode(["0x" + "1" * 64], "0x" + abi.encode_values(["uint256"] * 2, [8, 9]).hex(), event)
    assert got[1] == {"arg0": "8", "arg1": "9"}


def test_null_and_broken_data_are_no_crash():
    entry = abi.FALLBACK_ABIS["ABI_ERC_20"][0]
    t = abi.event_topic(entry)
    for data in (None, "0xzz", "0x0"):
        assert not decode([t, topic("address", A), topic("address", B)], data)[3]


def test_sql_functions(spark):
    decoding.register(spark)
    assert spark.sql("SELECT hex(keccak256(CAST('' AS BINARY)))").first()[0].lower().startswith("c5d24601")
