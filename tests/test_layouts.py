"""The compiled projections against the row-wise decoder, over many types, values and kinds of damage."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chainlog.functions import abi, decoding, layouts

ELEMENTS = ["uint256", "uint8", "uint", "int256", "int16", "int", "address", "bool", "bytes32", "bytes4", "function"]
SHAPES = ["bytes", "string", "uint256[]", "int32[]", "bool[2]", "address[]", "bytes3[2][]", "uint16[0]", "uint256[2][2]"]
TUPLES = [
    {"type": "tuple", "components": [{"name": "a", "type": "uint256"}, {"name": "b", "type": "bool[2]"}]},
    {"type": "tuple[]", "components": [{"name": "a", "type": "address"}, {"name": "b", "type": "int8"}]},
    {"type": "tuple[2]", "components": [{"name": "a", "type": "bytes5"}]},
]
REFUSED = [{"type": "string[]"}, {"type": "uint256[][]"}, {"type": "tuple", "components": [{"name": "s", "type": "string"}]}, {"type": "uint7"}]


def value(kind, rng):
    if a := abi._array(kind):
        return [value(a[0], rng) for _ in range(a[1] if a[1] is not None else rng.randint(0, 3))]
    if kind.startswith("("):
        return tuple(value(k, rng) for k in abi._split(kind[1:-1]))
    if kind == "bytes":
        return rng.randbytes(rng.choice([0, 1, 31, 32, 33, 100]))
    if kind == "string":
        return "".join(rng.choice("aÄ日😀\x00 \"") for _ in range(rng.choice([0, 3, 40])))
    if kind == "address":
        return "0x" + rng.randbytes(20).hex()
    if kind == "bool":
        return rng.random() < 0.5
    if kind == "function":
        return rng.randbytes(24)
    if kind.startswith("bytes"):
        return rng.randbytes(int(kind[5:]))
    bits = int(kind.lstrip("uint") or 256)
    n = rng.getrandbits(rng.choice([1, bits // 2, bits]))
    return n if kind.startswith("u") else (n >> 1) - (1 << (bits - 1)) * rng.randint(0, 1)


def damaged(data, rng):
    """The data, or what is left of them, with bytes changed, no bytes or text that is no hex."""
    way = rng.randint(0, 11)
    if way < 5:
        return data
    if way == 5:
        return data[: rng.randint(0, len(data))]
    if way == 6:
        return rng.choice(["0x", "0X", "", None, "0xzz", "0x0", "xyz", data.upper()])
    body = bytearray.fromhex(data[2:])
    for _ in range(1 if way < 10 else 8):
        if body:
            body[rng.randrange(len(body))] = rng.choice([0, 1, 32, 255])
    return "0x" + body.hex()


def entry_of(i, rng, refused):
    pick = lambda: dict(rng.choice([{"type": rng.choice(ELEMENTS)}, {"type": rng.choice(SHAPES)}, rng.choice(TUPLES)]))
    inputs = [pick() | {"name": rng.choice(["", "x", "to", "_from", "hash", "name"]), "indexed": rng.random() < 0.35} for _ in range(rng.randint(0, 5))]
    if refused:
        inputs.append(dict(rng.choice(REFUSED)) | {"name": "odd", "indexed": False})
    return {"name": f"E{i}", "inputs": inputs}


def encoded(inputs, rng):
    kinds = [abi.type_of(p) for p in inputs]
    if any(p["type"] == "uint7" for p in inputs):
        kinds = ["uint8" if k == "uint7" else k for k in kinds]
    return abi.encode_values(kinds, [value(k, rng) for k in kinds]).hex()


def shown(rows):
    return sorted((str(tuple(sorted(x.items()) if isinstance(x, dict) else x for x in r)) for r in rows))


@pytest.mark.parametrize("refused", [False, True])
def test_events(spark, refused):
    """All columns of the result, the errors' texts too."""
    rng = random.Random(1 + refused)
    entries = [entry_of(i, rng, refused and i % 2 == 0) | {"type": "event"} for i in range(40)] + [dict(e) for e in abi.FALLBACK_ABIS["ABI_ERC_20"]]
    logs = []
    for i in range(600):
        e = rng.choice(entries)
        indexed = [p for p in e["inputs"] if p["indexed"]]
        body = [p for p in e["inputs"] if not p["indexed"]]
        topics = [abi.event_topic(e)]
        if rng.random() < 0.8:
            topics += ["0x" + (abi.encode_values([abi.type_of(p)], [value(abi.type_of(p), rng)]).hex() if abi.in_topic(abi.type_of(p)) else rng.randbytes(32).hex()) for p in indexed]
        else:
            body = e["inputs"]
        if rng.random() < 0.1:
            topics[rng.randrange(len(topics))] = rng.choice(["0x" + "0" * 63 + "2", "0x12", "0xzz", None, topics[0]])
        topics = rng.choice([None, []]) if rng.random() < 0.05 else topics
        logs.append((i, rng.choice(["0xA", "0xa", "0xB"]), topics, damaged("0x" + encoded(body, rng), rng)))
    abis = spark.createDataFrame([("0xA", json.dumps(entries))], "address string, abi string")
    df = spark.createDataFrame(logs, "i int, address string, topics array<string>, data string")
    got = decoding.decode_events(df, abis)
    own = abi.topic_map(entries)
    want = []
    for i, address, topics, data in logs:
        e = own.get((topics[0] or "").lower()) if topics and address.lower() == "0xa" else None
        want.append((i, address, topics, data, *decoding.decode_one_log(topics, data, json.dumps(e) if e else None)))
    rows = [tuple(r) for r in got.collect()]
    assert shown(rows) == shown(want)
    assert 0.2 < sum(r[7] for r in rows) / len(rows) < 0.9
    assert ("Python" in got._jdf.queryExecution().toString()) == refused


@pytest.mark.parametrize("refused", [False, True])
def test_functions(spark, refused):
    rng = random.Random(3 + refused)
    entries = [entry_of(i, rng, refused and i % 2 == 0) | {"type": "function"} for i in range(40)]
    calls = [(i, rng.choice(["0xA", "0xb"]), damaged(abi.selector(e) + encoded(e["inputs"], rng), rng)) for i in range(500) for e in [rng.choice(entries)]]
    abis = spark.createDataFrame([("0xA", json.dumps(entries)), ("0xC", "rhubarb")], "address string, abi string")
    got = decoding.decode_functions(spark.createDataFrame(calls, "i int, `to` string, input string"), abis)
    own = abi.selector_map(entries)
    entry = lambda to, data: json.dumps(own[data[:10].lower()]) if to == "0xA" and data and data[:10].lower() in own else None
    want = [(i, to, data, *decoding.decode_one_call(data, entry(to, data))) for i, to, data in calls]
    assert shown(tuple(r) for r in got.collect()) == shown(want)
    assert ("Python" in got._jdf.queryExecution().toString()) == refused


def test_large_rows_of_words_are_refused():
    """An array of so many words that its layout would be larger than its entry; dynamic arrays have their item's words only."""
    names = lambda n: n
    made = lambda kind: layouts.layout({"name": "f", "inputs": [{"name": "x", "type": kind}]}, "s", "function", names)
    assert made("uint256[65]")["entry"] and made("uint256[4][20][]")["entry"]
    assert len(made("uint256[64]")["args"][0]["leaves"]) == 64 and len(made("uint256[]")["args"][0]["leaves"]) == 1


def test_a_compiled_table_serves_many_decodings(spark):
    entries = [abi._event("Hit", "uint256 indexed n", "bytes body")]
    table = decoding.compiled_abis(spark.createDataFrame([("0xA", json.dumps(entries))], "address string, abi string"), "event")
    assert table.columns == ["abi_address", "abi_key", "layout"] and decoding.compiled_abis(table, "event") is table
    topics = [abi.event_topic(entries[0]), "0x" + "0" * 63 + "7"]
    logs = spark.createDataFrame([("0xA", topics, "0x" + abi.encode_values(["bytes"], [b"\1\2"]).hex())], "address string, topics array<string>, data string")
    for extra in ("layout", "__x"):
        df = decoding.decode_events(logs.withColumn(extra, F.lit(1)).drop("layout"), table)
        assert df.first().params == {"n": "7", "body": "0x0102"}
