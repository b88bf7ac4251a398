import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainlog.operators import base


def numbers(spark, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = base.hex_to_int(spark.createDataFrame(rows, "i int, gas string"), ["gas", "not_there"])
    return [(r["gas"], r["gas_raw"]) for r in df.orderBy("i").collect()]


def test_valid_hex(spark):
    assert [n for n, _ in numbers(spark, ["0x4A817C800", "0x6B49", "0xABC"])] == [20000000000, 27465, 2748]
    assert [n for n, _ in numbers(spark, ["0x5208", "0x6BCD", "0x7F2"])] == [21000, 27597, 2034]


def test_bad_hex_keeps_its_text(spark):
    assert numbers(spark, ["0x4A817C800", "0xXYZ", "0x7F2"]) == [(20000000000, "0x4A817C800"), (None, "0xXYZ"), (2034, "0x7F2")]


def test_null_and_wide_hex(spark):
    assert numbers(spark, ["0x0", None, "0x", "0x7fffffffffffffff", "0x8000000000000000"]) == [
        (0, "0x0"), (None, None), (None, "0x"), (2**63 - 1, "0x7fffffffffffffff"), (None, "0x8000000000000000"),
    ]


def test_twice_is_once(spark):
    df = spark.createDataFrame([("0x10",)], "gas string")
    once = base.hex_to_int(df, ["gas"])
    assert base.hex_to_int(once, ["gas"]).collect() == once.collect()


@given(st.lists(st.integers(0, 2**256 - 1), min_size=1, max_size=20))
@settings(max_examples=5, deadline=None)
def test_wide_numbers_keep_every_digit(spark, values):
    df = spark.createDataFrame([(i, hex(v)) for i, v in enumerate([0, 2**256 - 1, *values])], "i int, v string")
    got = [int(r[0]) for r in df.orderBy("i").select(base.hex_to_decimal_text(F.col("v"))).collect()]
    assert got == [0, 2**256 - 1, *values]


def test_numbers_around_the_ways_to_read_them(spark):
    values = [f(16**k) for k in (14, 15, 16, 29, 30, 31, 63) for f in (lambda x: x - 1, int, lambda x: x + 1)]
    df = spark.createDataFrame([(i, hex(v)) for i, v in enumerate(values)] + [(99, "0x" + "f" * 65), (100, "0x00001f")], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(base.hex_to_decimal_text(F.col("v"))).collect()]
    assert got == [*map(str, values), None, "31"]


def test_base_transform(spark):
    row = [("1530000000", "0xAB", "0xCD", None, "CALL", hex(2**256 - 1), "0x10", "0xzz")]
    df = spark.createDataFrame(row, "timeStamp string, `to` string, `from` string, address string, type string, value string, gas string, gasUsed string")
    r = base.base_transform(df).first()
    assert (r["to"], r["from"], r["address"], r["calltype"], r["gas"], r["gasUsed"], r["gasUsed_raw"]) == ("0xab", "0xcd", None, "CALL", 16, None, "0xzz")
    assert r["callvalue"] == str(2**256 - 1) and r["callvalue_decimal"] is None and str(r["timeStamp"]) == "2018-06-26 08:00:00"
    with pytest.raises(ValueError, match="address"):
        base.base_transform(df.drop("address"))
