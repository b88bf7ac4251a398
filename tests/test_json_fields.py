"""JSON objects to columns without declared paths."""

from pyspark.sql import functions as F

from chainlog.operators import enrich


def made(spark, *texts):
    return spark.createDataFrame([(i, "create market", t) for i, t in enumerate(texts)], "market int, Activity string, extraInfo string")


def columns(df):
    return sorted(c for c in df.columns if c.startswith("info_"))


def test_nested_missing_and_mixed_keys(spark):
    """Dotted keys, keys with dots and quotes, empty objects, arrays of objects, nulls, and types that differ."""
    df = enrich.extra_info(made(spark, '{"a":{"b":{"c":1}},"x.y":"dot"}', '{"a":{"b":{"d":null}},"it\'s":true,"both\'\\"":1}', '{"e":{},"l":[{"z":1}]}', '{"a":5}', None, "[1]"))
    got = {r["market"]: r.asDict() for r in df.collect()}
    assert set(columns(df)) >= {"info_a", "info_x.y", "info_it's", "info_l"}
    assert got[3]["info_a"] == "5" and got[0]["info_x.y"] == "dot" and got[1]["info_it's"] == "true" and got[2]["info_l"] == '[{"z":1}]'
    assert got[0]["info_a"] == '{"b":{"c":1}}' and got[4]["info_a"] is None and not got[4]["extra_info_broken"]


def test_names_and_broken_texts(spark):
    df = enrich.extra_info(made(spark, '{"a":{"b":1},"A":{"b":2},"d":"cut', '{"a":{"c":"y"}}', "{"))
    got = {r["market"]: r.asDict() for r in df.collect()}
    assert columns(df) == ["info_A.b", "info_a.b_2", "info_a.c", "info_d"]
    assert got[0]["info_A.b"] == "2" and got[0]["info_a.b_2"] == "1" and got[0]["info_d"] == "cut" and got[1]["info_a.c"] == "y"
    assert got[2]["extra_info_broken"] and not got[0]["extra_info_broken"]


def test_no_objects_give_no_columns(spark):
    for texts in ([], ["5"], [None], ["{}"]):
        df = enrich.extra_info(made(spark, *texts))
        assert df.columns == ["market", "extra_info_broken"] and df.count() == len(texts)
    assert enrich.json_fields(F.parse_json(F.lit("[]")), spark.range(1)) == {}
