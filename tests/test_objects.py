"""Objects with one category, with several and with none."""

from chainlog.operators import ocel

COLUMNS = "timeStamp int, tracePos string, sender string, token int, tokenType_name string"


def objects(spark, rows):
    return ocel.ocel_objects(spark.createDataFrame(rows, COLUMNS))


def test_places_decide_only_between_several_categories(spark):
    rows = [(3, "a", "x", 1, "late"), (2, "b", "x", 1, "second"), (2, "a", "y", 1, "first"), (1, "a", None, 1, None), (1, "a", "x", 2, "own"), (5, "a", "x", 2, "own"), (1, "a", "x", 3, None), (1, "c", "x", None, "none")]
    got = [tuple(r) for r in objects(spark, rows).collect()]
    assert sorted(got, key=str) == sorted([("EOA_x", "EOA", "EOA"), ("EOA_y", "EOA", "EOA"), ("TOKEN_1", "TOKEN", "first"), ("TOKEN_2", "TOKEN", "own"), ("TOKEN_3", "TOKEN", None)], key=str)


def test_no_place_travels_where_each_object_has_one_category(spark):
    df = objects(spark, [(i, str(i), "x", i % 5, f"t{i % 5}") for i in range(50)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 6 and "min_by" not in plan and "Exchange" not in plan
