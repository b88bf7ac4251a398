import json

from hypothesis import given, settings
from hypothesis import strategies as st

from chainlog.operators import trace

LOG = {"topics": ["0x1"]}
MOCK = {
    "name": "CALL_1",
    "calls": [
        {"name": "CALL_1.1"},
        {
            "name": "CALL_1.2",
            "calls": [
                {"name": "CALL_1.2.1"},
                {"name": "CALL_1.2.2"},
                {"name": "CALL_1.2.3", "calls": [{"name": "CALL_1.2.3.1"}, {"name": "CALL_1.2.3.2"}], "logs": [LOG, LOG]},
            ],
        },
        {"name": "CALL_1.3"},
    ],
    "logs": [LOG, LOG],
}
DEPTHS = "1 1.1 1.2 1.2.1 1.2.2 1.2.3 1.2.3.1 1.2.3.2 1.2.3.3 1.2.3.4 1.3 1.4 1.5".split()


def test_positions_of_the_mock():
    nodes = list(trace.walk({"result": MOCK}))
    assert [n[0] for n in nodes] == list(range(1, 14))
    assert [n[1] for n in nodes] == DEPTHS
    assert [n[3] for n in nodes if n[3]] == [1, 2, 1, 2]


def nested():
    leaf = st.fixed_dictionaries({"type": st.just("CALL")})
    logs = st.lists(st.just(LOG), max_size=3)
    return st.recursive(leaf, lambda below: st.fixed_dictionaries({"type": st.just("CALL"), "calls": st.lists(below, max_size=3), "logs": logs}), max_leaves=20)


@given(nested())
@settings(max_examples=60, deadline=None)
def test_walk_is_a_permutation_in_order_of_paths(tree):
    nodes = list(trace.walk(tree))
    text = json.dumps(tree)
    assert len(nodes) == trace.key_count(text, "type") + trace.key_count(text, "topics")
    assert [n[0] for n in nodes] == list(range(1, len(nodes) + 1))
    assert [n[2] for n in nodes] == sorted(n[2] for n in nodes)


def test_deep_chain():
    tree = {"type": "CALL"}
    for _ in range(900):
        tree = {"type": "CALL", "calls": [tree]}
    assert len(list(trace.walk(tree))) == 901


def test_flatten_keeps_columns_and_passes_over_bad_text(spark):
    rows = [("a", 1, json.dumps({"result": MOCK})), ("b", 2, "no json"), ("c", 3, None), ("d", 4, "[1]")]
    df = trace.flatten_traces(spark.createDataFrame(rows, "hash string, n int, trace_json string"))
    got = df.select("hash", "n", "tracePosDepth").collect()
    assert {r["hash"] for r in got} == {"a"} and [r["tracePosDepth"] for r in sorted(got, key=lambda r: r["tracePosDepth"])] == sorted(DEPTHS)


def test_walk_trace_in_sql(spark):
    trace.register(spark)
    spark.createDataFrame([("a", json.dumps(MOCK))], "hash string, trace_json string").createOrReplaceTempView("raw")
    got = spark.sql("SELECT hash, w.tracePosDepth FROM raw, LATERAL walk_trace(trace_json) w").collect()
    assert sorted(r[1] for r in got) == sorted(DEPTHS)
