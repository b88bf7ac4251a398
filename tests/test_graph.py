import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from chainlog.operators import graph
from chainlog.operators.components import connected_components
from chainlog.sources import tables
from chainlog.sources.tables import written


def frame(spark, rows, columns="from string, `to` string"):
    return spark.createDataFrame(rows, columns)


def addresses(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "address string")


def closure(spark, edges, seeds, deny=(), **more):
    out = graph.create_closure(frame(spark, edges), addresses(spark, *seeds), addresses(spark, *deny) if deny else None, **more)
    return {r[0] for r in out.collect()}


def bfs(edges, seeds):
    known, todo = set(seeds), list(seeds)
    while todo:
        x = todo.pop()
        for a, b in edges:
            for y in ((b,) if a == x else ()) + ((a,) if b == x else ()):
                if y not in known:
                    known.add(y)
                    todo.append(y)
    return known


EDGES = [("a", "b"), ("b", "a"), ("b", "c"), ("d", "c"), ("d", "e"), ("x", "y")]


def test_closure_and_deny_list(spark):
    assert closure(spark, EDGES, ["a"]) == set("abcde")
    assert closure(spark, EDGES, ["a"], ["c"]) == set("abde")  # reached through a denied one
    assert closure(spark, EDGES, ["a"], ["c"], prune="before") == set("ab")
    assert closure(spark, EDGES, ["alone"]) == {"alone"}


@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), min_size=1, max_size=10), st.sampled_from("abcdefgh"))
@settings(max_examples=5, deadline=None)
def test_closure_is_a_search(spark, edges, seed):
    assert closure(spark, edges, [seed]) == bfs(edges, [seed])


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(20, 21), (21, 20), (30, 30), (None, 4)], "a int, b int")
    got = dict(connected_components(edges, written).collect())
    assert got == {i: 1 for i in range(1, 13)} | {20: 20, 21: 20}


def test_failed_creations_do_not_connect(spark):
    rows = [("CREATE", "0xa", None), ("CREATE2", "0xb", None), ("CREATE", "0xa", "0xc"), ("CALL", "0xa", "0xd")]
    edges = graph.creation_edges(frame(spark, rows, "calltype string, `from` string, `to` string"))
    assert [tuple(r) for r in edges.collect()] == [("0xa", "0xc")]


def test_deny_list(spark):
    zero = "0x0000000000000000000000000000000000000000"
    kept = graph.deny_list(addresses(spark, "0x123...", "0x456...", zero, "0x789..."), addresses(spark, zero, "0xabc...", "0xdef..."))
    assert {r[0] for r in kept.collect()} == {"0x123...", "0x456...", "0x789..."}


def test_labels(spark):
    made = frame(spark, [("f", "m1", 1, 1), ("d", "m2", 1, 2), ("d", "m1", 2, 1), ("n", "m3", 1, 1)], "from string, `to` string, blockNumber long, tracePos int")
    labels = frame(spark, [("f", "MarketFactory"), ("d", "Root")], "key string, value string")
    got = dict(graph.label_by_relative(made, addresses(spark, "f", "d", "n"), labels).collect())
    assert got == {"m1": "Root deployment", "m2": "Root deployment"}
    first = graph.label_by_relative(made.where("blockNumber = 1"), addresses(spark, "f"), labels).collect()
    assert [tuple(r) for r in first] == [("m1", "Marke")]


def test_levels(spark):
    tx = frame(spark, [("t1", "a"), ("t2", "b"), ("t3", "c"), ("t4", "z")], "hash string, contract string")
    made = frame(spark, [("t1", "a", "b"), ("t2", "b", "c")], "hash string, `from` string, `to` string")
    seen, contracts = graph.level_expand(tx, made, addresses(spark, "a"))
    assert dict(seen.collect()) == {"t1": 1, "t2": 2, "t3": 3} and {r[0] for r in contracts.collect()} == set("abc")


def test_a_long_chain_of_creations(spark):
    """More nodes in a row than there were rounds once."""
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(130)], "a string, b string")
    assert {r["component"] for r in connected_components(edges, written).collect()} == {"n000"}


def shuffled_chain(spark, n):
    names = [f"n{i:05}" for i in range(n)]
    random.Random(8).shuffle(names)
    return names, spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")


def counted(rounds):
    def write(df, purpose):
        rounds.append(purpose)
        return written(df, purpose)

    return write


def test_a_chain_of_shuffled_names_takes_few_rounds(spark):
    """10,000 nodes in an order that their names do not tell."""
    _, edges = shuffled_chain(spark, 10_000)
    rounds = []
    got = connected_components(edges, counted(rounds))
    assert rounds.count("hooks") <= 20
    assert got.count() == 10_000 and {r["component"] for r in got.select("component").distinct().collect()} == {"n00000"}


def test_closure_of_a_shuffled_chain(spark):
    names, edges = shuffled_chain(spark, 10_000)
    edges = edges.select(F.col("a").alias("from"), F.col("b").alias("to"))
    assert graph.create_closure(edges, addresses(spark, names[500], "alone")).count() == 10_001
    cut = addresses(spark, names[1000])
    got = {r[0] for r in graph.create_closure(edges, addresses(spark, names[500]), cut, prune="before").collect()}
    assert got == set(names[:1000])


def test_components_against_plain_python(spark):
    """Random graphs with stars, rings, pairs, repeated edges, loops and null ends."""
    rng = random.Random(9)
    edges = [(f"{k}.{rng.randint(0, 12):02}", f"{k}.{rng.randint(0, 12):02}") for k in range(40) for _ in range(rng.randint(1, 14))]
    edges += [("hub", f"leaf{i:03}") for i in range(300)] + [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("p", "q"), ("q", "p"), ("x", "x"), (None, "y"), ("y", None)]
    edges += [("hub", "r3")]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            low, high = sorted((find(a), find(b)))
            top[high] = low
    got = dict(connected_components(frame(spark, edges, "a string, b string"), written).collect())
    assert got == {x: find(x) for x in top}
    assert connected_components(frame(spark, [("x", "x")], "a string, b string"), written).collect() == []


def test_scratch_tables_are_deleted(spark):
    kept = written(spark.range(2), "kept")
    with tables.scratch(spark):
        df = written(spark.range(3), "test")
        path = tables._made[-1]
        assert df.count() == 3
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)
    assert kept.count() == 2
