"""What was last known of an address at a block, against a plain search."""

import random

import pytest

from chainlog.operators.addresses import as_of


@pytest.mark.parametrize("span", [1, 7, 100_000])
def test_against_a_plain_search(spark, span):
    """One address with most captures and lookups, some with none, nulls, repeats, and captures without code."""
    rng = random.Random(span)
    name = lambda: "hot" if rng.random() < 0.6 else rng.choice("abcde")
    states = [(name(), rng.randint(0, 60), rng.choice(["0x", "0x60", "0x61", None])) for _ in range(80)] + [(None, 3, "0x1"), ("a", None, "0x2")]
    lookups = [(name(), rng.randint(0, 70)) for _ in range(60)] * 2 + [("never", 5), (None, 1), ("a", None)]
    columns = "address string, block long"
    got = as_of(spark.createDataFrame(lookups, columns), spark.createDataFrame(states, columns + ", code string"), "code", span)
    want = set()
    for a, b in lookups:
        if a is not None and b is not None:
            at = [(y, c) for x, y, c in states if x == a and y is not None and y <= b]
            block = max((y for y, _ in at), default=None)
            codes = [c for y, c in at if y == block and c is not None]
            want.add((a, b, max(codes) if codes else None, bool(at)))
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_rows_travel_once_and_spread_over_the_session_s_tasks(spark):
    """Captures and lookups are shuffled together, over a number of tasks that small ones are not merged to fewer of."""
    states = spark.createDataFrame([(f"a{i % 9}", i, "0x") for i in range(200)], "address string, block long, code string")
    lookups = states.select("address", (states["block"] + 1).alias("block"))
    df = as_of(lookups, states, "code", 10)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and df.count() == 200  # the same exchange in both branches
    assert "hashpartitioning(address" in plan and df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 1
