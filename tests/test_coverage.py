"""Whole pages: ranges of blocks against sets of blocks, and a run over captures with holes."""

import json
import random

import pytest

from chainlog.__main__ import main
from chainlog.operators import coverage
from chainlog.plans.pipeline import IncompleteCapture

from .test_pipeline_stages import ROOT, files  # noqa: F401

RANGE = "contract string, from_block long, to_block long"


def blocks(ranges, contract):
    return {b for c, x, y in ranges if c == contract for b in range(x, y + 1)}


def test_ranges_against_sets_of_blocks(spark):
    rng = random.Random(6)
    some = lambda n, most: [(rng.choice("abcd"), x, x + rng.randint(0, most)) for _ in range(n) for x in [rng.randint(0, 90)]]
    for _ in range(3):
        have, want = some(25, 9), [*some(3, 40), ("e", 5, 7)]
        frame = lambda rows: spark.createDataFrame(rows, RANGE)
        merged = [tuple(r) for r in coverage.merged_ranges(frame(have)).collect()]
        missing = [tuple(r) for r in coverage.missing_ranges(frame(have), frame(want)).collect()]
        for c in "abcde":
            assert blocks(merged, c) == blocks(have, c) and blocks(missing, c) == blocks(want, c) - blocks(have, c)
            for found in (merged, missing):
                own = sorted(r[1:] for r in found if r[0] == c)
                assert all(b[0] > a[1] for a, b in zip(own, own[1:]))
                assert found is missing or all(b[0] > a[1] + 1 for a, b in zip(own, own[1:]))
    assert coverage.missing_ranges(frame([]), frame([("a", 3, 4)])).collect() == [("a", 3, 4)]
    assert coverage.missing_ranges(frame([("a", 0, 9)]), frame([])).collect() == []


def test_a_full_page_covers_what_is_before_its_last_block(spark):
    """Failed pages, pages without a request, a full page of one block, and pages that no one cuts."""
    rows = [("a", 0, 9, True, 3, 5), ("b", 0, 9, True, 4, 5), ("c", 0, 9, False, 0, None), (None, 0, 9, True, 1, 1), ("d", 5, 9, True, 4, 5), ("e", None, 9, True, 1, 1)]
    pages = spark.createDataFrame(rows, RANGE + ", ok boolean, n long, last_block long")
    assert sorted(map(tuple, coverage.covered_ranges(pages, 4).collect())) == [("a", 0, 9), ("b", 0, 4)]
    assert sorted(map(tuple, coverage.covered_ranges(pages, None).collect())) == [("a", 0, 9), ("b", 0, 9), ("d", 5, 9)]


@pytest.mark.parametrize("incomplete", ["warn", "fail"])
def test_a_run_tells_of_missing_blocks(spark, files, tmp_path, incomplete, monkeypatch):  # noqa: F811
    monkeypatch.setattr("chainlog.operators.coverage.PAGE_ROWS", 2)
    captured = tmp_path / "captured"
    captured.mkdir()
    for name in ("traces", "abis", "mappings"):
        (captured / f"{name}.json").write_text(open(f"{files}/{name}.json").read())
    row = lambda h, b: {"hash": h, "blockNumber": str(b), "timeStamp": "1530000000", "contractAddress": ROOT}
    asked = lambda x, y: {"request": {"address": ROOT.upper().replace("X", "x"), "from_block": str(x), "to_block": hex(y)}}
    pages = [asked(0, 3) | {"status": "1", "result": [row("t1", 1)]}, asked(4, 5) | {"status": "0", "message": "NOTOK"}, asked(6, 8) | {"status": "0", "message": "No transactions found", "result": []}]
    (captured / "normal.json").write_text("".join(json.dumps(p) + "\n" for p in pages))
    config = {"contracts": {"dapp": [ROOT]}, "block_range": {"min_block": 0, "max_block": 10}, "misc": {"incomplete": incomplete}}
    (tmp_path / "config.json").write_text(json.dumps(config))
    go = lambda: main([str(tmp_path / "config.json"), str(captured), str(tmp_path / "out")])
    if incomplete == "fail":
        with pytest.raises(IncompleteCapture):
            go()
    else:
        go()
    got = spark.read.parquet(f"{tmp_path}/out/output/extraction/missing_blocks.parquet").where(f"contract = '{ROOT}'")
    assert [tuple(r) for r in got.collect()] == [("normal", ROOT, 4, 5)]
