import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from chainlog.llm import quality
from chainlog.llm.common import written
from chainlog.llm.queries import TOKENIZERS
from chainlog.llm.tokens import Pieces

from .test_near_dups import slow_classes, texts

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    rng = random.Random(1)
    bodies = ["the " + t.replace(" ", " of ", 3) for t in texts(8, groups=40)] + ["short one", None, "", "# $ % " * 20, "the card 4845168114407329 of a man in the house of the king and so on"]
    rows = [(i, t, "en", rng.choice(["a", "b", "c"]), len(t or "")) for i, t in enumerate(bodies)]
    out = [spark.createDataFrame(rows, COLUMNS)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], "unused"), name))
    return out


def test_each_stage_against_brute_force(stages):
    docs, good, single, private, mixed, packed = stages
    judged = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == judged and 0 < len(judged) < docs.count()
    rows = sorted((r["doc_id"], r["text"]) for r in good.collect())
    assert {r["doc_id"] for r in single.collect()} == set(slow_classes(rows)) and single.count() == len(set(slow_classes(rows)))
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in (single, private))
    assert before.keys() == after.keys()
    changed = {i for i in before if before[i]["text"] != after[i]["text"]}
    assert len(changed) == 1 and all("4845168114407329" not in r["text"] for r in after.values())
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= set(after) and max(copies.values()) <= 3
    tool, want = Pieces(f"{TOKENIZERS}/byte_bpe_50k.json", "u4"), Counter()
    for i, k in copies.items():
        want[i] += k * (len(tool.plain(after[i]["text"])) // 4 + 1)
    have = Counter()
    for s in packed.collect():
        assert s["n_tokens"] <= 1024
        for p in s["pieces"]:
            have[p["doc_id"]] += p["length"]
            ids = np.frombuffer(bytes(s["input_ids"]), "<u4")[p["offset"] : p["offset"] + p["length"]].tobytes()
            whole = tool.plain(after[p["doc_id"]]["text"]) + b"\0\0\0\0"
            assert ids == whole[4 * p["start"] : 4 * (p["start"] + p["length"])]
    assert have == want


def test_columns_of_documents_until_the_last(stages):
    for df in stages[:-1]:
        assert df.columns == [c.split()[0] for c in COLUMNS.split(", ")]


def test_empty_documents(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, "unused"), name)
    assert docs.count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
