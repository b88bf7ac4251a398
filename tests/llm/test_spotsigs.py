import hashlib
import random
import re

import pytest

from chainlog.llm import spotsigs as s
from chainlog.llm.common import STOP_WORDS


def slow_signatures(text):
    tokens = [t for t in re.split(r"[\W_]+", text.lower()) if t]
    out = set()
    for i, t in enumerate(tokens):
        if t in STOP_WORDS:
            chain = [x for x in tokens[i + 1 :] if x not in STOP_WORDS][: s.CHAIN]
            if len(chain) == s.CHAIN:
                out.add(hashlib.md5(" ".join([t, *chain]).encode()).hexdigest()[:8])
    return sorted(out) or [hashlib.md5(text.encode()).hexdigest()[:8]]


def jaccard(a, b):
    return len({*a} & {*b}) / len({*a} | {*b})


TEXTS = [None, "", "of the", "The cat and the dog of a house.", "cat dog", "of the cat", "Der Hund und die Katze, in dem Haus! der Hund", "a b the c", "the " * 50 + "end of it", "naïve café the été of"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, spots string")


def check(spark, ids, texts):
    order = sorted(zip(ids, texts), key=lambda x: -x[0])
    rows = {r["doc_id"]: r for r in s.fingerprints(frame(spark, [(i, t, "clash") for i, t in zip(ids, texts)])).collect()}
    assert len(rows) == len(ids)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after, r = t or "", after or "", rows[i]
        half = len(t) // 2
        assert r["edited_text"] == t[: len(t) - half] + after[:half]
        assert [list(r[c]) for c in ("spots", "edited_spots", "next_spots")] == [slow_signatures(x) for x in (t, r["edited_text"], after)]


def test_against_plain_python(spark):
    check(spark, [5, -3, 900, 2**40, 7, 8, 0, 11, 12, 13], TEXTS)
    check(spark, [4], ["alone of the house cat"])


@pytest.mark.parametrize("rows", [3, 40])
def test_successors_across_buckets(spark, rows):
    rng = random.Random(rows)
    ids = rng.sample(range(-(10**6), 10**6), 300) + [10**15 + i for i in range(60)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next"]["doc_id"] for r in s.with_next(df, "doc_id", bucket_rows=rows).collect()}
    order = sorted(ids, reverse=True)
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_null_ids_and_repeated_rows(spark):
    rows = [(1, "b of the x y"), (1, "a of the x y"), (None, "n"), (None, None), (2, "c"), (2, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = s.fingerprints(df)
    assert got.count() == len(rows)


def test_near_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfghk") for _ in range(4))
    base = [" ".join(rng.choice(["the", "of", word()]) for _ in range(200)) for _ in range(6)]
    texts = {i: b for i, b in enumerate(base)} | {10 + i: b.rsplit(" ", 3)[0] + " the end of all" for i, b in enumerate(base)} | {20: base[0], 30: None}
    sets = {i: slow_signatures(t or "") for i, t in texts.items()}
    got = {(r["a"], r["b"]) for r in s.near_pairs(frame(spark, [(i, t, None) for i, t in texts.items()])).collect()}
    want = {(a, b) for a in sets for b in sets if a < b < 20 and jaccard(sets[a], sets[b]) >= s.THRESHOLD}
    assert got == want and len(want) == 6
