import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chainlog.llm import packing as p
from chainlog.llm.queries import TOKENIZERS
from chainlog.llm.tokens import Pieces

BYTES, WORDS = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/word_bpe_49k.json"
ODD = ["", " ", "a", "a b", " a", "a ", "a\n", "\na", "a  b", "a\n\nb", "a \n b", "a\tb c", "don't, stop... now.", "x<|endoftext|>y z", "naïve ÉTÉ straße İstanbul ΣΑΣ", "1,000.50 €", "a b c", "é x", "one.two,three. four,. five.\nSix, seven.", "a\0b c"]


@pytest.mark.parametrize(("path", "dtype"), [(BYTES, "u4"), (WORDS, "u2")])
def test_cached_pieces_give_the_librarys_ids(path, dtype):
    tool = Pieces(path, dtype)
    for text in ODD * 2:
        assert tool.encode(text) == tool.plain(text), text

    @given(st.text(alphabet=st.sampled_from("ab.,' \néßΣ́İZ9-"), max_size=40))
    @settings(max_examples=400, deadline=None)
    def same(text):
        assert tool.encode(text) == tool.plain(text)

    same()


def sequences(examples, limits, cut):
    out = []
    for b in p._batches(iter(examples), limits, cut):
        out += b.to_pylist()
    return out


@given(st.lists(st.integers(1, 3000), min_size=1, max_size=60), st.sampled_from([p.Limits(), p.Limits(256, 3, 200), p.Limits(100, 64, 40)]))
@settings(max_examples=60, deadline=None)
def test_cut_packing_keeps_every_id_once(sizes, limits):
    docs = {i: np.arange(n, dtype="<u4") + 7 * i for i, n in enumerate(sizes)}
    got = sequences([(i, ids, 1) for i, ids in docs.items()], limits, True)
    found = defaultdict(list)
    for s in got:
        ids = np.frombuffer(s["input_ids"], "<u4")
        assert len(ids) == s["n_tokens"] and (len(ids) == limits.tokens or len(ids) & (len(ids) - 1) == 0)
        assert len(s["pieces"]) <= limits.segments and s["n_loss"] <= limits.loss
        at = 0
        for x in s["pieces"]:
            assert x["offset"] == at and x["doc_tokens"] == len(docs[x["doc_id"]])
            found[x["doc_id"]].append((x["start"], ids[at : at + x["length"]]))
            at += x["length"]
        assert at == len(ids)
    for i, ids in docs.items():
        parts = sorted(found[i], key=lambda x: x[0])
        assert np.array_equal(np.concatenate([x for _, x in parts]), ids) and [s for s, _ in parts] == np.cumsum([0, *[len(x) for _, x in parts[:-1]]]).tolist()
    assert len({s["sequence_id"] for s in got}) == len(got)


def test_whole_examples_respect_all_limits():
    rng = random.Random(1)
    limits = p.Limits(512, 4, 150)
    examples = [(i, np.zeros(n := rng.randint(5, 400), "<u4"), n - rng.randint(0, min(n, 150))) for i in range(1500)]
    got = sequences(examples, limits, False)
    assert sorted(x["doc_id"] for s in got for x in s["pieces"]) == list(range(1500))
    assert all(x["length"] == x["doc_tokens"] for s in got for x in s["pieces"])
    assert all(s["n_tokens"] <= 512 and len(s["pieces"]) <= 4 and s["n_loss"] <= 150 for s in got)
    least = max(sum(len(e[1]) for e in examples) / 512, 1500 / 4, sum(min(len(e[1]) - 1, len(e[1]) - e[2]) for e in examples) / 150)
    assert len(got) < 1.1 * least
    with pytest.raises(ValueError, match="exceeds"):
        sequences([(0, np.zeros(600, "<u4"), 1)], limits, False)


def test_documents(spark):
    texts = [None, "", "Hello there, world.", "word " * 5000, "x", "x"]
    df = spark.createDataFrame([(i if i != 4 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, pieces int")
    rows = p.pieces_of(p.pack_documents(df.coalesce(1), BYTES, end_id=0)).collect()
    tool = Pieces(BYTES, "u4")
    for i, t in enumerate(texts):
        ids = tool.plain(t or "") + b"\0\0\0\0"
        own = sorted((r for r in rows if r["doc_id"] == (i if i != 4 else None)), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) // 4
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])


def test_tokenised_examples(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], 2), (2, [4], 0), (3, None, 1), (4, [], 1), (5, list(range(60)), None)], "doc_id long, ids array<int>, first int")
    got = p.pack_examples(df.coalesce(1), loss_from="first", limits=p.Limits(64, 8, 64)).collect()
    assert sorted(x["doc_id"] for s in got for x in s["pieces"]) == [1, 2, 5] and sum(s["n_tokens"] for s in got) == 64


def test_examples_above_a_limit_stand_alone(spark):
    df = spark.createDataFrame([(1, [7] * 100, 90), (2, [8] * 10, 1), (3, [9] * 20, 0)], "doc_id long, ids array<int>, first int")
    got = {tuple(x["doc_id"] for x in s["pieces"]): s["n_tokens"] for s in p.pack_examples(df.coalesce(1), loss_from="first", limits=p.Limits(64, 8, 12)).collect()}
    assert got == {(1,): 100, (3,): 20, (2,): 10}


def first_fit(examples, limits):
    """Sequences that first fit by length needs, longest first, under the same limits."""
    open_: list[list[int]] = []
    for _, ids, first in sorted(examples, key=lambda e: -len(e[1])):
        n = len(ids)
        loss = max(0, n - max(1, first))
        for b in open_:
            if b[0] + n <= limits.tokens and b[1] < limits.segments and b[2] + loss <= limits.loss:
                b[0], b[1], b[2] = b[0] + n, b[1] + 1, b[2] + loss
                break
        else:
            open_.append([n, 1, loss])
    return len(open_)


def test_the_dot_product_needs_fewer_sequences_than_length_alone():
    """Instruction examples of two kinds, long prompts with short answers and the reverse: tokens, segments and loss all bind."""
    rng = random.Random(5)
    limits = p.Limits(1000, 4, 500)
    examples = []
    for i in range(500):
        n = rng.randint(180, 320)
        examples.append((i, np.zeros(n, "<u4"), 1 if i % 2 else n - rng.randint(5, 20)))
    rng.shuffle(examples)
    got = sequences(examples, limits, False)
    assert len(got) < first_fit(examples, limits)
    assert max(s["n_tokens"] for s in got) > 950 and max(len(s["pieces"]) for s in got) == 4 and max(s["n_loss"] for s in got) > 475


def test_rests_of_many_partitions_are_packed_together(spark):
    rng = random.Random(2)
    data = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(5, 900)))) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(40)
    packed = p.pack_documents(df, BYTES, end_id=0)
    rows = packed.collect()
    short = [r for r in rows if r["n_tokens"] < 1024]
    assert len(short) <= 10 and all(r["n_tokens"] & (r["n_tokens"] - 1) == 0 for r in short) and len({r["sequence_id"] for r in rows}) == len(rows)
    tool = Pieces(BYTES, "u4")
    found = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["input_ids"], "<u4")
        for x in r["pieces"]:
            found[x["doc_id"]].append((x["start"], ids[x["offset"] : x["offset"] + x["length"]].tobytes()))
    assert all(b"".join(b for _, b in sorted(found[i])) == tool.plain(t) + b"\0\0\0\0" for i, t in data)
