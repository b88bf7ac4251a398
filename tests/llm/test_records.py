import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainlog.llm import records as r
from chainlog.llm.common import shared_dir
from chainlog.llm.queries import TOKENIZERS
from chainlog.llm.tokens import Pieces

WORDS = f"{TOKENIZERS}/word_bpe_49k.json"


def slow_crc(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


@given(st.lists(st.binary(min_size=4, max_size=3000), max_size=8))
@settings(max_examples=25, deadline=None)
def test_checksums(parts):
    assert r.checksums(parts).tolist() == [slow_crc(p) for p in parts]


def test_known_checksum():
    assert r.checksums([b"123456789"]).tolist() == [0xE3069283]


def test_frames_find_damage():
    raw = r.frames([b"some data", b"more"])
    assert r.unframed(raw, "here") == [b"some data", b"more"]
    assert struct.unpack("<Q", raw[0][:8]) == (9,)
    for at in range(len(raw[0])):
        bad = bytearray(raw[0])
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            r.unframed([bytes(bad)], "here")


def documents(spark):
    texts = ["plain words here", None, "", "long " * 30_000, "x", "same", "same"]
    ids = [5, 3, None, -7, 10**12, 8, 8]
    return spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts)], "doc_id long, text string, start string"), list(zip(ids, texts))


def test_round_trip(spark):
    df, rows = documents(spark)
    path = shared_dir(spark, "records")
    index = r.write_records(df, path, WORDS, end_id=2)
    got = {(x["start"], x["doc_id"]): x for x in r.read_records(index, path).collect()}
    tool, at = Pieces(WORDS, "u2"), 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.frombuffer(tool.plain(t or ""), "<u2").astype("<u4").tolist() + [2]
        x = got.pop((at, i))
        assert np.frombuffer(bytes(x["ids"]), "<u4").tolist() == ids and x["n_tokens"] == len(ids) and x["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert not got


def test_shuffled_reads_of_a_part(spark):
    df, _ = documents(spark)
    path = shared_dir(spark, "records")
    r.write_records(df, path, WORDS, end_id=2)
    part = r.index_of(spark, path).where("doc_id IN (5, 8)").orderBy(F.desc("offset"))
    assert sorted(x["doc_id"] for x in r.read_records(part, path).collect()) == [5, 8, 8]


def test_damage_is_found_when_read(spark):
    df, _ = documents(spark)
    path = shared_dir(spark, "records")
    index = r.write_records(df.coalesce(1), path, WORDS, end_id=2)
    fs, folder = r.file_system(path)
    name = index.first()["file"]
    with fs.open_input_stream(f"{folder}/data/{name}") as f:
        raw = bytearray(f.read())
    raw[-6] ^= 1
    with fs.open_output_stream(f"{folder}/data/{name}") as f:
        f.write(bytes(raw))
    with pytest.raises(Exception, match="damaged"):
        r.read_records(index.where(F.col("file") == name), path).collect()
