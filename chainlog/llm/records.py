"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

A file is a row of records. A record is its data's length (8 bytes), the masked checksum of those 8 bytes (4 bytes), the
data, and the data's masked checksum (4 bytes), all little-endian. The checksum is CRC-32C, masked by a rotation to the
right by 15 bits and the addition of 0xA282EAD8. The data is a head (1 byte: whether there is an id; 1 byte: bytes of a token
id; 8 bytes: the document's id; 4 bytes: number of token ids) and the token ids.

Each partition of the documents, dealt by ranges of the id, writes one file below the folder through pyarrow's file systems
and returns its rows of the index: file, ordinal, offset, length, tokens before it in the file, tokens. Names are new for each
attempt of a task and only files that the index names count, so a task that is lost or runs twice leaves no trace in the data.

Null texts are empty: their end id alone. Null ids come first, rows of one id by text; an empty table gives an empty index.
Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.workers import let_workers_import, small_batches
from .tokens import encoder

HEAD = "<BBqI"
LENGTH, CHECK = 8, 4
FRAME = LENGTH + 2 * CHECK
BLOCK = 1024
READ_BYTES = 2 << 20
INDEX = "shard long, file string, ordinal long, offset long, length long, doc_id long, start_in_file long, n_tokens long"
POLYNOMIAL = 0x82F63B78


def _step_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables by which a 32-bit state moves over four zero bytes: one for its low half, one for its high half."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
    state = np.concatenate([np.arange(65536, dtype=np.uint32), np.arange(65536, dtype=np.uint32) << 16])
    for _ in range(4):
        state = one[state & 255] ^ (state >> 8)
    return state[:65536], state[65536:]


def _over(tables: tuple[np.ndarray, np.ndarray], state: np.ndarray) -> np.ndarray:
    return tables[0][state & 0xFFFF] ^ tables[1][state >> 16]


def _block_tables() -> tuple[np.ndarray, np.ndarray]:
    """The same over a block of zero bytes."""
    state = np.concatenate([np.arange(65536, dtype=np.uint32), np.arange(65536, dtype=np.uint32) << 16])
    for _ in range(BLOCK // 4):
        state = _over(STEP, state)
    return state[:65536], state[65536:]


STEP = _step_tables()
OVER_BLOCK = _block_tables()


def checksums(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part of at least 4 bytes, worked out for all parts' blocks side by side.

    Parts are padded with zeros in front to whole blocks: from a state of 0 these change nothing. The usual first state of
    all ones equals flipping the first four bytes.
    """
    if not parts:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(p) for p in parts])
    blocks = -(-sizes // BLOCK)
    ends = np.cumsum(blocks) * BLOCK
    data = np.zeros(int(ends[-1]), np.uint8)
    for part, size, end in zip(parts, sizes.tolist(), ends.tolist()):
        data[end - size : end] = np.frombuffer(part, np.uint8)
        data[end - size : end - size + 4] ^= 255
    lanes = np.ascontiguousarray(data.view("<u4").reshape(-1, BLOCK // 4).T)
    state = np.zeros(lanes.shape[1], np.uint32)
    for column in lanes:
        state = _over(STEP, state ^ column)
    order = np.argsort(-blocks, kind="stable")
    firsts, many = (np.cumsum(blocks) - blocks)[order], blocks[order]
    total = np.zeros(len(parts), np.uint32)
    for i in range(int(many[0])):
        n = int(np.searchsorted(-many, -i, side="left"))  # parts with more than i blocks
        total[:n] = _over(OVER_BLOCK, total[:n]) ^ state[firsts[:n] + i]
    out = np.empty_like(total)
    out[order] = total
    return ~out


def masked(parts: list[bytes]) -> np.ndarray:
    crc = checksums(parts)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frames(datas: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(d)) for d in datas]
    return [b"".join((n, struct.pack("<I", a), d, struct.pack("<I", b))) for n, a, d, b in zip(lengths, masked(lengths).tolist(), datas, masked(datas).tolist())]


def unframed(raws: list[bytes], where: str) -> list[bytes]:
    """The records' data, after their lengths and checksums were found right."""
    datas = [r[LENGTH + CHECK : -CHECK] for r in raws]
    lengths = [r[:LENGTH] for r in raws]
    want = [(len(d), a, b) for d, a, b in zip(datas, masked(lengths).tolist(), masked(datas).tolist())]
    have = [(*struct.unpack("<QI", r[: LENGTH + CHECK]), *struct.unpack("<I", r[-CHECK:])) for r in raws]
    if want != have:
        raise ValueError(f"a record of {where} is damaged")
    return datas


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """Of a folder's path or URI; file:/x is as good as file:///x."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[len("file:") :]
    return pa.fs.FileSystem.from_uri(path)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """Writes the files and the index below the path, and returns the index as read back.

    width: bytes of a token id, 2 where the vocabulary has at most 65,536 ids. Documents are dealt by ranges of their id and
    encoded after that, so the shuffle carries texts once and no text is encoded twice.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = f"<u{width}"
        encode, end = encoder(tokenizer, f"u{width}").encode_all, np.array([end_id], kind).tobytes()
        fs, folder = file_system(path)
        context = TaskContext.get()
        shard = context.partitionId() if context else 0
        name = f"part-{shard:08d}-{uuid.uuid4().hex}.records"
        sink, ordinal, offset, tokens = None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                fs.create_dir(f"{folder}/data", recursive=True)
                sink = fs.open_output_stream(f"{folder}/data/{name}")
            at = 0
            bodies = encode(batch.column(1))
            while at < batch.num_rows:  # some MB at a time
                ids, datas, size = [], [], 0
                while at < batch.num_rows and size < READ_BYTES:
                    doc = batch.column(0)[at].as_py()
                    body = next(bodies) + end
                    datas.append(struct.pack(HEAD, doc is not None, width, doc or 0, len(body) // width) + body)
                    ids.append((doc, len(body) // width))
                    size += len(body)
                    at += 1
                rows = []
                for (doc, n), raw in zip(ids, frames(datas)):
                    sink.write(raw)
                    rows.append((shard, name, ordinal, offset, len(raw), doc, tokens, n))
                    ordinal, offset, tokens = ordinal + 1, offset + len(raw), tokens + n
                kinds = (pa.int64(), pa.string(), *[pa.int64()] * 6)
                names = [c.split()[0] for c in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
        if sink is not None:
            sink.close()

    let_workers_import(docs.sparkSession)
    small_batches(docs.sparkSession)
    df = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    df = df.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    df.mapInArrow(run, INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_records(index: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the index's records, read from the files and checked.

    Any part of an index will do, in any order: records are found by their offsets; neighbours in a file are read together.
    start counts the tokens of all documents before; ids are little-endian unsigned 32-bit.
    """
    shards = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = shards.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # a row for each file
    dealt = index.join(first, "file").repartition(max(1, shards.count()), "file")

    def load(fs, folder: str, name: str, rows: list[dict]) -> Iterator[tuple]:
        rows.sort(key=lambda r: r["offset"])
        with fs.open_input_file(f"{folder}/data/{name}") as f:
            at = 0
            while at < len(rows):
                start, to = rows[at]["offset"], at + 1
                while to < len(rows) and rows[to]["offset"] == rows[to - 1]["offset"] + rows[to - 1]["length"] and rows[to]["offset"] - start < READ_BYTES:
                    to += 1
                raw = f.read_at(rows[to - 1]["offset"] + rows[to - 1]["length"] - start, start)
                raws = [raw[r["offset"] - start : r["offset"] - start + r["length"]] for r in rows[at:to]]
                for r, data in zip(rows[at:to], unframed(raws, name)):
                    has, width, doc, n = struct.unpack_from(HEAD, data)
                    ids = np.frombuffer(data, f"<u{width}", n, struct.calcsize(HEAD)).astype("<u4").tobytes()
                    yield doc if has else None, r["first"] + r["start_in_file"], n, zlib.crc32(ids), ids
                at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(path)
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
        for batch in batches:
            files: dict[str, list[dict]] = {}
            for row in batch.to_pylist():
                files.setdefault(row["file"], []).append(row)
            for name, rows in files.items():
                out, size = [], 0
                for row in load(fs, folder, name, rows):
                    out.append(row)
                    size += len(row[-1])
                    if size >= READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds.values())], list(kinds))
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds.values())], list(kinds))

    let_workers_import(index.sparkSession)
    small_batches(index.sparkSession)
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def index_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")
