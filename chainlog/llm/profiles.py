"""Profiles of a corpus's distinct texts: exact document frequencies of their shingles, and consistent weighted samples by TF-IDF.

A shingle's df is the number of documents that have it, copies included. Its idf is

    SMOOTH + (1 - SMOOTH) * ln(1 + n / df) / ln(1 + n),

from 1 for a shingle of one document down to about SMOOTH for one of all. Without smoothing, what a thousand near copies
share would weigh so little beside each one's own edits that they would not be found alike.

How the counts are made, without a row per shingle and without a table of them on any one machine:

1. Each task passes on a text once, compressed, with its number of copies. Texts are dealt to chunks by a hash of the text.
2. A chunk sorts its distinct shingles' hashes (64 bits) and sends each range of hashes to that range's group, as one block.
3. A range's group adds up its counts, some hashes at a time, and answers every chunk with the counts of what that chunk sent, in its order.
4. A chunk meets its answers (a co-group on the shuffle of step 1), weighs its texts and samples them.

Chunks and ranges hold a bounded number of bytes each and grow in number with the corpus. One shuffle of compressed texts and
one of about 6 bytes a shingle do it all. A lost executor's part is made again from the input, with the same chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import written

SMOOTH = 0.5
TEXTS = 256
#: Shingles that are sampled at a time.
DRAWN = 1 << 17
#: Hashes of a range that are counted at a time.
AT_ONCE = 1 << 18
#: Texts that a task remembers at a time, so as not to send them again.
SEEN = 100_000
#: Bits of a sample that a sketch keeps.
SKETCH = np.uint16
_ZSTD = pa.Codec("zstd")


@dataclass(frozen=True)
class Sizes:
    """Characters of text to a chunk and to a range of hashes, at most about; small corpora get smaller ones, for all cores.

    A block has chunk * range / corpus hashes or so. At 100 TB, 64 MB and 512 MB keep it above 50, and want 4 GB a core.
    """

    chunk: int = 8 << 20
    range: int = 12 << 20
    least: int = 256 << 10

    def parts(self, chars: int, most: int, cores: int) -> int:
        return max(1, math.ceil(chars / most), min(4 * cores, math.ceil(chars / self.least)))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def unpacked(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return _ZSTD.decompress(data[8:], size, asbytes=True) if size else b""


def pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned numbers, by planes of bytes, of which the high ones are mostly zero."""
    return packed(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpacked(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def idf(df: np.ndarray, n: int, smooth: float = SMOOTH) -> np.ndarray:
    return smooth + (1 - smooth) * np.log1p(n / df) / np.log1p(n)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(node, doc_id, copies, body) of (doc_id, node, text): a task sends each text once, packed; copies that it meets later come
    as one row without a body. doc_id is the least of those counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}

        def rows(nodes: list, ids: list, copies: list, bodies: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array(ids, pa.int64()), pa.array(copies, pa.int64()), pa.array(bodies, pa.binary())], ["node", "doc_id", "copies", "body"]
            )

        def again() -> pa.RecordBatch:
            more = [(k, x[1], x[0]) for k, x in seen.items() if x[0]]
            seen.clear()
            return rows([m[0] for m in more], [m[1] for m in more], [m[2] for m in more], [None] * len(more))

        for batch in batches:
            texts = batch.column("text")
            fresh = []
            for i, (doc, key) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("node").to_pylist())):
                have = seen.get(key)
                if have is None:
                    seen[key] = [0, None]
                    fresh.append((key, doc, packed((texts[i].as_py() or "").encode())))
                else:
                    have[0] += 1
                    have[1] = doc if have[1] is None else have[1] if doc is None else min(doc, have[1])
            yield rows([f[0] for f in fresh], [f[1] for f in fresh], [1] * len(fresh), [f[2] for f in fresh])
            if len(seen) > SEEN:
                yield again()
        yield again()

    return docs.select("doc_id", "node", "text").mapInArrow(run, "node binary, doc_id long, copies long, body binary")


class _Chunk:
    """A chunk's distinct texts and their shingles."""

    def __init__(self, group: pa.Table):
        found: dict[bytes, list] = {}
        columns = [group.column(c).to_pylist() for c in ("node", "doc_id", "copies", "body")]
        for key, doc, copies, body in zip(*columns):
            row = found.setdefault(key, [None, 0, None])
            row[0] = doc if row[0] is None else row[0] if doc is None else min(doc, row[0])
            row[1] += copies
            row[2] = body if row[2] is None else row[2]
        self.nodes = sorted(found)
        self.ids = [found[k][0] for k in self.nodes]
        self.copies = np.array([found[k][1] for k in self.nodes], np.int64)
        sets = [sh.shingle_sets([unpacked(found[k][2]).decode() for k in self.nodes[a : a + TEXTS]]) for a in range(0, len(self.nodes), TEXTS)]
        self.found, self.times, self.sizes = (np.concatenate([s[i] for s in sets]) for i in range(3))
        self.distinct, self.at = np.unique(self.found, return_inverse=True)


def _bounds(ranges: int) -> np.ndarray:
    return np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)


def profiles(docs: DataFrame, bands: int, rows: int, sizes: Sizes = Sizes()) -> tuple[DataFrame, int]:
    """(node, doc_id, copies, bands, sketch, dfs) of each distinct text of (doc_id, node, text), and the number of documents.

    doc_id is the text's least; bands are hashes of so many rows of samples each, null for a text without a word; the
    sketch holds 16 bits of every sample; dfs the document frequencies of the text's shingles in ascending order of hash.
    """
    n, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n, cores = max(1, n), docs.sparkSession.sparkContext.defaultParallelism
    chunks, ranges = sizes.parts(chars, sizes.chunk, cores), sizes.parts(chars, sizes.range, cores)

    def send(group: pa.Table) -> pa.Table:
        chunk = _Chunk(group)
        counts = np.bincount(chunk.at, np.repeat(chunk.copies, chunk.sizes)).astype(np.int64)
        ends = [0, *np.searchsorted(chunk.distinct, _bounds(ranges)).tolist(), len(chunk.distinct)]
        out = []
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            if a < b:
                out.append((i, pack_numbers(np.diff(chunk.distinct[a:b], prepend=np.uint64(0))), pack_numbers(counts[a:b])))
        number = group.column("chunk")[0].as_py()
        return pa.table([pa.array([number] * len(out), pa.int64()), *[pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))]], ["chunk", "range", "hashes", "counts"])

    def add(group: pa.Table) -> pa.Table:
        blocks = [np.cumsum(unpack_numbers(x), dtype=np.uint64) for x in group.column("hashes").to_pylist()]
        counts = [np.require(unpack_numbers(x), requirements="W") for x in group.column("counts").to_pylist()]
        number = group.column("range")[0].as_py()
        low, width = (number << 64) // ranges, ((number + 1) << 64) // ranges - (number << 64) // ranges
        parts = -(-sum(map(len, blocks)) // AT_ONCE)
        cuts = np.array([low + i * width // parts for i in range(1, parts)], np.uint64)
        places = [[0, *np.searchsorted(b, cuts).tolist(), len(b)] for b in blocks]
        for i in range(parts):
            ends = [slice(x[i], x[i + 1]) for x in places]
            _, at = np.unique(np.concatenate([b[e] for b, e in zip(blocks, ends)]), return_inverse=True)
            df = np.bincount(at, np.concatenate([c[e] for c, e in zip(counts, ends)]).astype(float)).astype(np.uint64)[at]
            for c, e, own in zip(counts, ends, np.split(df, np.cumsum([e.stop - e.start for e in ends])[:-1])):
                c[e] = own
        return pa.table([group.column("chunk"), group.column("range"), pa.array([pack_numbers(c) for c in counts], pa.binary())], ["chunk", "range", "dfs"])

    def sample(texts: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(texts)
        parts = sorted(zip(answers.column("range").to_pylist(), answers.column("dfs").to_pylist()))
        df = np.concatenate([unpack_numbers(x) for _, x in parts] or [np.zeros(0, np.uint64)])[chunk.at]
        weights = chunk.times * idf(df, n)
        sampler = sh.Sampler(bands * rows)
        ends = np.cumsum(chunk.sizes)
        starts = ends - chunk.sizes
        banded: list = [None] * len(chunk.nodes)
        sketch: list = [None] * len(chunk.nodes)
        full = np.flatnonzero(chunk.sizes)
        runs = np.flatnonzero(np.diff(np.cumsum(chunk.sizes[full]) // DRAWN, prepend=-1))  # about DRAWN shingles, or one text, at a time
        for some in np.split(full, runs[1:]) if len(full) else ():
            a, b = starts[some[0]], ends[some[-1]]
            drawn = sampler.samples(chunk.found[a:b], weights[a:b], chunk.sizes[some])
            hashed = np.zeros((len(some), bands), np.uint64)
            for i in range(rows):
                hashed = sh.mixed(hashed + drawn[:, i::rows]) + np.arange(bands, dtype=np.uint64)
            for i, own, short in zip(some.tolist(), hashed.view(np.int64), drawn.astype(SKETCH)):
                banded[i], sketch[i] = own, short.tobytes()
        dfs = [pack_numbers(df[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        columns = [pa.array(chunk.nodes, pa.binary()), pa.array(chunk.ids, pa.int64()), pa.array(chunk.copies), pa.array(banded, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(dfs, pa.binary())]
        return pa.table(columns, ["node", "doc_id", "copies", "bands", "sketch", "dfs"])

    texts = distinct_texts(docs).withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(chunks))).repartition("chunk")
    sent = texts.groupBy("chunk").applyInArrow(send, "chunk long, range long, hashes binary, counts binary")
    answers = sent.groupBy("range").applyInArrow(add, "chunk long, range long, dfs binary")
    made = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(sample, "node binary, doc_id long, copies long, bands array<long>, sketch binary, dfs binary")
    return written(made, "profiles"), n
