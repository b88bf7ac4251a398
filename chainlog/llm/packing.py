"""Packing by vector bin packing: examples are placed into sequences under limits on tokens, segments and loss-bearing tokens
at once, by dot products of demands with what sequences have left, each dimension as a share of its limit.

With cutting allowed, a sequence takes the example whose demand has the largest product with its room until none fits, and
what is left is filled with the head of the largest one, whose rest stays to be placed. Without cutting, examples stay whole:
the largest goes first, into the one of at most OPEN sequences along whose room its demand points best; where all are too
full, the fullest ends early.

Each partition is packed for itself, without a shuffle, from a pool of at most POOL examples (with cutting, of less than one
sequence each). What documents leave over at a partition's end, less than a sequence, is packed once more with that of
TAILS other partitions; what that leaves over in turn is written as sequences of lengths that are powers of two. So no token
is padding. A sequence's id is its partition's number and its own within it; a partition that is computed again gives the
same rows, as long as its input comes in the same order, and whole rows only.

Null and empty texts are documents of their end id alone; null and empty examples have no token and so no piece; an example
that exceeds a limit by itself and may not be cut is a sequence of its own, whose n_tokens or n_loss show it; null ids stay
null; repeated rows are packed each; an empty table gives an empty one. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workers import let_workers_import, small_batches
from .common import written
from .tokens import encoder

POOL = 512
#: Sequences that whole examples may still join.
OPEN = 256
ROWS_OUT = 256
FREE = 1 << 40
#: Partitions whose rests are packed together, and from where the ids of the sequences count that these make.
TAILS, SECOND = 512, 1 << 62

SCHEMA = (
    "sequence_id long, input_ids binary, n_tokens int, n_loss int, "
    "pieces array<struct<doc_id:long,start:long,length:long,offset:long,doc_tokens:long>>"
)


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


class Packer:
    """Packs examples (id, ids, first loss-bearing position) as they come; yields (bytes, loss, pieces) of each sequence."""

    def __init__(self, limits: Limits, cut: bool, last: bool = True, alone: bool = False):
        self.limits, self.cut, self.last, self.alone = limits, cut, last, alone
        self.items: list[list | None] = [None] * POOL  # [doc, ids, start, total, loss_from]
        self.tokens, self.loss = np.full(POOL, FREE), np.full(POOL, FREE)  # each has one segment; FREE fits nowhere
        self.free = list(range(POOL))

    def _demand(self, item: list) -> tuple[int, int, int]:
        """A segment's first token has nothing before it to be told from, so it never bears loss."""
        _, ids, start, _, loss_from = item
        return len(ids), 1, max(0, start + len(ids) - max(start + 1, loss_from))

    def _put(self, item: list) -> None:
        slot = self.free.pop()
        self.items[slot] = item
        self.tokens[slot], _, self.loss[slot] = self._demand(item)

    def add(self, doc, ids: np.ndarray, loss_from: int) -> Iterator[list[list]]:
        total, size = len(ids), self.limits.tokens
        start = 0
        if self.cut:
            step = min(size, self.limits.loss + 1)
            while total - start >= size and step == size:
                yield [[doc, ids[start : start + size], start, total, loss_from]]
                start += size
            while total - start > step:
                yield from self._add_one([doc, ids[start : start + step], start, total, loss_from])
                start += step
        if start < total:
            yield from self._add_one([doc, ids[start:], start, total, loss_from])

    def add_part(self, doc, ids: np.ndarray, loss_from: int, start: int, total: int) -> Iterator[list[list]]:
        """A piece of an example, smaller than a sequence."""
        yield from self._add_one([doc, ids, start, total, loss_from])

    def _add_one(self, item: list) -> Iterator[list[list]]:
        if any(x > y for x, y in zip(self._demand(item), (self.limits.tokens, self.limits.segments, self.limits.loss))):
            if not self.alone:
                raise ValueError(f"example {item[0]} exceeds the limits by itself")
            yield [item]
            return
        if not self.free:
            yield self._fill()
        self._put(item)

    def _fill(self) -> list[list]:
        """The next sequence's items."""
        cap = self.limits
        tokens, segments, loss = cap.tokens, cap.segments, cap.loss
        out = []
        while segments:
            score = self.tokens * (tokens / cap.tokens**2) + self.loss * (loss / cap.loss**2)  # the segment's part is the same for all
            score[(self.tokens > tokens) | (self.loss > loss)] = -1
            slot = int(score.argmax())
            if score[slot] < 0:
                break
            out.append(self.items[slot])
            tokens, segments, loss = tokens - int(self.tokens[slot]), segments - 1, loss - int(self.loss[slot])
            self.items[slot] = None
            self.tokens[slot] = self.loss[slot] = FREE
            self.free.append(slot)
        gap = min(tokens, loss + 1)
        if self.cut and gap > 0 and segments and len(self.free) < POOL:
            slot = int(np.where(self.tokens == FREE, -1, self.tokens).argmax())
            doc, ids, start, total, loss_from = self.items[slot]
            out.append([doc, ids[:gap], start, total, loss_from])
            self.items[slot] = [doc, ids[gap:], start + gap, total, loss_from]
            self.tokens[slot], _, self.loss[slot] = self._demand(self.items[slot])
        return out

    def rest(self) -> Iterator[list[list]]:
        while len(self.free) < POOL:
            yield self._fill()

    def lengths(self, total: int) -> list[int]:
        """The whole, or where nothing comes after this, powers of two that sum to it."""
        if not self.cut or not self.last or total >= self.limits.tokens:
            return [total]
        return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]

    def rows(self, filled: list[list]) -> Iterator[tuple[bytes, int, list[tuple]]]:
        filled = list(filled)
        for size in self.lengths(sum(len(x[1]) for x in filled)):
            ids, pieces, loss, at = [], [], 0, 0
            while at < size:
                doc, have, start, total, loss_from = filled.pop(0)
                if len(have) > size - at:
                    filled.insert(0, [doc, have[size - at :], start + size - at, total, loss_from])
                    have = have[: size - at]
                ids.append(have.tobytes())
                pieces.append((doc, start, len(have), at, total))
                loss += self._demand([doc, have, start, total, loss_from])[2]
                at += len(have)
            yield b"".join(ids), loss, pieces


class Placer:
    """Places whole examples: a pool's by the largest demand first, each into the open sequence whose room it points along best,
    which is the dot product of its demand with the room over the room's length, in shares of the limits."""

    def __init__(self, limits: Limits, alone: bool = False):
        self.limits = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.alone = alone
        self.pool: list[tuple[list, np.ndarray]] = []
        self.open: list[list[list]] = []
        self.room = np.zeros((0, 3))

    def add(self, doc, ids: np.ndarray, loss_from: int) -> Iterator[list[list]]:
        n = len(ids)
        if not n:
            return
        item, demand = [doc, ids, 0, n, loss_from], np.array([n, 1, max(0, n - max(1, loss_from))]) / self.limits
        if (demand > 1).any():
            if not self.alone:
                raise ValueError(f"example {doc} exceeds the limits by itself")
            yield [item]
            return
        self.pool.append((item, demand))
        if len(self.pool) == POOL:
            yield from self._place()

    def _place(self) -> Iterator[list[list]]:
        for item, demand in sorted(self.pool, key=lambda x: -x[1].sum()):
            fits = (self.room >= demand - 1e-12).all(axis=1)
            if fits.any():
                along = np.where(fits, self.room @ demand / np.maximum(np.linalg.norm(self.room, axis=1), 1e-12), -1)
                at = int(along.argmax())
            else:
                if len(self.open) == OPEN:
                    yield self._close(int(self.room.sum(axis=1).argmin()))
                at = len(self.open)
                self.open.append([])
                self.room = np.vstack([self.room, np.ones(3)])
            self.open[at].append(item)
            self.room[at] -= demand
            if (self.room[at, :2] < 1 / self.limits[:2] - 1e-12).any():  # no token or segment is left
                yield self._close(at)
        self.pool.clear()

    def _close(self, at: int) -> list[list]:
        self.room = np.delete(self.room, at, axis=0)
        return self.open.pop(at)

    def rest(self) -> Iterator[list[list]]:
        yield from self._place()
        while self.open:
            yield self._close(0)

    def rows(self, filled: list[list]) -> Iterator[tuple[bytes, int, list[tuple]]]:
        ends = np.cumsum([len(x[1]) for x in filled]).tolist()
        pieces = [(doc, 0, n, end - n, n) for (doc, _, _, n, _), end in zip(filled, ends)]
        yield b"".join(x[1].tobytes() for x in filled), sum(max(0, n - max(1, first)) for _, _, _, n, first in filled), pieces


PIECE = ("doc_id", "start", "length", "offset", "doc_tokens")


def _pieces(rows: list[list[tuple]]) -> pa.Array:
    flat = list(zip(*(p for r in rows for p in r)))
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in flat], list(PIECE)))


def _batches(examples: Iterator[tuple], limits: Limits, cut: bool, last: bool = True, alone: bool = False, first_id: int = 0) -> Iterator[pa.RecordBatch]:
    """examples: (doc, ids, first loss-bearing position, start, total), or without the last two if whole."""
    packer, rows = Packer(limits, cut, last, alone) if cut else Placer(limits, alone), []
    context = TaskContext.get()
    number = first_id + ((context.partitionId() if context else 0) << 36)

    def out() -> pa.RecordBatch:
        nonlocal number
        ids = [number + i for i in range(len(rows))]
        number += len(rows)
        data = [(ids, pa.int64()), ([r[0] for r in rows], pa.binary()), ([len(r[0]) // 4 for r in rows], pa.int32()), ([r[1] for r in rows], pa.int32())]
        columns = [*[pa.array(x, t) for x, t in data], _pieces([r[2] for r in rows])]
        batch = pa.RecordBatch.from_arrays(columns, ["sequence_id", "input_ids", "n_tokens", "n_loss", "pieces"])
        rows.clear()
        return batch

    def sequences() -> Iterator[list[list]]:
        for doc, ids, loss_from, *part in examples:
            yield from packer.add_part(doc, ids, loss_from, *part) if part else packer.add(doc, ids, loss_from)
        yield from packer.rest()

    for filled in sequences():
        rows.extend(packer.rows(filled))
        if len(rows) >= ROWS_OUT:
            yield out()
    if rows:
        yield out()


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Sequences of whole texts' ids, each text followed by end_id, cut freely. tokenizer: the vocabulary's file on the workers.

    input_ids holds little-endian unsigned 32-bit ids; pieces says which document's ids lie where, without gaps. The
    sequences of the first pass are a table in the shared folder, from which only those that are not full are packed again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, "u4").encode_all, np.array([end_id], "<u4").tobytes()

        def examples() -> Iterator[tuple]:
            for batch in batches:
                for doc, body in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                    yield doc, np.frombuffer(body + end, "<u4"), 1

        yield from _batches(examples(), limits, cut=True, last=False)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for batch in batches:
                for body, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = np.frombuffer(body, "<u4")
                    for p in pieces:
                        yield p["doc_id"], ids[p["offset"] : p["offset"] + p["length"]], 1, p["start"], p["doc_tokens"]

        yield from _batches(parts(), limits, cut=True, first_id=SECOND)

    let_workers_import(docs.sparkSession)
    small_batches(docs.sparkSession)
    first = written(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA), "sequences")
    full = F.col("n_tokens") >= limits.tokens
    rests = first.where(~full)
    groups = max(1, -(-rests.count() // TAILS))
    packed = rests.select("input_ids", "pieces", "sequence_id").repartitionByRange(groups, "sequence_id").sortWithinPartitions("sequence_id").select("input_ids", "pieces").mapInArrow(again, SCHEMA)
    return first.where(full).unionByName(packed)


def pack_examples(examples: DataFrame, key: str = "doc_id", ids: str = "ids", loss_from: str | None = None, limits: Limits = Limits(), cut: bool = False) -> DataFrame:
    """Sequences of tokenised examples: ids is an array of integers; loss_from a column with the first position that bears loss."""
    first = F.lit(1) if loss_from is None else F.coalesce(F.col(loss_from), F.lit(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, body, start in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    if body.is_valid and len(body.values):
                        yield doc, body.values.to_numpy(zero_copy_only=False).astype("<u4"), start

        yield from _batches(rows(), limits, cut, alone=True)

    let_workers_import(examples.sparkSession)
    small_batches(examples.sparkSession)
    return examples.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"), first.cast("int").alias("first")).mapInArrow(run, SCHEMA)


def pieces_of(sequences: DataFrame) -> DataFrame:
    """A row for each piece, with the checksum of its ids as read from its sequence."""
    df = sequences.select("sequence_id", "n_tokens", "input_ids", F.explode("pieces").alias("p"))
    part = F.substring(df["input_ids"], (df["p.offset"] * 4 + 1).cast("int"), (df["p.length"] * 4).cast("int"))
    return df.select("p.doc_id", "p.start", "p.length", F.crc32(part).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset", F.col("n_tokens").alias("sequence_tokens"))
