"""Source divergence audit: how far the sources of each language differ in their words, and by which words.

A language keeps the terms (runs of letters A-Z, lower-cased, and of all non-ASCII characters) that at least `min_docs` of its
documents have. In a group, a language and source, a kept term's share is p = 1 + floor(scale * (n + 1) / (N + V)): n is its
count there, N the sum of n over the kept terms, V their number. The divergence of p from q is the sum over the kept terms of
floor((p - q) ** 2 / q). All arithmetic is in whole numbers.

Terms are counted within tasks, whose tables are emptied at a bounded size, and then by shuffled sums. A language's kept terms
are numbered from 0 and a group's counts packed into a sparse vector for each chunk of terms. The pairs of groups are a matrix,
tiled by blocks of groups: a vector goes to the tiles of its block, and a task takes one tile over a segment of successive
chunks. It holds one chunk of two blocks at a time and sums up the tile's submatrix; terms that neither block has in a segment
need no place, as each group has one share for all of them. The submatrices of segments are summed by a shuffle. So no task
grows with the number of groups, terms or documents, and no row but that of a result has a whole pair.

Null texts, languages and sources are read as empty ones. A group without terms has all its shares by n = 0; a language
without kept terms has divergences of 0; a group without others has no pairs. Repeated rows are documents each; texts are
counted whole; an empty table has no result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import let_workers_import, small_batches
from .common import numbered, written

#: Entries that a task's counts have at most, about, and bytes of a text that are cut into terms at once.
ENTRIES, PART = 200_000, 1 << 20
#: Other bytes than letters and those of non-ASCII characters become spaces.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


@dataclass(frozen=True)
class Audit:
    min_docs: int = 3
    scale: int = 1_000_000_000
    top: int = 200
    #: groups in a block, terms in a chunk, chunks in a segment
    block: int = 64
    chunk: int = 1024
    segment: int = 8


def terms_of(body: bytes) -> Iterator[list[bytes]]:
    """A UTF-8 text's terms, some at a time."""
    body = body.lower().translate(TERM_BYTES)
    at = 0
    while at < len(body):
        end = body.find(b" ", at + PART)
        end = len(body) if end < 0 else end
        yield body[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a partition; a row without term for each group. A key may come more than once."""
    counts: dict[tuple, tuple[Counter, Counter]] = {}

    def out() -> pa.RecordBatch:
        rows = [(*group, None, 0, 0) for group in counts]
        rows += [(*group, t, n, docs[t]) for group, (own, docs) in counts.items() for t, n in own.items()]
        counts.clear()
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            own, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in terms_of(body.as_py()):
                own.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(own) for own, _ in counts.values()) > ENTRIES:
            yield out()
    if counts:
        yield out()


def share(n: Column, total: Column, terms: Column, scale: int) -> Column:
    return F.call_function("div", (n + 1).cast("decimal(19,0)") * F.lit(scale).cast("decimal(19,0)"), (total + terms).cast("decimal(19,0)")) + 1


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame, lang: str, source: str, text: str, audit: Audit) -> tuple[DataFrame, DataFrame]:
    """Tables of the groups (lang, source, place, groups, total, terms, lang_total) and of their kept terms (lang, source, term, n, term_total, at)."""
    let_workers_import(docs.sparkSession)
    small_batches(docs.sparkSession)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(name(lang).alias("lang"), name(source).alias("source"), name(text).cast("binary").alias("text"))
    rows = rows.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    rows = written(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    found = rows.where("term IS NOT NULL")
    every = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("term_total")).where(F.col("docs") >= audit.min_docs)
    every = numbered(every.select("lang", "term", "term_total"), "lang", "term").withColumnRenamed("n", "terms")
    kept = written(found.join(every, ["lang", "term"]).select("lang", "source", "term", "n", "term_total", "at", "terms"), "kept-terms")
    groups = numbered(rows.where("term IS NULL").select("lang", "source"), "lang", "source").withColumnsRenamed({"at": "place", "n": "groups"})
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.max("terms").alias("terms"), F.sum("n").alias("lang_total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    return written(groups, "groups"), kept.drop("terms")


class _Tile:
    """One tile over one segment: the groups of two blocks (low and high, or one block twice), and sums for their pairs."""

    def __init__(self, audit: Audit):
        self.audit = audit
        self.names: list[str] = []
        self.places: list[int] = []
        self.totals: list[int] = []
        self.rest = 0

    def add_group(self, source: str, place: int, total: int, terms: int, rest: int) -> None:
        self.names.append(source)
        self.places.append(place)
        self.totals.append(total)
        self.terms, self.rest = terms, rest

    def begin(self) -> None:
        n = len(self.places)
        self.sums = np.zeros((n, n), np.int64)
        self.row = {p: i for i, p in enumerate(self.places)}
        self.bottom = np.array(self.totals, np.int64) + max(self.terms, 1)
        self.zero = self._share(np.zeros((n, 1), np.int64))
        block = np.array(self.places) // self.audit.block
        #: rows of the low block, and those of the high one that each is paired with
        self.low = np.flatnonzero(block == block.min())
        self.high = np.flatnonzero(block == block.max())

    def _share(self, counts: np.ndarray) -> np.ndarray:
        """By long division, three decimal digits at a time, so that counts may have fifteen digits."""
        rest, out, scale = counts + 1, np.zeros_like(counts), self.audit.scale
        bottom = self.bottom[:, None]
        while scale > 1:
            base = min(1000, scale)
            top = rest * base
            digit = top // bottom
            out, rest = out * base + digit, top - digit * bottom
            scale //= base
        return out + 1

    def add_chunk(self, vectors: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        slots = np.unique(np.concatenate([s for _, s, _ in vectors]))
        counts = np.zeros((len(self.places), len(slots)), np.int64)
        for place, own, n in vectors:
            counts[self.row[place], np.searchsorted(slots, own)] = n
        self._add(self._share(counts), 1)
        self.rest -= len(slots)

    def _add(self, shares: np.ndarray, times: int) -> None:
        high = shares[self.high]
        for i in self.low:
            square = shares[i] - high
            square *= square
            self.sums[i, self.high] += (square // high).sum(axis=1) * times
            if self.low[0] != self.high[0]:
                self.sums[self.high, i] += (square // shares[i]).sum(axis=1) * times

    def pairs(self) -> Iterator[tuple[str, str, int]]:
        self._add(self.zero, self.rest)
        same = self.low[0] == self.high[0]
        for i in self.low:
            for j in self.high:
                if i != j:
                    yield self.names[i], self.names[j], int(self.sums[i, j])
                    if not same:
                        yield self.names[j], self.names[i], int(self.sums[j, i])


TILE = "lang string, low long, high long, segment long, chunk long, place long, source string, total long, terms long, rest long, cells array<struct<slot:int,n:bigint>>"


def _tiles(audit: Audit):
    """Rows of TILE in order of tile, segment and chunk (-1: the groups) to a row (lang, source, other, value) for each pair of a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = chunk = tile = None
        vectors: list = []

        def pairs(lang: str) -> pa.RecordBatch:
            rows = [(lang, *p) for p in tile.pairs()]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, ["lang", "source", "other", "value"])

        def close_chunk() -> None:
            if chunk == -1:
                tile.begin()
            elif vectors:
                tile.add_chunk(vectors)
                vectors.clear()

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "low", "high", "segment"))))
            rows = zip(*(batch.column(c).to_pylist() for c in ("chunk", "place", "source", "total", "terms", "rest")))
            cells = batch.column("cells")
            for i, (key, (c, place, source, total, terms, rest)) in enumerate(zip(keys, rows)):
                if (key, c) != (at, chunk):
                    if at is not None:
                        close_chunk()
                    if key != at:
                        if at is not None:
                            yield pairs(at[0])
                        tile = _Tile(audit)
                    at, chunk = key, c
                if c == -1:
                    tile.add_group(source, place, total, terms, rest)
                else:
                    own = cells[i].values
                    vectors.append((place, own.field("slot").to_numpy(), own.field("n").to_numpy()))
        if at is not None:
            close_chunk()
            yield pairs(at[0])

    return run


def pair_divergences(groups: DataFrame, kept: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """(lang, source, other, value) of every ordered pair of a language's groups."""
    wide = audit.chunk * audit.segment
    cell = F.struct((F.col("at") % audit.chunk).cast("int").alias("slot"), "n")
    packed = kept.groupBy("lang", "source", F.floor(F.col("at") / audit.chunk).alias("chunk")).agg(F.collect_list(cell).alias("cells"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("groups") - 1) / audit.block)))
    mine = F.floor(F.col("place") / audit.block)

    def tiled(rows: DataFrame, *own: Column) -> DataFrame:
        each = rows.where("groups > 1").withColumn("__other", others)
        return each.select("lang", F.least(mine, "__other").alias("low"), F.greatest(mine, "__other").alias("high"), *own)

    segments = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("terms") - 1, F.lit(0)) / wide))
    rest = F.greatest(F.least(F.col("terms") - F.col("segment") * wide, F.lit(wide)), F.lit(0))
    none = F.lit(None).cast("array<struct<slot:int,n:bigint>>")
    heads = tiled(groups.withColumn("segment", F.explode(segments)), F.col("segment"), F.lit(-1).cast("long").alias("chunk"), *map(F.col, ("place", "source", "total", "terms")), rest.alias("rest"), none.alias("cells"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    body = packed.join(groups.select("lang", "source", "place", "groups"), ["lang", "source"])
    body = tiled(body, F.floor(F.col("chunk") / audit.segment).alias("segment"), F.col("chunk"), F.col("place"), null("string", "source"), *[null("long", c) for c in ("total", "terms", "rest")], F.col("cells"))
    keys = ["lang", "low", "high", "segment"]
    rows = heads.unionByName(body).repartition(*keys).sortWithinPartitions(*keys, "chunk", "place")
    found = rows.mapInArrow(_tiles(audit), "lang string, source string, other string, value long")
    return found.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def term_excesses(groups: DataFrame, kept: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """(lang, source, term, value) of the terms that a group has and that have a larger share there than in their language."""
    df = kept.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms"), audit.scale), share(F.col("term_total"), F.col("lang_total"), F.col("terms"), audit.scale)
    df = df.select("lang", "source", F.col("term").cast("string").alias("term"), p.alias("p"), q.alias("q")).where("p > q")
    return df.select("lang", "source", "term", excess(F.col("p"), F.col("q")).alias("value"))


def divergences(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", audit: Audit = Audit()) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has a group's divergence from each other source of its language, part
    `term` its `top` terms. Ranks count from 1 by value, falling, then item."""
    groups, kept = kept_terms(docs, lang, source, text, audit)
    pairs = pair_divergences(groups, kept, audit).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    terms = term_excesses(groups, kept, audit).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).where(F.col("rank") <= audit.top))
