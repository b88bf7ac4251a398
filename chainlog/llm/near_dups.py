"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles of five words.

1. Every distinct text gets BANDS hashes of ROWS samples each, weighted by exact document frequencies (`profiles`). Texts
   that share a hash lie in a bucket.
2. In each bucket every text is held against the bucket's leader, the text of least hash (mostly the same one in all buckets
   of a group): first by their sketches, which estimate the similarity from all samples, then, where that may reach
   the threshold, by exact weighted Jaccard. What is linked makes components.
3. Texts of a bucket that lie in different components after that are held against each other, again by sketches and then
   exactly, in blocks of SMALL against SMALL texts: the bucket's largest component against the rest, and the rest against
   itself. In a bucket of more than LARGE texts, those with a second and a third band in common go first; what these link
   needs no further comparison, and all the others of the bucket are then held against each other like those of any bucket.
4. Components of all links are the classes. A class is named by its smallest id.

Only sketches (200 bytes) travel to candidates. A text travels, compressed, once to each block in which its sketch asks for an exact
comparison. No link is decided by estimate; what an estimate below HOPE rules out reaches the threshold with a
probability of 2e-6 at most. A pair at 0.8 shares a band with a probability of 0.9996, in buckets of any size. A bucket of texts
that share their samples but are not alike takes comparisons of sketches that grow with the square of its texts; blocks bound
the memory of each, and Spark deals them out.

Equal texts are one text before any of this, however many there are. Null and empty texts and texts of spaces have no
shingles: they are alike to their equals only. Rows with a null id have classes like others; repeated rows too. An empty
table gives an empty one. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workers import let_workers_import
from ..operators.components import connected_components
from . import profiles as pr
from . import shingles as sh
from .common import written
from .profiles import text_key
from .url_filter import encode, holds

THRESHOLD = 0.8
BANDS, ROWS = 20, 5
#: The share of samples in common below which a pair is not compared exactly.
HOPE = 0.6
#: Texts on either side of a block, and from how many on a bucket's texts with a second and a third band in common go first.
SMALL, LARGE = 192, 4096
CUTS = 2
#: Keys for which the filters before shuffles of texts have 10 bits each (4 MB); of more keys, more other rows pass.
SIEVE = 3_300_000
#: Columns of a block's matrix at a time, and what rounding may take from a similarity.
COLUMNS, SLACK = 4096, 1e-9


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), pr.SKETCH).reshape(len(rows), -1)


def _alike(sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The weighted Jaccard similarity of all texts of a block, from (shingles, times, weight of one time).

    A shingle that a text has t times is t features of one weight, so the sum of minima is a product of matrices over the
    features that two texts have at least, taken some thousand features at a time.
    """
    sizes = [int(t.sum()) for _, t, _ in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    level = np.concatenate([np.arange(n) - np.repeat(np.cumsum(t) - t, t) for (_, t, _), n in zip(sets, sizes)]).astype(np.uint64)
    shingle = np.concatenate([np.repeat(f, t) for f, t, _ in sets])
    weight = np.concatenate([np.repeat(w, t) for _, t, w in sets])
    total = np.bincount(owner, weight, len(sets))
    feature = np.where(level > 0, sh.mixed(shingle + sh.mixed(level)), shingle)
    _, column, count = np.unique(feature, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    rank = np.cumsum(count > 1) - 1
    column, owner, root = rank[column[shared]], owner[shared], np.sqrt(weight[shared])
    order = np.argsort(column, kind="stable")
    column, owner, root = column[order], owner[order], root[order]
    both = np.zeros((len(sets), len(sets)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, (first, first + COLUMNS))
        part = np.zeros((len(sets), COLUMNS))
        part[owner[x:y], column[x:y] - first] = root[x:y]
        both += part @ part.T
    return both / (total[:, None] + total[None, :] - both)


def _asked(group: pa.Table) -> np.ndarray:
    """The pairs that a block asks for: of different components, and of different sides where there are two."""
    side = np.array(group.column("side").to_pylist())
    _, part = np.unique(np.array(group.column("part").to_pylist(), object), return_inverse=True)
    pairs = part[:, None] != part[None, :]
    return pairs & (side[:, None] != side[None, :]) if side.any() else pairs


def hopeful_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows of pairs (node, leader, ...) whose sketches have HOPE or more in common."""
    names = pairs.columns

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = (_sketches(batch.column("mine")) == _sketches(batch.column("theirs"))).mean(axis=1) >= HOPE
                yield batch.select(names).filter(pa.array(near))

    own = sketches.select("node", F.col("sketch").alias("mine"))
    leader = sketches.select(F.col("node").alias("leader"), F.col("sketch").alias("theirs"))
    return pairs.join(own, "node").join(leader, "leader").select(*names, "mine", "theirs").mapInArrow(run, pairs.schema)


def hopeful_blocks(blocks: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows of blocks (block, node, side, part) that have another row of their block to be compared with."""

    def run(group: pa.Table) -> pa.Table:
        s = _sketches(group.column("sketch"))
        asked = _asked(group)
        near = np.array([(s == row).mean(axis=1) >= HOPE for row in s])
        return group.select(["block", "node", "side", "part"]).filter(pa.array((asked & near).any(axis=1)))

    rows = blocks.join(sketches.select("node", "sketch"), "node").select("block", "node", "side", "part", "sketch")
    return rows.groupBy("block").applyInArrow(run, "block long, node binary, side int, part binary")


def block_links(blocks: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b) of links that connect what is alike in each block (block, node, side, part); texts: (node, body, dfs). A block has
    2 * SMALL texts or so, and gives fewer links than it has texts."""

    def run(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_pylist()
        found, times, sizes = sh.shingle_sets([pr.unpacked(b).decode() for b in group.column("body").to_pylist()])
        weight = pr.idf(np.concatenate([pr.unpack_numbers(d) for d in group.column("dfs").to_pylist()]), n)
        ends = np.cumsum(sizes)
        near = _alike([(found[a:b], times[a:b], weight[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]) >= threshold - SLACK
        near &= _asked(group)
        root = list(range(len(nodes)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        for i, j in np.argwhere(np.triu(near, 1)).tolist():
            x, y = top(i), top(j)
            if x != y:
                root[x] = y
                out.append((nodes[i], nodes[j]))
        return pa.table([pa.array(c, pa.binary()) for c in (zip(*out) if out else ([], []))], ["a", "b"])

    rows = blocks.join(texts, "node").select("block", "node", "side", "part", "body", "dfs")
    return rows.groupBy("block").applyInArrow(run, "a binary, b binary")


def texts_of(asked: DataFrame, docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(node, body, dfs) of the asked nodes. A filter keeps other texts from the shuffle; tasks send equal texts once."""
    asked = written(asked.select("node").distinct(), "asked")
    n = asked.count()
    if not n:
        return asked.select("node", F.lit(b"").alias("body"), F.lit(b"").alias("dfs"))
    sieve = encode(asked.select(F.col("node").alias("key")), 1, min(n, SIEVE), 0.01)
    bodies = pr.distinct_texts(docs.where(holds(F.col("node"), 1, sieve))).where("body IS NOT NULL").select("node", "body")
    bodies = bodies.join(asked, "node", "left_semi").dropDuplicates(["node"])
    return written(bodies.join(profiles.select("node", "dfs"), "node"), "texts")


def _dealt(node: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(node), parts).cast("long")


def star_blocks(pairs: DataFrame) -> DataFrame:
    """Blocks (block, node, side, part) of pairs (node, leader, size): a leader, and SMALL or so of its texts; a leader of many has
    many blocks."""
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("size") / SMALL, F.lit(1.0))))).cast("long")
    dealt = pairs.select("node", "leader", F.xxhash64("leader", parts, _dealt("node", parts)).alias("block"))
    mine = dealt.select("block", "node", F.lit(1).alias("side"), F.col("node").alias("part"))
    heads = dealt.select("block", F.col("leader").alias("node"), F.lit(0).alias("side"), F.col("leader").alias("part")).distinct()
    return mine.unionByName(heads)


def unsettled(entries: DataFrame) -> DataFrame:
    """Of entries (bucket, node, part, keys), those of buckets with several parts, with the bucket's size, its largest part
    and that one's size. Buckets that hold the same texts are one."""
    prints = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"p{i}") for i in range(2)]
    per = entries.groupBy("bucket", "part").agg(F.count("*").alias("k"), *prints)
    both = [F.bit_xor(f"p{i}").alias(f"p{i}") for i in range(2)]
    most = F.max(F.struct("k", "part"))
    of = per.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("k").alias("size"), most["part"].alias("main"), most["k"].alias("n_main"), *both).where("parts > 1")
    once = of.groupBy("p0", "p1", "size").agg(F.min(F.struct("bucket", "main", "n_main")).alias("b")).select("size", "b.*")
    return entries.join(once, "bucket").select("bucket", "node", "part", "keys", "size", "main", "n_main")


def rest_blocks(rest: DataFrame) -> DataFrame:
    """Blocks (block, node, side, part) of `unsettled` buckets: small ones as they are; of larger ones, every part of the main
    component with every part of the rest, and the rest's parts with each other."""
    small = rest.where(F.col("size") <= 2 * SMALL).select(F.xxhash64("bucket").alias("block"), "node", F.lit(0).alias("side"), "part")
    large = rest.where(F.col("size") > 2 * SMALL)
    in_main = F.col("part") == F.col("main")
    mains, rests = F.ceil(F.col("n_main") / SMALL), F.ceil((F.col("size") - F.col("n_main")) / SMALL)
    large = large.select("bucket", "node", "part", in_main.alias("in_main"), mains.alias("mains"), rests.alias("rests"), F.when(in_main, _dealt("node", mains)).otherwise(_dealt("node", rests)).alias("i"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    place = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.alias("side"))
    mine = F.transform(upto("rests"), lambda j: place("m", F.col("i"), j, F.lit(0)))
    against = F.transform(upto("mains"), lambda m: place("m", m, F.col("i"), F.lit(1)))
    among = F.transform(upto("rests"), lambda j: place("r", F.least(j, F.col("i")), F.greatest(j, F.col("i")), (j < F.col("i")).cast("int")))
    large = large.select("bucket", "node", "part", F.explode(F.when(F.col("in_main"), mine).otherwise(F.concat(against, among))).alias("p"))
    return small.unionByName(large.select(F.xxhash64("bucket", "p.kind", "p.x", "p.y").alias("block"), "node", "p.side", "part"))


def cut_large(rest: DataFrame, profiles: DataFrame) -> DataFrame:
    """Buckets of more than LARGE texts by a further band that their texts have in common, CUTS times at most. What is alike in the
    smaller ones goes first; pairs without a further band in common are left to the buckets as they were."""
    for _ in range(CUTS):
        large = rest.where(F.col("size") > LARGE)
        if large.isEmpty():
            break
        more = large.select("node", "part", "keys").join(profiles.select("node", F.explode("bands").alias("other")), "node")
        keys = F.array_sort(F.array_append("keys", F.col("other")))
        more = more.where(~F.array_contains("keys", F.col("other"))).select(F.xxhash64(keys).alias("bucket"), "node", "part", keys.alias("keys")).distinct()
        rest = written(rest.where(F.col("size") <= LARGE).unionByName(unsettled(more)), "rest")
    return rest


def components(profiles: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, component) of texts that are linked with another one."""
    entries = profiles.where("bands IS NOT NULL").select("node", F.explode("bands").alias("bucket"))
    heads = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("leader")).where("size > 1")
    entries = written(entries.join(heads, "bucket").where("node <> leader").select("bucket", "node", "leader", "size"), "entries")

    pairs = entries.groupBy("node", "leader").agg(F.max("size").alias("size"))
    blocks = written(star_blocks(hopeful_pairs(pairs, profiles)), "stars")
    star = written(block_links(blocks, texts_of(blocks, docs, profiles), n, threshold), "star_links")
    found = connected_components(star, written)

    rest = unsettled_in(entries, found)
    large = rest.where(F.col("size") > LARGE)
    if not large.isEmpty():
        found = linked_in(cut_large(large, profiles), found, profiles, docs, n, threshold)
        rest = unsettled_in(entries, found)
    return linked_in(rest, found, profiles, docs, n, threshold)


def unsettled_in(entries: DataFrame, found: DataFrame) -> DataFrame:
    """`unsettled` of the components (node, component) that were found so far."""
    parts = entries.where("size > 2").join(found, "node", "left")
    return written(unsettled(parts.select("bucket", "node", F.coalesce("component", "node").alias("part"), F.array("bucket").alias("keys"))), "rest")


def linked_in(rest: DataFrame, found: DataFrame, profiles: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """The components found so far, merged by all links between different ones in buckets of `unsettled`."""
    blocks = written(hopeful_blocks(rest_blocks(rest), profiles), "blocks")
    more = block_links(blocks, texts_of(blocks, docs, profiles), n, threshold)
    whole = lambda x: more.join(found.withColumnRenamed("node", x), x, "left").select(*more.columns, F.coalesce("component", x).alias(x + x))
    more = written(more.distinct(), "more_links")
    if more.isEmpty():
        return found
    ends = whole("a").join(whole("b").select("a", "b", "bb"), ["a", "b"])
    merged = connected_components(ends.select(F.col("aa").alias("a"), F.col("bb").alias("b")), written)
    ends = found.unionByName(ends.select(F.col("a").alias("node"), F.col("aa").alias("component"))).unionByName(ends.select(F.col("b").alias("node"), F.col("bb").alias("component"))).distinct()
    up = merged.select(F.col("node").alias("component"), F.col("component").alias("top"))
    return written(ends.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "components")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, node, class_id, class_node) for every row: its text's key, its class's smallest id and that id's text."""
    let_workers_import(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), text_key(F.col(text)).alias("node"), F.col(text).alias("text"))
    known, n = pr.profiles(docs, bands, rows)
    owner = known.select("node", "doc_id").join(components(known, docs, n, threshold), "node", "left").withColumn("component", F.coalesce("component", "node"))
    name = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("class_id"), F.col("node").alias("class_node")))
    named = owner.groupBy("component").agg(name.alias("c")).select("component", "c.class_id", "c.class_node")
    owner = written(owner.join(named, "component").select("node", "class_id", "class_node"), "owner")
    return docs.select("doc_id", "node").join(owner, "node")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one of each class, the one of the smallest id, with their own columns only.

    Rows that go, and rows that repeat the one that stays, are looked up by (text, id); a filter lets all others pass by,
    so their texts are not shuffled.
    """
    own = docs.columns
    classes = near_classes(docs, key, text, threshold)
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))
    counted = classes.groupBy("node", "doc_id", first.alias("first")).agg(F.count("*").alias("n"))
    asked = counted.where("NOT first OR n > 1").select(F.xxhash64("node", "doc_id", F.col("doc_id").isNull()).alias("key"), "first")
    asked = written(asked.groupBy("key").agg(F.max("first").alias("first")), "asked_rows")
    n = asked.count()
    if not n:
        return docs
    sieve = encode(asked.select("key"), 1, min(n, SIEVE), 0.01)
    node, doc = text_key(docs[text]), docs[key].cast("long")
    df = docs.withColumn("__near_key", F.xxhash64(node, doc, doc.isNull()))
    maybe = holds(df["__near_key"], 1, sieve)
    looked = df.where(maybe).join(asked.select(F.col("key").alias("__near_key"), F.col("first").alias("__near_first")), "__near_key", "left")
    others = looked.where("__near_first IS NULL").select(*own)
    once = looked.where("__near_first").dropDuplicates(["__near_key"]).select(*own)
    return df.where(~maybe).select(*own).unionByName(others).unionByName(once)
