"""Document fingerprints by SpotSigs.

A spot is a common word (anchor); its signature is the anchor with the chain of the next CHAIN content words, common words
between them skipped. A text's fingerprint is the set of its signatures; two texts are as alike as the Jaccard similarity of
their sets. A text without any spot has one signature, its whole self, so equal texts always have equal fingerprints.

Nulls count as empty texts. Rows with a null id come after all others; rows of equal id are ordered by text. An empty table
gives an empty one. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import STOP_WORDS

CHAIN = 2
THRESHOLD = 0.8
BUCKET_ROWS = 2048
MAX_BUCKETS = 1 << 18
NULL_ID = -(1 << 63)


def signatures(text: Column, anchors: list[str] = STOP_WORDS, chain: int = CHAIN) -> Column:
    """The text's signatures, hashed to 8 hex digits, as a sorted set.

    Each content word is joined with the anchors that follow it into one string; cut at the content words again, an array's
    neighbours then hold the chain. All steps are linear in the text.
    """
    tokens = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    marked = F.array_join(F.transform(tokens, lambda w: F.when(w == "", "").when(w.isin(*anchors), F.concat(F.lit(","), w)).otherwise(F.concat(F.lit(";"), w))), "")

    def spots(units: Column) -> Column:
        n = F.greatest(F.size(units) - chain, F.lit(0))
        zipped = F.arrays_zip(*[F.slice(units, F.lit(i + 1), n).alias(f"u{i}") for i in range(chain + 1)])
        with_anchor = F.filter(zipped, lambda z: F.contains(z["u0"], F.lit(",")))

        def make(z: Column) -> Column:
            tail = F.concat_ws(" ", *[F.substring_index(z[f"u{i}"], ",", 1) for i in range(1, chain + 1)])
            run = F.split(z["u0"], ",")
            return F.transform(F.slice(run, F.lit(2), F.size(run) - 1), lambda a: F.substring(F.md5(F.concat_ws(" ", a, tail)), 1, 8))

        return F.array_sort(F.array_distinct(F.flatten(F.transform(with_anchor, make))))

    made = F.transform(F.array(F.split(marked, ";")), spots)[0]
    return F.transform(F.array(made), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.substring(F.md5(text), 1, 8))))[0]


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets that are not empty."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def length_class(size: Column, threshold: float = THRESHOLD) -> Column:
    """The set length's partition: lengths of one class differ by at most 1 / threshold, so sets that are alike at the threshold
    lie in one class or in neighbours."""
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(threshold)) + F.lit(1e-9)).cast("int")


def _bucket(key: Column, bounds: list[int], fine: int) -> Column:
    """The number of the interval of bounds that holds the key, by binary search, cut into so many parts of equal width."""
    if not bounds:
        return F.lit(0).cast("long")
    array = F.lit(bounds).cast("array<bigint>")
    steps = len(bounds).bit_length()
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(array, mid) <= key)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi"))

    at = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["lo"])
    if fine == 1:
        return at.cast("long")
    low = F.coalesce(F.get(array, at - 1), F.lit(bounds[0])).cast("double")
    high = F.coalesce(F.get(array, at), F.lit(bounds[-1])).cast("double")
    part = F.least(F.greatest(F.floor((key.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * fine), F.lit(0)), F.lit(fine - 1))
    return at.cast("long") * fine + part


def with_next(docs: DataFrame, key: str, bucket_rows: int = BUCKET_ROWS, add=None) -> DataFrame:
    """Every row with `next`, a struct of the row that follows in descending key; the last is followed by the first.

    Rows are dealt once, by buckets of neighbouring keys, so one group's window never holds more than a bucket. A bucket's
    first row is also dealt to the bucket above, whose last row it follows; those rows are one per bucket. add(df) may add
    columns after the rows were dealt and before they are paired.
    """
    own = docs.columns
    tie = [c for c in own if c != key]
    df = docs.withColumn("__next_key", F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)))
    n = df.count()
    want = max(1, min(MAX_BUCKETS, math.ceil(n / bucket_rows)))
    coarse = min(want, 2048)
    cuts = [i / coarse for i in range(1, coarse)]
    bounds = sorted(set(df.agg(F.percentile_approx("__next_key", cuts, 20_000)).first()[0] or [])) if cuts else []
    df = df.withColumn("__next_bucket", _bucket(F.col("__next_key"), bounds, math.ceil(want / coarse)))
    heads = df.groupBy("__next_bucket").agg(F.max("__next_key").alias("__next_key"))  # MAX_BUCKETS rows or a few times that at most
    order = Window.orderBy(F.desc("__next_bucket"))
    rows = heads.select("__next_key", F.lag("__next_bucket").over(order).alias("above"), F.min("__next_bucket").over(Window.partitionBy()).alias("lowest"))
    rows = rows.select("__next_key", F.coalesce("above", "lowest").alias("__next_above"))
    df = df.join(F.broadcast(rows), "__next_key", "left")
    place = lambda b, ghost: F.struct(b.alias("bucket"), F.lit(ghost).alias("ghost"))
    mine, above = place(F.col("__next_bucket"), False), place(F.col("__next_above"), True)
    df = df.withColumn("__next_at", F.explode(F.when(F.col("__next_above").isNull(), F.array(mine)).otherwise(F.array(mine, above))))
    df = df.select(*own, "__next_key", F.col("__next_at.bucket").alias("__next_bucket"), F.col("__next_at.ghost").alias("__next_ghost")).repartition("__next_bucket")
    df = add(df) if add else df
    kept = [c for c in df.columns if not c.startswith("__next_")]
    window = Window.partitionBy("__next_bucket").orderBy("__next_ghost", F.desc("__next_key"), F.col(key).isNull(), *tie)
    df = df.withColumn("next", F.lead(F.struct(*kept)).over(window)).where(~F.col("__next_ghost"))
    return df.select(*kept, "next")


def edited(text: Column, other: Column) -> Column:
    """The last half of the text's code points (rounded down) replaced by the first as many, or all, of the other text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(other, F.lit(1), half))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, edited_text, spots, edited_spots, next_spots): sets of signatures of a text, its edited text and its successor."""
    df = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = with_next(df, "doc_id", add=lambda d: d.withColumn("spots", signatures(F.col("text"))))
    df = df.withColumn("edited_text", edited(F.col("text"), F.col("next.text")))
    return df.select("doc_id", "text", "edited_text", "spots", signatures(F.col("edited_text")).alias("edited_spots"), F.col("next.spots").alias("next_spots"))


def near_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, likeness) of different fingerprints at or above the threshold, by their smallest ids, a < b.

    Equal fingerprints are one class first. Sets are dealt by length class and looked up by their rarest signatures, of which
    two sets that are alike share one: a set of n needs n - ceil(t n) + 1. A pair is compared where the first shared one of
    those is met, if the lengths allow the threshold.
    """
    df = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    sets = df.select("doc_id", signatures(F.col("text")).alias("s"))
    sets = sets.groupBy("s").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("s"))
    each = sets.select("id", "n", F.explode("s").alias("sig"))
    common = each.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = each.join(common, "sig").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("r"))
    need = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    ranked = ranked.select("id", "n", length_class(F.col("n"), threshold).alias("c"), F.slice(F.transform("r", lambda x: x["sig"]), F.lit(1), need.cast("int")).alias("prefix"))
    left = ranked.select(F.col("id").alias("a"), F.col("n").alias("na"), "c", F.explode("prefix").alias("sig"))
    right = ranked.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"), "prefix")
    right = right.select("b", "nb", "c", F.explode("prefix").alias("sig"))
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    pairs = left.join(right, ["c", "sig"]).where((F.col("a") != F.col("b")) & (small >= F.lit(threshold) * large - 1e-9))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda name: sets.select(F.col("id").alias(name), F.col("s").alias(f"s{name}"))
    found = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return found.where(F.col("likeness") >= threshold)
