"""Mixing sources to target weights by systematic sampling.

Within a source the expected copies of its documents are prefix-summed, one random offset is added, and a document is
emitted once for every integer boundary that its interval crosses. Documents are walked in order of size band, a hash of
their id, their id, and a digest of the whole row, so that each band gives its share of words and reruns agree.

All of this is worked out on rows of (id, source, size, digest), equal ones counted as one; texts are joined to the result by
the digest. Prefix sums come from counts of three levels: (source, band), then (source, band, cell of the hash), then rows
of one cell. A cell that an id with many different rows fills is cut further by the digest. So no window holds more than
about a cell's rows or a few counts, whichever source, id or row a third of all rows may have.

A null text has size 0; null sources are one source, last in order; null ids are ordered like an empty one, first; of
repeated rows each is sampled for itself; an empty table gives an empty one. Columns of any name pass through `mixed`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import written

#: Rows that a cell holds on average, at most, and above how many times that a cell is cut.
CELL_ROWS, FULL = 2048, 8
#: Sources in each part that is ranked for itself, and the longest array by which rows are repeated.
SOURCE_ROWS, RUN = 100_000, 1 << 16


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in order of code point; a source is taken at most max_repeats times over."""

    weights: tuple[int, ...] = (1, 2, 3)
    max_repeats: int = 3
    seed: str = "mix"


def source_key(source: Column) -> Column:
    """Distinct for all sources and never null, so that plain equality joins it."""
    return F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit("-"))


def with_rank(sources: DataFrame) -> DataFrame:
    """Adds rank, from 0, to (s, n) in order of s, null last: by ranges of s, each counted and then ranked for itself."""
    parts = max(1, sources.count() // SOURCE_ROWS)
    dealt = sources.withColumn("none", F.col("s").isNull()).repartitionByRange(parts, "none", "s").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("part").agg(F.count("*").alias("k")).select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("none", "s")) - 1
    return dealt.withColumn("own", own).join(firsts, "part").select("s", "n", (F.col("first") + F.col("own")).alias("rank"))


def source_targets(sized: DataFrame, mix: Mix) -> DataFrame:
    """(__mix_source, source_size, target) of rows (s, size, m): targets sum to all sizes by weight; what stands above a source's limit
    goes to the others by weight, until none does. Only sums come to the driver."""
    weight = F.get(F.lit(list(mix.weights)), (F.col("rank") % len(mix.weights)).cast("int")).cast("long")
    sums = written(sized.groupBy("s").agg(F.sum(F.col("size") * F.col("m")).cast("long").alias("n")), "source_sizes")
    fit = written(with_rank(sums).select("s", "n", weight.alias("w"), (F.col("n") * mix.max_repeats).alias("limit")), "source_weights")
    total = fit.agg(F.sum("n")).first()[0] or 0
    # the sources with the least limit for their weight reach it first; a round can only raise what the others get
    rest, weights, held = total, fit.agg(F.sum("w")).first()[0] or 1, F.lit(False)
    while True:
        share = F.lit(rest).cast("long") * F.col("w") / F.lit(weights or 1).cast("long")
        more = held | (share > F.col("limit"))
        now = fit.agg(F.sum(F.when(more, 0).otherwise(F.col("w"))), F.sum(F.when(more, F.col("limit")).otherwise(0))).first()
        left, over = now[0] or 0, now[1] or 0
        if (left, total - over) == (weights, rest) or not left:
            break
        rest, weights, held = total - over, left, more
    target = F.when(F.lit(total) == 0, 0.0).when(held, F.col("limit").cast("double")).otherwise(share)
    return written(fit.select(source_key(F.col("s")).alias("__mix_source"), F.col("n").alias("source_size"), target.alias("target")), "targets")


def band(size: Column) -> Column:
    """The size's first two digits, the others 0: documents of a band differ by a tenth at most."""
    unit = F.pow(F.lit(10), F.greatest(F.length(size.cast("string")) - 2, F.lit(0))).cast("long")
    return F.floor(size / unit) * unit


def digest(df: DataFrame) -> Column:
    """128 bits of a row, in hex; a null differs from any value."""
    cols = [F.to_json(df[f.name]) if isinstance(f.dataType, MapType) else df[f.name] for f in df.schema.fields]
    cols += [c.isNull() for c in cols]
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(i), *cols)), 16, "0") for i in range(2)])


def placed(slim: DataFrame, mix: Mix) -> DataFrame:
    """slim (k, s, size, tie, m) with __mix_first, the number of rows of its source before it, source_size, target, and the
    offset of its source."""
    n = slim.count()
    bits = max(1, (n // CELL_ROWS).bit_length())
    keys = ["__mix_source", "__mix_band", "__mix_cell", "__mix_sub"]
    hashed = F.md5(F.concat(F.lit(mix.seed), F.coalesce(F.col("k").cast("string"), F.lit(""))))
    rows = slim.withColumns({"__mix_source": source_key(F.col("s")), "__mix_band": band(F.col("size")), "__mix_hash": hashed})
    rows = rows.withColumn("__mix_cell", F.shiftright(F.conv(F.substring("__mix_hash", 1, 12), 16, 10).cast("long"), max(0, 48 - bits)))
    full = written(rows.groupBy(keys[:3]).agg(F.count("*").alias("k")).where(F.col("k") > FULL * CELL_ROWS), "full_cells")
    if full.isEmpty():
        rows = rows.withColumn("__mix_sub", F.lit(""))
    else:  # by so many hex digits of the digest that about CELL_ROWS rows stay together
        digits = F.ceil(F.log2(F.col("k") / CELL_ROWS) / 4).cast("int").alias("__mix_digits")
        rows = rows.join(full.select(*keys[:3], digits), keys[:3], "left")
        rows = rows.withColumn("__mix_sub", F.when(F.col("__mix_digits").isNull(), "").otherwise(F.concat("__mix_hash", F.expr("substring(tie, 1, __mix_digits)"))))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    cells = rows.groupBy(keys).agg(F.sum("m").alias("n"))
    bands = cells.groupBy(keys[:2]).agg(F.sum("n").alias("n"))
    bands = bands.select(*keys[:2], sum_before("n", Window.partitionBy(keys[0]).orderBy("__mix_band")).alias("first"))
    cells = cells.select(*keys, sum_before("n", Window.partitionBy(keys[:2]).orderBy("__mix_cell", "__mix_sub")).alias("within"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(mix.seed + "/"), F.substring("__mix_source", 2, 1 << 30))), 1, 4), 16, 10).cast("double") / 65536
    at = cells.join(bands, keys[:2]).join(source_targets(slim, mix), "__mix_source")
    at = at.select(*keys, (F.col("first") + F.col("within")).alias("__mix_start"), "source_size", "target", offset.alias("__mix_offset"))
    own = sum_before("m", Window.partitionBy(keys).orderBy("__mix_hash", "k", "tie"))
    ranked = rows.withColumn("__mix_own", own).join(at, keys)  # dealt as the window wants it already
    return ranked.select(*slim.columns, (F.col("__mix_start") + F.col("__mix_own")).alias("__mix_first"), "source_size", "target", "__mix_offset")


def crossed(first: Column, many: Column, most: int) -> Column:
    """The boundaries crossed by so many rows from `first` on, `most` for each row at most."""
    rate = F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") / F.col("source_size"))
    return F.least(F.floor((first + many) * rate + F.col("__mix_offset")) - F.floor(first * rate + F.col("__mix_offset")), many * most)


def _slim(df: DataFrame, key: str, source: str, size: str, tie: Column) -> DataFrame:
    rows = df.select(F.col(key).alias("k"), F.col(source).cast("string").alias("s"), F.col(size).alias("size"), tie.alias("tie"))
    return written(rows.groupBy("k", "s", "size", "tie").agg(F.count("*").alias("m")), "sizes")


def _one_of_equals(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with what was found (__mix_tie, __mix_m, ...); of rows that are equal in all columns, one."""
    rows = docs.withColumn("__mix_tie", digest(docs)).join(found, "__mix_tie")
    return rows.where("__mix_m = 1").unionByName(rows.where("__mix_m > 1").dropDuplicates(["__mix_tie"]))


def _each(rows: DataFrame, times: str) -> DataFrame:
    """Every row as often as its column `times` says, numbered from 0 in __mix_i, by arrays of RUN numbers at most."""
    upto = lambda a, b: F.explode(F.sequence(a, b))
    rows = rows.where(F.col(times) > 0).withColumn("__mix_run", upto(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / RUN)))
    return rows.withColumn("__mix_i", upto(F.col("__mix_run") * RUN, F.least(F.col(times) - 1, F.col("__mix_run") * RUN + RUN - 1)))


def take(df: DataFrame, key: str, source: str, size: str, mix: Mix = Mix()) -> DataFrame:
    """Adds source_size, target and copies (0 or more) to every row of a frame that has a size in words."""
    df = df.drop("source_size", "target", "copies")
    found = placed(_slim(df, key, source, size, digest(df)), mix).withColumnsRenamed({"tie": "__mix_tie", "m": "__mix_m"})
    if set(df.columns) == {key, source, size} and df.schema[source].dataType.simpleString() == "string":
        rows = found.withColumnsRenamed({"k": key, "s": source, "size": size})
    else:
        rows = _one_of_equals(df, found.drop("k", "s", "size"))
    copies = crossed(F.col("__mix_first") + F.col("__mix_i"), F.lit(1), mix.max_repeats).cast("int")
    return _each(rows, "__mix_m").select(*df.columns, "source_size", "target", copies.alias("copies"))


def sized(docs: DataFrame, text: str = "text", name: str = "size") -> DataFrame:
    """Words are runs of characters other than space and \\t \\n \\v \\f \\r."""
    return docs.withColumn(name, F.coalesce(F.regexp_count(docs[text], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", mix: Mix = Mix()) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns only."""
    slim = _slim(sized(docs, text, "__mix_size"), key, source, "__mix_size", digest(docs))
    copies = crossed(F.col("__mix_first"), F.col("m"), mix.max_repeats)
    found = placed(slim, mix).select(F.col("tie").alias("__mix_tie"), F.col("m").alias("__mix_m"), copies.alias("__mix_copies")).where("__mix_copies > 0")
    return _each(_one_of_equals(docs, found), "__mix_copies").select(*docs.columns)
