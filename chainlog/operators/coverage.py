"""Whether captured pages are whole: which blocks were asked for, which were answered, and which are still missing.

A page is the answer to a request for the blocks of a range of one contract. Explorers cut a page at a number of rows, so a page
with as many holds all of the blocks before its last one, and perhaps a part of that; the rest must come with another page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows at which an explorer cuts a page. Fixed value.
PAGE_ROWS = 10_000


def covered_ranges(pages: DataFrame, page_rows: int | None = PAGE_ROWS) -> DataFrame:
    """(contract, from_block, to_block) that pages (contract, from_block, to_block, ok, n, last_block) answer for certain.

    A page that is not ok answers nothing; one of page_rows rows or more, the blocks before its last. With page_rows None, no
    page is ever cut. Pages without a contract or a range are left out.
    """
    df = pages.where("ok AND contract IS NOT NULL AND from_block IS NOT NULL AND to_block IS NOT NULL")
    if page_rows is not None:
        df = df.withColumn("to_block", F.when(F.col("n") >= page_rows, F.least("to_block", F.col("last_block") - 1)).otherwise(F.col("to_block")))
    return df.where("from_block <= to_block").select("contract", "from_block", "to_block")


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """The same blocks in as few ranges as there can be: those that overlap or touch become one.

    Of ranges that begin at one block only the longest goes on, before the shuffle; a window over a contract's pages, not over
    its transactions, then finds where an island begins.
    """
    once = ranges.groupBy("contract", "from_block").agg(F.max("to_block").alias("to_block"))
    along = Window.partitionBy("contract").orderBy("from_block")
    before = F.max("to_block").over(along.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("from_block") > before + 1, F.lit(True)).cast("int")
    islands = once.withColumn("__begins", begins).withColumn("__island", F.sum("__begins").over(along))
    return islands.groupBy("contract", "__island").agg(F.min("from_block").alias("from_block"), F.max("to_block").alias("to_block")).drop("__island")


def missing_ranges(ranges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(contract, from_block, to_block) of wanted blocks that no range has; both may overlap and repeat."""
    have, want = merged_ranges(ranges), merged_ranges(wanted)
    want = want.select("contract", F.col("from_block").alias("__first"), F.col("to_block").alias("__last"))
    hits = want.join(have, "contract").where("from_block <= __last AND to_block >= __first")
    hits = hits.select("contract", "__first", "__last", F.greatest("from_block", "__first").alias("from_block"), F.least("to_block", "__last").alias("to_block"))
    # fences of one block stand right outside of what is wanted; what lies between two neighbours is missing
    fences = [want.select("contract", "__first", "__last", at.alias("from_block"), at.alias("to_block")) for at in (F.col("__first") - 1, F.col("__last") + 1)]
    along = Window.partitionBy("contract", "__first").orderBy("from_block", "to_block")
    gaps = fences[0].unionByName(fences[1]).unionByName(hits).withColumn("__next", F.lead("from_block").over(along))
    gaps = gaps.select("contract", (F.col("to_block") + 1).alias("from_block"), (F.col("__next") - 1).alias("to_block"))
    return gaps.where("from_block <= to_block")
