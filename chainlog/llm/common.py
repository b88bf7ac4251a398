"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_folder as shared_dir
from ..sources.tables import written

__all__ = ["bind", "numbered", "shared_dir", "table", "words", "written"]

#: Characters that end a word: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Function words of English, French, German and Spanish. Fixed values.
STOP_WORDS = (
    "the of and to in a is that for it on with as was be by are this at from or an not have has his her he she they "
    "le la les de des du un une et en que qui dans pour pas sur est au aux par ne se plus avec son ce il elle "
    "der die das den dem und zu von mit ein eine ist nicht sich auf im auch als für es an dass bei aus "
    "el los las y que del se un una por con no para su al lo como más pero sus"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The runs of non-space characters of a text, as an array; none for a null or blank text."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACE_RUN))


def bind(value: Column, body) -> Column:
    """body(value) with the value worked out once, even if the body's lambdas name it often."""
    return F.transform(F.array(value), body)[0]


#: Bits of monotonically_increasing_id() below its partition's number.
ROW_BITS = 33


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds at, a row's place from 0 in its group by the order (nulls first), and n, the group's number of rows.

    Rows are range-sorted once and become a table; places are a row's number in its partition and counts of the partitions
    before, so a group may have any share of all rows. The group must not be null. Of rows that the order does not tell apart,
    any may come first.
    """
    keys = [F.asc_nulls_first(c) for c in (group, *order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = written(dealt.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    dealt = dealt.withColumn("__part", F.shiftright("__id", ROW_BITS))
    counts = dealt.groupBy(group, "__part").agg(F.count("*").alias("k"), F.min("__id").alias("first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("k").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(group, "__part", (F.col("first") - before).alias("__zero"), F.sum("k").over(whole).alias("n"))
    return dealt.join(starts, [group, "__part"]).select(*rows.columns, (F.col("__id") - F.col("__zero")).alias("at"), "n")
