"""Rows without a market, of which each left one meets each right one."""

from collections import Counter

from pyspark.sql import functions as F

from chainlog.operators import enrich


def frames(spark, right_nulls):
    left = [(i, None if i % 2 else i) for i in range(400)] + [(1, None)]
    right = [(None, i) for i in range(right_nulls)] + [(2, -1), (2, -2), (4, -3)]
    return spark.createDataFrame(left, "i int, market int"), spark.createDataFrame(right, "market int, d int")


def test_pairs_without_a_market_are_dealt_to_tasks(spark):
    left, right = frames(spark, 50)
    got = enrich.join_market(left, right)
    want = Counter()
    for i, m in ((r["i"], r["market"]) for r in left.collect()):
        found = [r["d"] for r in right.collect() if r["market"] == m] or [None]
        want.update((i, m, d) for d in found)
    assert Counter(tuple(r) for r in got.select("i", "market", "d").collect()) == want
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.6 * sum(sizes)


def test_without_counterpart_rows_stay(spark):
    left, right = frames(spark, 0)
    got = enrich.join_market(left, right)
    assert got.where("market IS NULL").count() == 201 and got.where("market IS NULL AND d IS NOT NULL").isEmpty()
    assert got.columns == ["i", "market", "d"]


def test_written_pairs_are_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(enrich, "LEFT_PARTS", 1)
    monkeypatch.setattr(enrich, "RIGHT_PARTS", 1)
    left = spark.range(400).select("id", F.lit(None).cast("long").alias("market"))
    right = spark.range(5000).select(F.lit(None).cast("long").alias("market"), F.concat(F.lit("text "), "id").alias("d"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        enrich.join_market(left, right).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 400 * 5000 == got.select("id", "d").distinct().count()
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.3 * 400 * 5000
