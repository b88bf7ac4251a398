import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainlog.llm import url_filter as u


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def test_cascade_is_exact_for_its_universe(spark):
    rng = random.Random(3)
    universe = [f"k{i}" for i in range(4000)]
    listed = rng.sample(universe, 300)
    for rate in (0.5, 0.05, None):
        levels = u.build_cascade(keys(spark, listed), keys(spark, universe), first_rate=rate)
        got = keys(spark, universe).select("key", u.is_listed(F.col("key"), levels).alias("hit")).where("hit").collect()
        assert {r["key"] for r in got} == set(listed)
    assert len(levels) > 1


@given(st.sets(st.text("abc.", max_size=6), max_size=30), st.sets(st.text("abc.", max_size=6), max_size=30))
@settings(max_examples=3, deadline=None)
def test_any_sets(spark, listed, others):
    levels = u.build_cascade(keys(spark, [*listed, *listed]), keys(spark, [*listed, *others]), first_rate=0.5)
    got = keys(spark, [*listed, *others]).select("key", u.is_listed(F.col("key"), levels).alias("hit")).collect() if levels else []
    assert {r["key"] for r in got if r["hit"]} == listed or not listed


URLS = [
    "http://a.example.net/en/1", "http://a.example.net/de/1", "HTTP://A.Example.NET", "https://x.example.com/de/", "https://x.example.com/fr/", "http://u.org/fr/?q", "http://u.org/en",
    "https://www.spam-farm.example.org/en/1?x", "https://spam-farm.example.org/fr/1", "no url", None, "", "http:///path", "http://notspam-farm.example.org/", "x://y?://z/", "http://network/en/",
]
WANT = [
    "allow", "block", "block", "block", "allow", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "allow",
]
WANT[2] = "allow"  # its path is empty, so no rule fits, and its host is not listed


def test_rules_and_list(spark):
    rows = [(i, x, "mine") for i, x in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    for bits in (u.MAX_BITS, 1):
        out = u.judge_urls(pages, u.listed_hosts(spark), max_bits=bits)
        got = {r["page_id"]: r for r in out.collect()}
        assert [got[i]["verdict"] for i in range(len(URLS))] == WANT
        assert (got[0]["rule"], got[1]["rule"], got[3]["rule"], got[5]["rule"]) == ("example.net/en/", "net/", "example.com/de/", "org/fr/")
        assert (got[2]["host"], got[2]["path"], got[9]["host"], got[14]["host"], got[14]["path"]) == ("a.example.net", "", "", "y", "")


def test_empty_list_blocks_nothing(spark):
    pages = spark.createDataFrame([(1, "http://spam-farm.example.org/")], "page_id long, url string")
    assert u.judge_urls(pages, keys(spark, [])).first()["verdict"] == "allow"


def test_long_list_stays_in_the_cascade(spark):
    """200,000 listed hosts among 600,000 keys: no join, every verdict right."""
    site = lambda i: F.concat(F.lit("s"), i.cast("string"), F.lit(".example.com"))
    ids = spark.range(600_000)
    listed, pages = ids.where("id % 3 = 0").select(site(F.col("id")).alias("key")), ids.select("id", F.concat(F.lit("http://"), site(F.col("id")), F.lit("/")).alias("url"))
    assert u.build_cascade(listed, pages.select(u.host_of(F.col("url")).alias("key")))
    wrong = u.judge_urls(pages, listed).where((F.col("verdict") == "block") != (F.col("id") % 3 == 0))
    assert wrong.count() == 0 and "Join" not in wrong._jdf.queryExecution().executedPlan().toString()
