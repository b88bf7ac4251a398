"""URL filters: longest-match rules, then exact membership of a host list by a cascade of Bloom filters.

The cascade's first level encodes the listed keys, the second those keys of the corpus that the first takes for listed by
mistake, the third the listed keys that the second mistakes, and so on until a level mistakes none. A key of the corpus
is listed if the first level that refuses it has an even number (counting from 1). As the levels were built against every
key of the corpus, this is exact for them, and each row is judged by a projection, without a join.

The filters' bits come to the driver and go to the tasks as literals. They take about 1.44 log2(keys / listed) + 5 bits for
each listed key and are bounded by max_bits; a longer list is answered by a shuffled join instead, with the same verdicts.

Null and malformed urls have an empty host and path, which no rule fits and no list holds: they are allowed. Repeated rows
are judged alike; an empty table or an empty list is allowed; other columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, written

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Bits of all levels that go to the tasks: 4 MB, enough for some 1.7 million listed keys among a thousand times as many.
MAX_BITS = 1 << 25


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the production query.
RULES = (UrlRule("block", "net"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))

#: Hosts that the production query blocks with all their subdomains, where no rule fits.
LISTED_HOSTS = tuple(f"{site}.example.{top}" for site in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all domains above it: a.b.c, b.c, c."""
    n = F.size(F.split(host, r"\."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.call_function("substring_index", host, F.lit("."), -i)))


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """Double hashing: h1 + i * h2, both from the key and the level."""
    a, b = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    return [F.pmod(F.shiftrightunsigned(a, 8) + F.lit(i) * F.shiftrightunsigned(b, 16), F.lit(bits).cast("long")) for i in range(hashes)]


def encode(keys: DataFrame, level: int, n: int, rate: float) -> Level:
    """A filter of n keys (one column, `key`) for a rate of mistakes. Words of bits are joined before they leave the tasks."""
    bits = max(64, math.ceil(n * 1.4427 * max(0.7, math.log2(1 / rate)) / 64) * 64)
    hashes = max(1, round(bits / max(1, n) * 0.693))
    hashes = min(hashes, 24)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("p"))
    at = at.select(F.shiftright("p", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int")).alias("b"))
    words = [0] * (bits // 64)
    for row in at.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():  # at most bits / 64 rows, which max_bits bounds
        words[row["w"]] = row["b"]
    return Level(bits, hashes, tuple(words))


def holds(key: Column, number: int, level: Level) -> Column:
    """Whether the filter takes the key for one of its own. The words are one literal, made from text when the plan is optimised."""
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")

    def all_set(w: Column) -> Column:
        bit = lambda p: F.call_function("shiftrightunsigned", F.get(w, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
        return reduce(lambda a, b: a & b, map(bit, _positions(key, number, level.bits, level.hashes)))

    return bind(words, all_set)


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS, first_rate: float | None = None) -> list[Level] | None:
    """Levels over distinct keys (one column, `key`); None if the list needs more than max_bits.

    The universe is every key that will ever be asked. Only counts and the filters' words come to the driver.
    """
    listed = written(listed.where("key IS NOT NULL").distinct(), "listed")
    others = universe.where("key IS NOT NULL").distinct().join(listed, "key", "left_anti")
    others = written(others, "universe")
    n, m = listed.count(), others.count()
    if not n:
        return []
    rate = first_rate or min(0.5, max(1e-6, n / (1.414 * max(1, m))))
    levels: list[Level] = []
    mine, theirs, size = listed, others, n
    while size:
        number = len(levels) + 1
        need = size * 1.4427 * max(0.7, math.log2(1 / (rate if number == 1 else 0.5)))
        if sum(x.bits for x in levels) + need > max_bits:
            return None
        levels.append(encode(mine, number, size, rate if number == 1 else 0.5))
        # what the new level mistakes is the next one's own
        mistaken = theirs.where(holds(F.col("key"), number, levels[-1]))
        mistaken = written(mistaken, "mistaken")
        mine, theirs, size = mistaken, mine, mistaken.count()
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Exact for the keys the cascade was built with."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels), 0, -1):
        out = F.when(~holds(key, i, levels[i - 1]), F.lit(i % 2 == 0)).otherwise(out)
    return out


def rule_for(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(
    pages: DataFrame, listed: DataFrame, url: str = "url", rules: tuple[UrlRule, ...] = RULES, max_bits: int = MAX_BITS, first_rate: float | None = None
) -> DataFrame:
    """Adds host, path, rule, listed and verdict. listed: one column, `key`, of hosts that block all their subdomains."""
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "listed", "verdict")]
    df = pages.select(*own, host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    keys = df.select(F.explode(suffixes(F.col("host"))).alias("key"))
    levels = build_cascade(listed.select(F.col("key").cast("string")), keys, max_bits, first_rate)
    if levels is None:  # a long list: every distinct host is looked up once, by shuffled joins
        hosts = df.select("host").distinct().withColumn("key", F.explode(suffixes(F.col("host"))))
        hit = hosts.join(listed.select("key").distinct(), "key", "left_semi").select("host").distinct().withColumn("listed", F.lit(True))
        df = df.join(hit, "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        df = df.withColumn("listed", F.exists(suffixes(F.col("host")), lambda k: is_listed(k, levels)) if levels else F.lit(False))
    fit = rule_for(F.col("host"), F.col("path"), rules)
    df = df.withColumn("__url_fit", fit)
    plain = F.when(F.col("listed"), "block").otherwise("allow")
    return df.select(*own, "host", "path", F.col("__url_fit.rule").alias("rule"), "listed", F.coalesce("__url_fit.verdict", plain).alias("verdict"))


def listed_hosts(spark: SparkSession, hosts: tuple[str, ...] = LISTED_HOSTS) -> DataFrame:
    return spark.createDataFrame([(h,) for h in hosts], "key string")
