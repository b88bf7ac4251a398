"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Nulls and empty texts have no words and fail the base rules. Repeated rows are judged one by one, alike. An empty table
gives an empty one. Other columns of the input pass through `judge` unchanged; its own columns carry the prefix given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, STOP_WORDS, bind, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Holds if low * whole <= 1000 * part <= high * whole; a bound of None is open. Shares are in thousandths.

    Texts of fewer than from_words words are too short for the rule and pass it.
    """

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    from_words: int = 0


#: The production table: lengths, symbols, stop words and lines.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2_000, 12_000),
    Rule("symbol_share", "n_symbols", "word_chars", None, 80),
    Rule("stop_word_share", "n_stop_words", "n_words", 20, None, from_words=50),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 500),
    Rule("shouted_share", "n_upper", "word_chars", None, 500),
)


def _sorted_dups(grams: Column) -> Column:
    """Ascending positions of the array's items that occur in it twice or more."""

    def flag(pairs: Column) -> Column:
        n = F.size(pairs)
        none = F.array(F.lit(None).cast("long"))
        keys = F.transform(pairs, lambda x: x["g"])
        near = F.arrays_zip(
            pairs.alias("at"),
            F.concat(none, F.slice(keys, F.lit(1), n - 1)).alias("before"),
            F.concat(F.slice(keys, F.lit(2), n - 1), none).alias("after"),
        )
        near = F.filter(near, lambda x: (x["at"]["g"] == x["before"]) | (x["at"]["g"] == x["after"]))
        return F.array_sort(F.transform(near, lambda x: x["at"]["p"]))

    pairs = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("p")))
    return bind(F.array_sort(pairs), flag)


def repeated_words(tokens: Column, window: int = 5) -> Column:
    """How many words lie in windows of so many words that the text has twice or more."""

    def count(h: Column) -> Column:
        m = F.size(h) - (window - 1)
        zipped = F.arrays_zip(*[F.slice(h, F.lit(i + 1), m) for i in range(window)])
        grams = F.transform(zipped, lambda z: F.xxhash64(*[z[str(i)] for i in range(window)]))
        return F.when(m < 2, F.lit(0).cast("long")).otherwise(bind(grams, covered))

    def covered(grams: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        total = F.aggregate(
            _sorted_dups(grams),
            start,
            lambda s, p: F.struct((p + window).alias("end"), (s["n"] + F.least(F.lit(window), p + window - s["end"])).alias("n")),
            lambda s: s["n"],
        )
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(total)

    return bind(F.transform(tokens, lambda w: F.xxhash64(w)), count)


def measures(text: Column, tokens: Column, lines: Column) -> dict[str, Column]:
    """What the rules compare; tokens and lines are the text's, as arrays."""
    text = F.coalesce(text, F.lit(""))
    solid = F.translate(text, SPACES, "")
    return {
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.length(solid).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(tokens),
        "n_stop_words": F.size(F.filter(tokens, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(*STOP_WORDS))).cast("long"),
        "n_upper": (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
    }


def failed(rules: tuple[Rule, ...], of) -> Column:
    """The names of the rules that do not hold, in the table's order, as one expression; of(name) is a measure."""
    out = []
    for r in rules:
        part, whole = F.lit(1000) * of(r.part), of(r.whole)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (part < F.lit(r.low) * whole)
        if r.high is not None:
            bad = bad | (part > F.lit(r.high) * whole)
        out.append(F.when(bad & (of("n_words") >= r.from_words) if r.from_words else bad, F.lit(r.name)))
    return F.array_compact(F.array(*out))


def _lines(text: Column) -> Column:
    """The text's lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def _base_failed(of) -> Column:
    return (of("n_words") < 10) | (100 * of("n_repeat_words") > 20 * of("n_words"))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, prefix: str = "") -> DataFrame:
    """Adds the measures, base_failed, failed_rules and kept to every row. One scan, no shuffle."""
    tmp = {k: f"__quality_{k}" for k in ("tokens", "lines")}
    df = docs.withColumns({tmp["tokens"]: words(docs[text]), tmp["lines"]: _lines(docs[text])})
    made = measures(df[text], df[tmp["tokens"]], df[tmp["lines"]])
    df = df.withColumns({f"__quality_m_{k}": v for k, v in made.items()}).drop(*tmp.values())
    of = lambda k: df[f"__quality_m_{k}"]
    bad = failed(rules, of)
    base = _base_failed(of)
    own = {prefix + k: of(k) for k in made} | {prefix + "base_failed": base, prefix + "failed_rules": bad, prefix + "kept": ~base & (F.size(bad) == 0)}
    return df.select(*[df[c] for c in docs.columns if c not in own], *[v.alias(k) for k, v in own.items()])


def passes(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a text passes, as one expression in which each measure is worked out once: a filter on columns of measures would
    have them again wherever they are named."""
    parts = F.struct(words(text).alias("tokens"), _lines(text).alias("lines"))
    made = lambda p: F.struct(*[v.alias(k) for k, v in measures(text, p["tokens"], p["lines"]).items()])
    good = lambda m: ~_base_failed(lambda k: m[k]) & (F.size(failed(rules, lambda k: m[k])) == 0)
    return bind(parts, lambda p: bind(made(p), good))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns only."""
    return docs.where(passes(docs[text], rules))
