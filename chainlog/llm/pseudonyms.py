"""Format-preserving pseudonyms for personal numbers, dates and addresses in text.

Every validated value is permuted by a keyed Feistel network within its own format, so equal values get equal pseudonyms
in all documents and two values never share one:

- card: 13 to 19 digits, spaces or dashes between groups allowed, with a right Luhn digit; the pseudonym has one too
- phone: + and 8 to 15 digits with the usual separators, in groups of one digit or more; the digits after the country code are permuted
- ssn: ddd-dd-dddd with a possible area, group and serial
- ip: four octets; permuted as a 32-bit number
- date: yyyy-mm-dd, dd/mm/yyyy or dd.mm.yyyy that the calendar has, 1900 to 2099, also before T and a time; permuted as a day of its leap or
  common year
- email: letters and digits of all but the last label are permuted, each within its class

A phone or card ends at the last group of digits with which it validates, so numbers beside it are not taken for its end:
groups that are an IP, date, SSN or e-mail address are its own only if it does not validate without them, and a phone ends
before a valid card. A card may start at any group after a space. Where values overlap, the first one counts.

What does not validate is left as it is: other long numbers, versions, hashes. A null text stays null; an empty one stays
empty; repeated rows are alike; an empty table gives an empty one; other columns pass through.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind

ROUNDS = 8
#: The session's setting that holds the key, and the key of trials and tests, which everyone knows.
KEY_SETTING, OPEN_KEY = "spark.chainlog.pseudonyms.secret", "pseudonym key"

#: The formats, tried in this order at each place. Lookarounds keep matches from starting or ending within a longer token.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)"
DATE = r"(?<![\w./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d/\d\d/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?!(?!T\d\d:?\d\d)[\w/-]|\.\d)"
SSN = r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])"
PHONE = r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d){4,14}(?!\w)"
CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)"
FIXED = "|".join(f"(?:{p})" for p in (EMAIL, IP, DATE, SSN))
SOME = r"[0-9@]"
#: Places where a phone or card may start, with what follows as far as it decides where the value ends.
AFTER = r"(?:[\w.%+-]{0,64}@|T\d\d:?\d\d)?\w?"
PHONE_AT = rf"(?<![\w+])(?=(\+\d[\d ./()-]{{6,99}}{AFTER}))\+"
CARD_AT = rf"(?<![\w.+-])(?=\d(?:[ -]?\d){{12}})(?=(\d[\d ./-]{{12,59}}{AFTER}))\d+"
#: Ends by the number of digits, longest first, and what is a value of its own after a space.
PHONE_ENDS = [rf"^\+\d(?:[ .()-]{{0,3}}\d){{{n - 1}}}(?!\w)" for n in range(15, 7, -1)]
CARD_ENDS = [rf"^\d(?:[ -]?\d){{{n - 1}}}(?![\w-]|\.\d)" for n in range(19, 12, -1)]
OTHERS = rf"(?<= )(?:{IP}|{DATE}|{SSN}|[A-Za-z0-9][A-Za-z0-9._%+-]*@)"

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
LEAP_DAYS, COMMON_DAYS = (6, 61), (5, 73)  # factors of 366 and 365: the two halves of a day's number


def _stream(key: str, purpose: str, half: Column, step: Column) -> Column:
    """64 hex digits that depend on the key, the format, the round and the other half."""
    return F.sha2(F.concat_ws("/", F.lit(key), F.lit(purpose), step.cast("string"), half), 256)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def permute_text(value: Column, key: str, purpose: str) -> Column:
    """Digits and letters of a string, each moved within its class; other characters stay. A permutation of the format.

    The left and right half take turns: each character is shifted by a keyed stream of the other half. The halves' shape
    (lengths and classes) enters the stream, so formats do not disturb each other.
    """

    def shifted(own: Column, other: Column, step: Column, shape: Column) -> Column:
        def with_stream(pads: Column) -> Column:
            def move(c: Column, i: Column) -> Column:
                def by(alphabet: str) -> Column:
                    at = F.instr(F.lit(alphabet), c) - 1
                    return F.substr(F.lit(alphabet), (at + _byte(F.get(pads, F.floor(i / 16).cast("int")), i)) % len(alphabet) + 1, F.lit(1))

                return (
                    F.when(F.contains(F.lit(DIGITS), c), by(DIGITS))
                    .when(F.contains(F.lit(LOWER), c), by(LOWER))
                    .when(F.contains(F.lit(UPPER), c), by(UPPER))
                    .otherwise(c)
                )

            return F.array_join(F.transform(F.split(own, ""), move), "")

        blocks = F.sequence(F.lit(0), F.floor(F.length(own) / 16).cast("int"))
        pads = F.transform(blocks, lambda b: _stream(key, purpose, F.concat_ws("/", b.cast("string"), shape, other), step))
        return bind(pads, with_stream)

    shape = F.translate(value, LOWER + UPPER + DIGITS, "a" * 26 + "A" * 26 + "0" * 10)
    cut = F.floor(F.length(value) / 2).cast("int")

    def run(v: Column) -> Column:
        start = F.struct(F.substr(v["t"], F.lit(1), v["n"]).alias("l"), F.substr(v["t"], v["n"] + 1).alias("r"))

        def step(s: Column, i: Column) -> Column:
            left = F.when(i % 2 == 0, shifted(s["l"], s["r"], i, v["s"])).otherwise(s["l"])
            right = F.when(i % 2 == 1, shifted(s["r"], s["l"], i, v["s"])).otherwise(s["r"])
            return F.struct(left.alias("l"), right.alias("r"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))

    return F.when(F.length(value) < 2, value).otherwise(bind(F.struct(value.alias("t"), cut.alias("n"), shape.alias("s")), run))


def permute_number(value: Column, key: str, purpose: str, left: int, right: int) -> Column:
    """A number below left * right, permuted among those: its quotient and remainder shift each other in turn."""

    def pad(half: Column, step: Column, size: int) -> Column:
        return F.conv(F.substring(_stream(key, purpose, half.cast("string"), step), 1, 12), 16, 10).cast("long") % size

    def step(s: Column, i: Column) -> Column:
        a = F.when(i % 2 == 0, (s["a"] + pad(s["b"], i, left)) % left).otherwise(s["a"])
        b = F.when(i % 2 == 1, (s["b"] + pad(s["a"], i, right)) % right).otherwise(s["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(F.floor(value / right).cast("long").alias("a"), (value % right).cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["a"] * right + s["b"])


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """The Luhn sum of a string of digits, counted from the right."""
    first = 0 if doubled_last else 1

    def add(total: Column, x: Column) -> Column:
        return total + x

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == first, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), add)


def _refill(shape: Column, digits: Column) -> Column:
    """The digits in the places that digits have in the shape."""

    def fill(parts: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            is_digit = F.contains(F.lit(DIGITS), c)
            return F.struct(
                F.concat(s["t"], F.when(is_digit, F.substr(parts, s["i"], F.lit(1))).otherwise(c)).alias("t"),
                (s["i"] + is_digit.cast("int")).alias("i"),
            )

        return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), step, lambda s: s["t"])

    return bind(digits, fill)


def _card(m: Column, key: str) -> Column:
    digits = F.translate(m, " -", "")

    def renew(body: Column) -> Column:
        check = (10 - luhn_sum(body, True) % 10) % 10
        return _refill(m, F.concat(body, check.cast("string")))

    body = permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return F.when(luhn_sum(digits, False) % 10 == 0, bind(body, renew)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0)
    rest = F.substr(m, F.length(code) + 1)
    n = F.length(F.translate(m, "+ .()-", ""))
    digits = F.translate(rest, " .()-", "")
    return F.when(n.between(8, 15), F.concat(code, _refill(rest, permute_text(digits, key, "phone")))).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    """Area 001-665 or 667-899, group 01-99, serial 0001-9999, permuted as one number."""
    area = F.substring(m, 1, 3).cast("long")
    area = F.when(area > 666, area - 2).otherwise(area - 1)
    number = (area * 99 + F.substring(m, 5, 2).cast("long") - 1) * 9999 + F.substring(m, 8, 4).cast("long") - 1

    def show(x: Column) -> Column:
        a = F.floor(x / (99 * 9999)) + 1
        a = F.when(a >= 666, a + 1).otherwise(a)
        return F.format_string("%03d-%02d-%04d", a, F.floor(x / 9999) % 99 + 1, x % 9999 + 1)

    return bind(permute_number(number, key, "ssn", 898 * 99, 9999), show)


def _ip(m: Column, key: str) -> Column:
    octet = lambda i: F.split_part(m, F.lit("."), F.lit(i)).cast("long")
    number = octet(1) * (1 << 24) + octet(2) * (1 << 16) + octet(3) * (1 << 8) + octet(4)

    def show(x: Column) -> Column:
        return F.concat_ws(".", *[(F.floor(x / (1 << s)) % 256).cast("string") for s in (24, 16, 8, 0)])

    return bind(permute_number(number, key, "ip", 1 << 16, 1 << 16), show)


def _date(m: Column, key: str) -> Column:
    out = m
    for pattern, form in ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d\d/", "dd/MM/yyyy"), (r"^\d\d\.", "dd.MM.yyyy")):
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        first = F.trunc(day, "year")
        number = F.datediff(day, first).cast("long")
        leap = F.dayofyear(F.date_sub(F.add_months(first, 12), 1)) == 366
        moved = F.when(leap, permute_number(number, key, "leap year", *LEAP_DAYS)).otherwise(permute_number(number, key, "common year", *COMMON_DAYS))
        shown = F.date_format(F.date_add(first, moved.cast("int")), form)
        out = F.when(m.rlike(pattern), F.coalesce(shown, m)).otherwise(out)
    return out


def _email(m: Column, key: str) -> Column:
    name, tld = F.regexp_extract(m, r"^(.*)\.[^.]*$", 1), F.regexp_extract(m, r"(\.[^.]*)$", 1)
    return F.concat(permute_text(name, key, "email"), tld)


KINDS = (("email", EMAIL, _email), ("ip", IP, _ip), ("date", DATE, _date), ("ssn", SSN, _ssn), ("phone", PHONE, _phone), ("card", CARD, _card))


def kind_of(match: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern, _ in reversed(KINDS):
        out = F.when(match.rlike(rf"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one value of a known format; the value itself if it does not validate."""
    out = match
    for _, pattern, renew in reversed(KINDS):
        out = F.when(match.rlike(rf"^(?:{pattern})$"), renew(match, key)).otherwise(out)
    return out


def _valid(window: Column, ends: list[str], good) -> Column:
    """What validates of the values that start with the window, longest first."""
    return F.filter(F.transform(F.array(*map(F.lit, ends)), lambda e: F.regexp_substr(window, e)), lambda v: v.isNotNull() & good(v))


def _valid_cards(window: Column) -> Column:
    return _valid(window, CARD_ENDS, lambda v: luhn_sum(F.translate(v, " -", ""), False) % 10 == 0)


def _phone_of(window: Column) -> Column:
    """The longest valid phone before a valid card, else the longest one, or null."""

    def pick(found: Column) -> Column:
        rest = lambda v: F.substr(window, F.length(v) + 1)
        before = F.filter(found, lambda v: F.startswith(rest(v), F.lit(" ")) & (F.size(_valid_cards(F.substr(rest(v), F.lit(2)))) > 0))
        return F.coalesce(F.get(before, F.lit(0)), F.get(found, F.lit(0)))

    return bind(_valid(window, PHONE_ENDS, lambda v: v.rlike(rf"^(?:{PHONE})$")), pick)


def _card_of(window: Column) -> Column:
    return F.get(_valid_cards(window), F.lit(0))


def _literals(text: Column, at: str, value_of) -> Column:
    """The valid values at the places of a pattern, as alternatives of a pattern, longest first; empty if none."""

    def own(window: Column) -> Column:
        return F.coalesce(bind(F.regexp_replace(window, OTHERS, "|"), value_of), value_of(window))

    values = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(at), F.lit(1)), own), lambda v: v.isNotNull()))
    ordered = F.reverse(F.array_sort(F.transform(values, lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))))
    return F.array_join(F.transform(ordered, lambda x: F.concat(F.lit(r"\Q"), x["v"], F.lit(r"\E"))), "|")


def pattern_of(text: Column) -> Column:
    """A pattern of what is to be replaced in the text: the formats known by pattern alone, and its valid phones and cards."""

    def put(x: Column) -> Column:
        phones = F.when(x["phones"] != "", F.concat(F.lit(r"|(?<![\w+])(?:"), x["phones"], F.lit(r")(?!\w)"))).otherwise("")
        cards = F.when(x["cards"] != "", F.concat(F.lit(r"|(?<![\w.+-])(?:"), x["cards"], F.lit(r")(?![\w-]|\.\d)"))).otherwise("")
        return F.concat(F.lit(FIXED), phones, cards)

    return bind(F.struct(_literals(text, PHONE_AT, _phone_of).alias("phones"), _literals(text, CARD_AT, _card_of).alias("cards")), put)


def key_of(spark: SparkSession) -> str:
    """The session's key. Without one, pseudonyms are made with a key that anyone can undo them with, and a warning says so."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with the open key", stacklevel=3)
    return key or OPEN_KEY


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None, counts: str | None = None) -> DataFrame:
    """The rows with the text's values replaced; counts names a map column of replacements by kind, if wanted. The key is the
    session's (`key_of`) if none is given; it is part of the plan, so who may read plans and event logs may read it.

    The text is cut at its matches; pieces and pseudonyms are then joined again, so nothing is replaced twice. Texts without
    a digit or @ are not searched further. One projection, no shuffle.
    """
    key = key or key_of(docs.sparkSession)
    found, pieces, new, pattern = "__pseudonyms_found", "__pseudonyms_pieces", "__pseudonyms_new", "__pseudonyms_pattern"
    df = docs.withColumn(pattern, F.when(docs[text].rlike(SOME), pattern_of(docs[text])))
    df = df.withColumn(found, F.when(df[pattern].isNotNull(), F.regexp_extract_all(df[text], df[pattern], F.lit(0))))
    has = F.size(df[found]) > 0
    df = df.withColumn(new, F.when(has, F.transform(df[found], lambda m: pseudonym(m, key))))
    df = df.withColumn(pieces, F.when(has, F.split(df[text], df[pattern], -1)))
    joined = F.array_join(F.zip_with(df[pieces], df[new], lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = {text: F.when(has, joined).otherwise(df[text])}
    if counts is not None:
        changed = F.filter(F.arrays_zip(df[found].alias("a"), df[new].alias("b")), lambda x: x["a"] != x["b"])
        kinds = F.coalesce(F.transform(changed, lambda x: kind_of(x["a"])), F.array().cast("array<string>"))
        out[counts] = bind(kinds, lambda ks: F.transform(F.array_sort(F.array_distinct(ks)), lambda k: F.struct(k.alias("kind"), F.size(F.filter(ks, lambda x: x == k)).alias("n"))))
        out[counts] = F.map_from_entries(out[counts])
    return df.select(*[out.get(c, df[c]).alias(c) for c in docs.columns], *[v.alias(c) for c, v in out.items() if c not in docs.columns])
