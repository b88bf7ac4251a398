import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainlog.llm import pseudonyms as p


def luhn(digits):
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def card(rng, n=16):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def run(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["text"] for r in p.pseudonymise(df, key=key).orderBy("doc_id").collect()]


def test_values_keep_their_format_and_stay_linked(spark):
    rng = random.Random(1)
    c = card(rng)
    spaced = " ".join(c[i : i + 4] for i in range(0, 16, 4))
    a, b, d = run(spark, [f"mail Ann.34@mail7.example.com or {c}, +1 (017) 555-7713.", f"again {spaced} Ann.34@mail7.example.com +1 (017) 555-7713", f"{c}\n97.51.17.173 on 2024-02-29; 31/12/1999 123-45-6789"])
    m = re.fullmatch(r"mail ([A-Z][a-z]{2}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com) or (\d{16}), (\+1 \(\d{3}\) \d{3}-\d{4})\.", a)
    assert m and luhn(m[2]) and m[2] != c
    n = re.fullmatch(r"again ((?:\d{4} ){4})(\S+) (\+1 \(\d{3}\) \d{3}-\d{4})", b)
    assert n[1].replace(" ", "") == m[2] and n[2] == m[1] and n[3] == m[3]
    o = re.fullmatch(r"(\d{16})\n(\d+\.\d+\.\d+\.\d+) on (2024-\d\d-\d\d); (\d\d/\d\d/1999) (\d{3}-\d\d-\d{4})", d)
    assert o[1] == m[2] and all(int(x) < 256 for x in o[2].split(".")) and o[2] != "97.51.17.173"


def test_what_does_not_validate_stays(spark):
    rng = random.Random(2)
    wrong = card(rng)
    wrong = wrong[:-1] + str((int(wrong[-1]) + 1) % 10)
    texts = [None, "", "no values at all", f"id {wrong}", "v1.2.3.4.5 300.1.1.1", "2023-02-30 99/99/2020", 'token = "8ca1b325bc4f85aa6a79e73fc4cbfc2098878e11"', "000-12-3456 a@b"]
    assert run(spark, texts) == texts


def test_keys_differ_and_runs_agree(spark):
    texts = ["4845168114407329 97.51.17.173"]
    assert run(spark, texts) == run(spark, texts) != run(spark, texts, key="other")


def test_permutations(spark):
    n = spark.range(898 * 3)
    small = n.where("id < 365").select(p.permute_number(F.col("id"), "k", "x", 5, 73).alias("o"))
    assert sorted(r[0] for r in small.collect()) == list(range(365))
    text = n.where("id < 1000").select(p.permute_text(F.format_string("%03d", "id"), "k", "x").alias("o"))
    assert sorted(r[0] for r in text.collect()) == [f"{i:03d}" for i in range(1000)]


@given(st.lists(st.integers(0, 2**40), min_size=5, max_size=30, unique=True))
@settings(max_examples=3, deadline=None)
def test_cards_stay_distinct_and_valid(spark, seeds):
    cards = sorted({card(random.Random(s), 13 + s % 7) for s in seeds})
    got = run(spark, cards)
    assert len(set(got)) == len(cards) and all(luhn(g) and len(g) == len(c) for g, c in zip(got, cards))


def test_counts_and_columns(spark):
    df = spark.createDataFrame([(1, "97.51.17.173 97.51.17.173", "x"), (1, "97.51.17.173 97.51.17.173", "x"), (2, None, None)], "doc_id int, text string, found string")
    out = p.pseudonymise(df, counts="n")
    assert out.columns == ["doc_id", "text", "found", "n"]
    assert sorted((r["doc_id"], r["n"]) for r in out.collect()) == [(1, {"ip": 2}), (1, {"ip": 2}), (2, {})]


def test_many_values_in_a_long_text(spark):
    text = " ".join(f"10.0.{i // 250}.{i % 250}" for i in range(2000))
    (out,) = run(spark, [text])
    assert len(set(out.split())) == 2000


CARD16 = "4111111111111111"
PHONES = ["+1 (826) 555-4081", "+44 20 7946 0958", "+298 123456"]
SPACED = "4111 1111 1111 1111"
IPS, DATES, SSNS = ["190.137.223.204", "10.20.30.40"], ["2021-03-04", "04/03/2021", "04.03.2021"], ["123-45-6789"]


def test_values_beside_other_values(spark):
    """Every value gets the pseudonym that it has alone, whatever number stands before or after it."""
    values = [*PHONES, *IPS, *DATES, *SSNS, CARD16, SPACED, "12@x7.example.com"]
    alone = dict(zip(values, run(spark, values)))
    assert all(v != new for v, new in alone.items())
    pairs = [(a, b) for a in values for b in values]
    got = run(spark, [f"{a} {b}" for a, b in pairs])
    wrong = [(a, b, g) for (a, b), g in zip(pairs, got) if g != f"{alone[a]} {alone[b]}"]
    assert not wrong, wrong
    beside = [(f"{CARD16} 123", CARD16), (f"{CARD16} 12/25", CARD16), (f"card 2 {CARD16}", CARD16), (f"{SPACED} 12/25", SPACED), (f"n 7 {SPACED} 123", SPACED)]
    assert run(spark, [t for t, _ in beside]) == [t.replace(v, alone[v]) for t, v in beside]


def slow_values(text):
    """The phones and cards of a text of groups with single spaces: from the first group on, the longest that validates."""
    words, out, i = text.split(" "), [], 0
    while i < len(words):
        ends = []
        for j in range(i + 1, len(words) + 1):
            v = " ".join(words[i:j])
            n = sum(c.isdigit() for c in v)
            if re.fullmatch(p.PHONE, v) and 8 <= n <= 15 or re.fullmatch(r"\d(?: ?\d){12,18}", v) and luhn(v.replace(" ", "")):
                ends.append(j)
        if ends:
            out.append(" ".join(words[i : ends[-1]]))
        i = ends[-1] if ends else i + 1
    return out


def test_groups_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(200):
        groups = ["".join(rng.choice("0123456789") for _ in range(rng.choice((2, 3, 4, 4, 5)))) for _ in range(rng.randrange(3, 14))]
        at = rng.randrange(len(groups))
        groups[at:at] = [card(rng, rng.randrange(13, 20))] * rng.randrange(2)
        texts.append("x " + " ".join(groups) + " y")
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(F.regexp_extract_all("text", p.pattern_of(F.col("text")), F.lit(0))).collect()]
    assert got == [slow_values(t) for t in texts] and sum(map(len, got)) > 100


def test_short_groups_and_timestamps(spark):
    phones = ["+33 1 23 45 67 89", "+61 2 9876 5432", "+81 3 1234 5678", "+49 30 1234567-0", "+33.1.23.45.67.89"]
    times = ["2021-03-04T10:00:00Z", "2021-03-04T10:00:00+01:00", "2021-03-04T1000"]
    stay = ["+1 2 3 4", "2021-03-04Test", "2021-03-04T1"]
    (date, *got) = run(spark, ["2021-03-04", *phones, *times, *stay, *[f"{f} {i}" for f in phones for i in ("10.20.30.40", "2021-03-04T10:00Z")]])
    new = dict(zip(phones, got))
    shape = lambda v: re.sub(r"\d", "0", v)
    assert all(v != n and shape(v) == shape(n) and v[:2] == n[:2] for v, n in new.items())
    assert date != "2021-03-04" and got[5:8] == [date + t[10:] for t in times]
    assert got[8:11] == stay
    assert all(g.startswith(new[f] + " ") and g.endswith(" " + date + "T10:00Z") for f, g in zip(phones, got[12::2]))
    assert all(g.startswith(new[f] + " ") and g.count(".") == f.count(".") + 3 and not g.endswith("10.20.30.40") for f, g in zip(phones, got[11::2]))
