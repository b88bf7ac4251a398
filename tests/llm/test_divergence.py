"""The source divergence audit against plain Python in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from chainlog.llm import divergence
from chainlog.llm.divergence import Audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def slow(rows, audit):
    """rows: (text, lang, source)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    kept = {lang: sorted(t for t, n in docs[lang].items() if n >= audit.min_docs) for lang, _ in groups}

    def share(own, lang):
        total = sum(own[t] for t in kept[lang])
        return {t: 1 + audit.scale * (own[t] + 1) // (total + len(kept[lang])) for t in kept[lang]}

    p = {g: share(counts[g], g[0]) for g in groups}
    whole = {lang: share(sum((counts[g] for g in groups if g[0] == lang), Counter()), lang) for lang in kept}
    out = []
    for lang, source in groups:
        own = p[lang, source]
        pairs = [(-sum((own[t] - q[t]) ** 2 // q[t] for t in kept[lang]), o.encode(), o) for (other_lang, o), q in p.items() if other_lang == lang and o != source]
        q = whole[lang]
        terms = [(-((own[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept[lang] if counts[lang, source][t] and own[t] > q[t]]
        for part, found, top in (("pair", pairs, None), ("term", terms, audit.top)):
            out += [(lang, source, part, item, -value, i) for i, (value, _, item) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def run(spark, rows, audit):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, n long").repartition(3)
    got = divergence.divergences(df, audit=audit)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    return sorted(map(tuple, got.collect()))


@pytest.fixture(scope="module")
def rows():
    """Languages of 11, 2 and 1 sources, one of which has most rows; nulls, empty texts, repeats, one text of 2 MB."""
    rng = random.Random(4)
    words = [a + b for a in "abcdefghij" for b in "Äéxyz"] + ["日本", "x1y", "don't", "a_b", "UPPER", "Ünder"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + rng.choice([".", "\n", " 12 ", "ß"])
    out = [(text(rng.randint(0, 30)), "en", "s0" if rng.random() < 0.5 else f"s{rng.randint(0, 10)}") for _ in range(150)]
    out += [(text(9), None, None)] * 4 + [(None, None, "only null"), ("", "de", "empty"), ("a b", "de", "few"), ("solo solo", "fr", "one")]
    return out + [("Long " * 400_000 + "end", "en", "s3"), ("end", "en", "sß"), ("end end", "en", "s9")]


@pytest.mark.parametrize("audit", [Audit(), Audit(min_docs=2, top=5, block=3, chunk=4, segment=2), Audit(block=2, chunk=7, segment=1, scale=1000)])
def test_against_plain_python(spark, rows, audit):
    """Also with so small blocks, chunks and segments that all of them are cut."""
    assert run(spark, rows, audit) == slow(rows, audit)


def test_counts_emptied_often_are_the_same(spark, rows, monkeypatch):
    rows = rows[:60]
    batches = lambda: iter([divergence.pa.RecordBatch.from_pydict({"lang": [r[1] for r in rows[i : i + 7]], "source": [r[2] for r in rows[i : i + 7]], "text": [(r[0] or "").encode() for r in rows[i : i + 7]]}) for i in range(0, 60, 7)])

    def sums():
        out = Counter()
        for b in divergence._counted(batches()):
            for r in b.to_pylist():
                out.update({(r["lang"], r["source"], r["term"], k): r[k] for k in ("n", "docs")})
        return out

    whole = sums()
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    assert sums() == whole


def test_parts_of_a_text_do_not_cut_terms(monkeypatch):
    body = ("Ab-" + "ö" * 50 + " c3d ") * 20
    whole = [t for ts in divergence.terms_of(body.encode()) for t in ts]
    monkeypatch.setattr(divergence, "PART", 7)
    assert [t for ts in divergence.terms_of(body.encode()) for t in ts] == whole == [t.encode() for t in TERM.findall(body.translate(LOWER))]


def test_empty_table(spark):
    assert run(spark, [], Audit()) == []
