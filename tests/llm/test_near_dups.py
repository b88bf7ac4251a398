import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlog.llm import near_dups as n
from chainlog.llm import profiles as pr
from chainlog.llm import shingles as sh


def slow_classes(rows, threshold=n.THRESHOLD, smooth=pr.SMOOTH):
    """Connected components of all pairs by weighted Jaccard, and equal texts; a class is named by its least id."""
    tf = []
    for _, t in rows:
        w = (t or "").lower().split()
        tf.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    df = Counter(s for c in tf for s in c)
    idf = lambda d: smooth + (1 - smooth) * math.log1p(len(rows) / d) / math.log1p(len(rows))
    weigh = [{s: k * idf(df[s]) for s, k in c.items()} for c in tf]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = weigh[i], weigh[j]
            both = sum(min(w, b[s]) for s, w in a.items() if s in b)
            if (rows[i][1] or "") == (rows[j][1] or "") or (both and both / (sum(a.values()) + sum(b.values()) - both) >= threshold - 1e-9):
                root[top(i)] = top(j)
    names = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        names[top(i)].append(d)
    return [min((x for x in names[top(i)] if x is not None), default=None) for i in range(len(rows))]


def texts(seed, groups=25, size=8, words=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(12)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(3, words))] + common * (rng.random() < 0.5)
        for _ in range(rng.randint(1, size)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
    return out


def classes(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, node string")
    return Counter((r["doc_id"], r["class_id"]) for r in n.near_classes(df).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = list(enumerate(texts(seed)))
    assert classes(spark, rows) == Counter(zip([d for d, _ in rows], slow_classes(rows)))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "one"), (None, "one"), (None, "alone here"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "long " * 40_000), (8, "long " * 40_000)]
    assert classes(spark, rows) == Counter(zip([d for d, _ in rows], slow_classes(rows)))


def family(seed, size, edits, words=120):
    """Texts that each have some words of one base text replaced."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(size):
        t = list(base)
        for _ in range(rng.choice(edits)):
            t[rng.randrange(words)] = f"x{i}y{rng.random()}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("large", [4096, 20])
def test_large_groups_in_small_blocks(spark, monkeypatch, large):
    """A bucket whose members are not all alike, in blocks of few texts, and cut by a second and a third band."""
    rows = list(enumerate(family(9, 90, [1, 3, 5]))) + list(enumerate(texts(4, groups=5), 100))
    monkeypatch.setattr(n, "SMALL", 7)
    monkeypatch.setattr(n, "LARGE", large)
    assert classes(spark, rows) == Counter(zip([d for d, _ in rows], slow_classes(rows)))


def test_cuts_make_buckets_smaller(spark, monkeypatch):
    """Texts that share one passage and little else: each cut by a further band leaves smaller buckets, and no link is lost."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(90))
    rows = [(i, passage + " " + " ".join(f"u{i}_{j}" for j in range(rng.randint(30, 50)))) for i in range(80)]
    rows += [(100 + i, t + " end") for i, t in rows[:10]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs = df.select("doc_id", n.text_key(df["text"]).alias("node"), "text")
    known, _ = pr.profiles(docs, 40, 2)
    entries = known.selectExpr("node", "explode(bands) AS bucket").selectExpr("bucket", "node", "node AS part", "array(bucket) AS keys")
    rest = n.unsettled(entries)
    monkeypatch.setattr(n, "LARGE", 8)
    sizes = [max(r["size"] for r in rest.collect())]
    for cuts in (1, 2):
        monkeypatch.setattr(n, "CUTS", cuts)
        sizes.append(max(r["size"] for r in n.cut_large(rest, known).collect()))
    assert sizes[0] > 8 and sizes[0] > sizes[1] > sizes[2]
    monkeypatch.setattr(n, "SMALL", 4)
    got = {r["doc_id"]: r["class_id"] for r in n.near_classes(df).collect()}
    assert got == dict(zip([d for d, _ in rows], slow_classes(rows)))


def test_filters_that_overflow_lose_nothing(spark, monkeypatch):
    rows = list(enumerate(texts(5)))
    monkeypatch.setattr(n, "SIEVE", 3)
    assert classes(spark, rows) == Counter(zip([d for d, _ in rows], slow_classes(rows)))


def test_near_copies_of_a_large_group_stay_alike(spark):
    """A third of all texts are near copies of one: what they share is common, yet their edits do not part them."""
    rows = list(enumerate(family(6, 40, [1, 2], words=200))) + [(100 + i, " ".join(f"v{i}_{j}" for j in range(50))) for i in range(80)]
    got = dict(classes(spark, rows).keys())
    assert {got[i] for i in range(40)} == {0} and all(got[i] == i for i in range(100, 180))


def test_one_of_each_class_stays(spark):
    rows = list(enumerate(texts(3)))
    rows += [(rows[0][0], rows[0][1]), (None, "null id one"), (None, "null id one"), (500, "kept as it is")]
    df = spark.createDataFrame([(*r, i % 3) for i, r in enumerate(rows)], "doc_id long, text string, lang int")
    kept = n.keep_one(df)
    assert kept.columns == df.columns
    want = Counter({x: 1 for x in set(slow_classes(rows))})
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_shingles_against_plain_python():
    data = ["", "a", "A b c d", "a b c d e", "a b c d e f a b c d e", "\n\tx  y\n", "é " * 9, "w " * 7000 + "end", "z" * 5]
    found, times, sizes = sh.shingle_sets(data)
    at = 0
    for t, k in zip(data, sizes):
        w = t.lower().split()
        want = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        assert k == len(want) and sorted(times[at : at + k]) == sorted(want.values())
        at += k
    assert len(found) == at


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    whole = sh.shingle_sets([text])
    monkeypatch.setattr(sh, "CHUNK", 500)
    assert np.array_equal(whole[0], sh.shingle_sets([text])[0])


@pytest.mark.parametrize("target", [0.3, 0.8])
def test_samples_agree_with_the_similarity(target):
    rng = np.random.default_rng(4)
    off = []
    for _ in range(30):
        k = int(400 * 2 * target / (1 + target))
        ids = rng.integers(0, 2**63, 800 - k).astype(np.uint64)
        w = dict(zip(ids.tolist(), rng.choice([1.0, 1.0, 0.6, 2.0, 5.5], len(ids))))
        a, b = np.sort(ids[:400]), np.sort(ids[400 - k :])
        wa, wb = (np.array([w[x] for x in s.tolist()]) for s in (a, b))
        out = sh.Sampler(200).samples(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([400, 400]))
        off.append((out[0] == out[1]).mean() - sh.jaccard(a, wa, b, wb))
    assert abs(np.mean(off)) < 0.02


def test_document_frequencies_are_exact(spark):
    rows = [(i, f"common words in every text here {i % 90} own{i % 90} words{i % 7} only{i} now{i}") for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(20)] + [(2000, None), (2001, "")]
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    want = Counter(g for _, t in rows for g in grams(t or ""))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    sizes = pr.Sizes(least=500)
    known, total = pr.profiles(df.select("doc_id", n.text_key(df["text"]).alias("node"), "text"), 4, 2, sizes)
    assert total == len(rows)
    body = {r["doc_id"]: r for r in known.collect()}
    assert len(body) == 301 and body[2000]["copies"] == 2 and body[3]["copies"] == 21 and body[2000]["bands"] is None
    for doc, text in rows[:300]:
        own = sh.shingle_sets([text])[0]
        order = {int(sh.shingle_sets([" ".join(g)])[0][0]): want[g] for g in grams(text)}
        assert pr.unpack_numbers(body[doc]["dfs"]).tolist() == [order[int(h)] for h in own]


def test_numbers_and_bytes_come_back():
    for x in ([], [0], [1, 2**64 - 1, 5], list(range(1000))):
        assert pr.unpack_numbers(pr.pack_numbers(np.array(x, np.uint64))).tolist() == x
    assert pr.unpacked(pr.packed(b"")) == b"" and pr.unpacked(pr.packed(b"abc" * 50)) == b"abc" * 50


def test_frequencies_counted_in_parts(spark, monkeypatch):
    """A range counted a few hashes at a time gives the frequencies that it gives at once."""
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 5} c d e f{i % 3} g h i j k{i}") for i in range(60)], "doc_id long, text string")
    docs = docs.select("doc_id", n.text_key(F.col("text")).alias("node"), "text")
    found = []
    for at_once in (1 << 18, 16):
        monkeypatch.setattr(n.pr, "AT_ONCE", at_once)
        rows = n.pr.profiles(docs, 2, 2, n.pr.Sizes(range=400, least=400))[0].collect()
        found.append({bytes(r["node"]): n.pr.unpack_numbers(bytes(r["dfs"])).tolist() for r in rows})
    assert found[0] == found[1] and max(map(max, found[0].values())) > 15


@pytest.mark.parametrize("large", [4096, 1])
def test_size_of_a_bucket_loses_no_links(spark, monkeypatch, large):
    """Links of texts with one band in common are found in buckets of any size, even if no two have a further one in common."""
    rows = list(enumerate(family(9, 90, [1, 3, 5]))) + list(enumerate(texts(4, groups=5), 100))
    monkeypatch.setattr(n, "LARGE", large)
    monkeypatch.setattr(n, "cut_large", lambda rest, profiles: rest.where(F.col("size") <= large))
    assert classes(spark, rows) == Counter(zip([d for d, _ in rows], slow_classes(rows)))
