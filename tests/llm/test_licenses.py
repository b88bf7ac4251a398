import random
import re
import textwrap

from chainlog.llm import licenses as li

T = li.TEMPLATES


def slow(text):
    """Every window of every template, without pruning."""
    w = [x for x in re.split(li.NOT_WORD, (text or "").lower()) if x]
    grams = [f"{a} {b}" for a, b in zip(w, w[1:])]
    found = []
    for name, t in T.items():
        own, m = {*li.template_bigrams(t)}, len(li.template_words(t))
        stretch, end = [], 0
        for s, g in enumerate(grams):
            if g not in own:
                continue
            last = max(i for i in range(s, min(s + m - 1, len(grams))) if grams[i] in own)
            window = {*grams[s : last + 1]}
            dice = 2 * len(window & own) / (len(window) + len(own))
            if dice >= li.THRESHOLD:
                if stretch and s + 1 >= end:
                    found.append((*max(stretch), name))
                    stretch = []
                stretch.append((dice, last - s + 2, -(s + 1)))
                end = max(end, s + 1 + last - s + 2)
        if stretch:
            found.append((*max(stretch), name))
    meets = lambda x, y: not (-y[2] >= -x[2] + x[1] or -x[2] >= -y[2] + y[1])
    weight = lambda x: (x[0] * x[1], x[0], x[2])
    better = lambda y, x: weight(y) > weight(x) or weight(y) == weight(x) and y[3] < x[3]
    kept = [x for x in found if not any(meets(x, y) and better(y, x) for y in found)]
    return sorted((-s, n, dice, name) for dice, n, s, name in kept)


def boxed(text, width, sign):
    return "\n".join(sign + line for line in textwrap.wrap(text, width, break_long_words=False))


def scanned(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, license_spans int")
    return {r["doc_id"]: [(x["start"], x["n_words"], x["dice"], x["license"]) for x in r["license_spans"]] for r in li.scan(df).collect()}


def test_against_plain_python(spark):
    rng = random.Random(8)
    words = [x for t in T.values() for x in t.split()]
    texts = [None, "", "MIT", "Some prose.\nReleased under the MIT License.\nmore", "released   UNDER the mit licence!", "\n".join(T.values()), "Released under the MIT License. " * 3,
             "Licensed under the Apache License, Version 2.0. now", "a b c d e f g " * 500, T["mit"] + " " + T["bsd-2-clause"], "of the software the software of the " * 300]
    texts += [" ".join(rng.choice(words) for _ in range(300)) for _ in range(3)]
    for name in sorted(T):  # words dropped, changed and put in
        mixed = []
        for x in T[name].split():
            if rng.random() > 0.03:
                mixed.append(x if rng.random() > 0.03 else rng.choice(words))
            if rng.random() < 0.03:
                mixed.append("inserted")
        texts.append("Copyright 2020 Somebody. " + " ".join(mixed) + " the end of the file")
    got = scanned(spark, texts)
    assert {i: slow(t) for i, t in enumerate(texts)} == got
    assert not got[2] and [x[3] for x in got[9]] == ["mit", "bsd-2-clause"]


def test_whole_licences_however_wrapped(spark):
    names = sorted(T)
    texts = [f"#!/bin/sh\n{boxed(T[n], width, sign)}\nint main() {{ }}\n" for n in names for width, sign in ((40, " * "), (72, "// "), (10**6, ""))]
    got = scanned(spark, texts)
    for i in range(len(texts)):
        assert [(x[2], x[3]) for x in got[i]] == [(1.0, names[i // 3])]


def test_notices_inside_a_line_and_over_two(spark):
    go = "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file."
    got = scanned(spark, ["Copyright 2020 Foo Corp. Released under the MIT License. See LICENSE.", go])
    assert [[x[3] for x in got[i]] for i in (0, 1)] == [["mit-notice"], ["bsd-style-notice"]]


def test_bounds_lose_nothing():
    for n in range(1, 30):
        low, high = li.size_bounds(n, li.THRESHOLD)
        for m in range(1, 60):
            if 2 * min(n, m) / (n + m) >= li.THRESHOLD:
                assert low <= m <= high
        for shared in range(1, n + 1):  # a window has at least the bigrams that it shares
            if 2 * shared / (n + shared) >= li.THRESHOLD:
                assert shared >= low
