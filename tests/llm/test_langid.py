"""Language identification: held-out accuracy, gradients against differences, windows and edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chainlog.llm import langid, queries
from chainlog.llm.langid import Net, Sample

SMALL = Net(window=16, widths=(2, 4), filters=3, size=4, epochs=3)


def test_held_out_accuracy(spark):
    """On documents whose ids were not learned from; short ones count as well."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    got = queries.op13_byte_cnn_lang(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert 0.1 < len(held) / len(rows) < 0.3
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    windows, labels = rng.integers(0, 256, (6, SMALL.window)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    model = langid.learned(windows, labels, ["a", "b", "c"], SMALL)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    loss = lambda: -np.log(model.probabilities(windows)[np.arange(6), labels]).mean()
    found = model.gradients(windows, labels)
    for name, w in model.weights.items():
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in w.shape)
            if name == "filters" and not SMALL.alive[at[0], at[2]]:
                assert found[name][at] == w[at] == 0
                continue
            if name == "bytes":
                at = (windows[rng.integers(0, 6), rng.integers(0, SMALL.window)], at[1])
            old, step = w[at], 1e-6
            w[at] = old + step
            up = loss()
            w[at] = old - step
            down = loss()
            w[at] = old
            assert found[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-5)


def test_windows_cover_every_run_of_bytes():
    for n in (0, 1, 3, 12, 13, 14, 15, 16, 100):
        body = bytes(range(1, n + 1))
        windows = langid.cut(body, SMALL)
        places = SMALL.window - max(SMALL.widths) + 1
        starts = [bytes(w[i : i + 4]) for w in windows for i in range(places)]
        assert [s.rstrip(b"\0") for s in starts if s.rstrip(b"\0")] == [body[i : i + 4] for i in range(n)]


def test_batches_do_not_matter(monkeypatch):
    rng = np.random.default_rng(1)
    texts = pd.Series(["abc" * int(n) for n in rng.integers(0, 60, 40)] + ["x" * 5000, None, "", "12", "日本語"])
    windows = rng.integers(97, 123, (40, SMALL.window)).astype(np.uint8)
    model = langid.learned(windows, np.arange(40) % 2, ["aa", "bb"], SMALL)
    whole = pd.concat(langid.predictor(model)(iter([texts])))
    monkeypatch.setattr(langid, "BATCH", 3)
    parts = pd.concat(langid.predictor(model)(iter([texts[:7], texts[7:]])))
    assert list(whole.lang) == list(parts.lang)
    assert np.allclose(whole.score, parts.score)
    assert list(whole.lang[-4:-1]) == [langid.UNKNOWN] * 3 and list(whole.score[-4:-1]) == [0, 0, 0]


TEXTS = [(i, "the cat and the dog of a house", "en", "x") for i in range(30)] + [(i, "der hund und die katze", "de", "x") for i in range(30, 90)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")


def test_edge_cases_and_equal_runs(spark):
    """Nulls, empty and letterless texts, repeats, a long text, a column with the name of a result."""
    more = [(None, None, None, "x"), (1, "", "en", "x"), (2, "123 !?", "de", "x"), (3, "Œ", None, "x"), (3, "Œ", None, "x"), (4, "the dog and " * 50_000, "en", "x"), (5, "\x00\x01", None, "x")]
    df = frame(spark, TEXTS + more)
    runs = []
    for parts in (1, 5):
        model = langid.train(df.repartition(parts))
        assert model.langs == ["de", "en"]
        runs.append(sorted(map(tuple, langid.predict(df, model).select("doc_id", F.length("text"), "lang_pred", F.round("score", 6)).collect()), key=str))
    assert runs[0] == runs[1]
    got = {r[:2]: r[2] for r in runs[0]}
    assert len(runs[0]) == len(TEXTS + more)
    assert got[None, None] == got[1, 0] == got[2, 6] == got[5, 2] == "und"
    assert got[0, 30] == got[4, 600_000] == "en" and got[89, 22] == "de"


def test_sample_is_bounded(spark):
    df = frame(spark, TEXTS)
    rows = langid.sampled(df, "doc_id", "text", "lang", Sample(per_lang=7, total=10, windows=2), 16).collect()
    assert len(rows) == 10 and {r.label for r in rows} == {"de", "en"}
    assert all(len(r.windows) == 2 and len(w) <= 16 for r in rows for w in r.windows)


def test_one_language_or_none(spark):
    df = frame(spark, TEXTS[:5])
    assert {tuple(r) for r in langid.predict(df, langid.train(df)).select("lang_pred", "score").collect()} == {("en", 1.0)}
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert {tuple(r) for r in langid.predict(df, langid.train(none)).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert langid.predict(df.limit(0), langid.train(df.limit(0))).count() == 0
