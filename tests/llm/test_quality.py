import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainlog.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": len(w) < 10 or 100 * len(covered) > 20 * len(w),
    }


def check(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.judge(df).orderBy("doc_id").collect():
        assert {k: r[k] for k in slow(None)} == slow(texts[r["doc_id"]]), texts[r["doc_id"]]


@given(st.lists(st.text(alphabet="ab \n\t\u00a0#|é", max_size=120), min_size=20, max_size=40))
@settings(max_examples=4, deadline=None)
def test_measures_against_plain_python(spark, texts):
    check(spark, texts)


def test_edges(spark):
    check(spark, [None, "", " \n\t ", "a b c d", "a b c d e", "a b c d e a b c d e", "x " * 3000, "\n\n", "l\nl\nl\n l", "word " * 4 + "other"])


def test_rules_and_passing_columns(spark):
    good = "the cat and the dog of the house went to the river with some bread"
    rows = [(1, good, 5), (1, good, 5), (2, "# | ** " * 20, 6), (3, None, None), (4, "HELLO WORLD " * 8, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    assert [tuple(r) for r in quality.keep_good(df).collect()] == [rows[0], rows[1]]
    got = {r["doc_id"]: (r["q_kept"], r["n_words"]) for r in quality.judge(df, prefix="q_").collect()}
    assert got == {1: (True, 5), 2: (False, 6), 3: (False, None), 4: (False, 1)}


def test_one_projection_without_python(spark, sf_dir):
    plan = quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_long_text(spark):
    text = " ".join(f"w{i % 7919}" for i in range(200_000))
    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(text).alias("text"))
    r = quality.judge(df).first()
    assert r["n_words"] == 200_000 and r["n_repeat_words"] == 200_000
