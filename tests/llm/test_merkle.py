"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from chainlog.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree string, at long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(root, steps of each node from itself to the root)."""
    steps, held = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held_above = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for j in range(len(run)):
                for i in held[a + j]:
                    steps[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(sha("".join(run)))
            held_above.append([i for h in held[a : a + 16] for i in h])
        nodes, held = above, held_above
    return nodes[0], steps


def slow(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
    inner = [tree([leaf_of(*r) for r in sources[s]]) for s in names]
    root, outer = tree([subroot for subroot, _ in inner])
    out = []
    for s, (subroot, steps), rest in zip(names, inner, outer):
        for r, own in zip(sources[s], steps):
            have = leaf_of(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                have = leaf_of(*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for left, right in own + rest:
                have = sha(left + have + right)
            siblings = sha("".join(left + right for left, right in own + rest))
            out.append((r[0], leaf_of(*r), subroot, root, siblings, have, have == root))
    return sorted(out, key=str)


def run(spark, tmp_path, rows):
    full = [(d, t, lang, s, n, "clash", "clash", 7) for d, s, lang, n, t in rows]
    spark.createDataFrame(full, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op11_merkle_manifest(spark, str(tmp_path))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.collect()), key=str)


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    got = sorted(map(tuple, queries.op11_merkle_manifest(spark, sf_dir).collect()), key=str)
    assert got == slow([tuple(r) for r in docs.collect()])
    assert {r[-1] for r in got} == {True, False}


def test_sources_of_all_sizes_nulls_ties_and_long_texts(spark, tmp_path):
    """A source with most rows and three levels, others of 1, 16, 17 and no name, equal rows, equal ids, one very long text."""
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(600)]
    rows += [(5, "one", None, None, None)]
    rows += [(i, "sixteen", "de", 3, "Ä B") for i in range(16)] + [(i, "seventeen", "de", 3, "") for i in range(17)]
    rows += [(None, None, None, None, None)] * 3 + [(7, None, "en", 1, "A"), (7, None, "en", 1, "B"), (7, None, "en", 1, "A")]
    rows += [(9, "", "", 0, ""), (10, "ü", "x", 1, "A" * 300_000)] + [(11, "same", "x", 1, "S")] * 40
    assert run(spark, tmp_path, rows) == slow(rows)


@pytest.mark.parametrize("n", [1, 2, 300])
def test_one_source(spark, tmp_path, n):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    assert run(spark, tmp_path, rows) == slow(rows)


def test_fields_cannot_run_into_each_other(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("-", "abc"), ("", "abc")], "a string, b string")
    assert df.select(merkle.digest(F.col("a"), F.col("b")).alias("d")).distinct().count() == 5


def test_manifest_of_subsets_and_another_fanout(spark):
    df = spark.range(30).select((F.col("id") % 2).alias("part"), "id")
    m = merkle.build(df, ["id"], "part", "id", fanout=2)
    subsets = {r.subset: r for r in m.subsets().collect()}
    root = m.root().first().root
    assert {k: r.n_rows for k, r in subsets.items()} == {"0": 15, "1": 15}
    assert root == sha(subsets["0"].root + subsets["1"].root)
    proofs = merkle.proofs(m, fanout=2)
    assert proofs.where(merkle.folded(F.col("digest"), F.col("proof")) != F.col("root")).count() == 0
    assert proofs.where(F.size("proof") == 5).count() == 30
    assert proofs.select("key").distinct().count() == 30


def test_empty_table_has_no_root(spark):
    m = merkle.build(spark.createDataFrame([], "id long, part string"), ["id"], "part", "id")
    assert m.root().count() == m.subsets().count() == merkle.proofs(m).count() == 0
