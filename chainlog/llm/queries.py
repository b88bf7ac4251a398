"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, langid, licenses, merkle, mixing, near_dups, packing, preferences, pseudonyms, quality, records, spotsigs, url_filter
from .common import shared_dir, table

#: Vocabulary files, on every worker.
TOKENIZERS = os.environ.get("CHAINLOG_TOKENIZERS") or "/opt/tokenizers"


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pieces_of(packing.pack_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.json", end_id=0))


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = pseudonyms.pseudonymise(docs, counts="replaced")
    return df.select("doc_id", "text", F.to_json("replaced").alias("replaced"))


def op3_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    df = url_filter.judge_urls(pages, url_filter.listed_hosts(spark))
    return df.select("page_id", "host", "path", "rule", "verdict")


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    df = preferences.format_preferences(conversations, preferences.with_other_reply(conversations), pair="conv_id")
    return df.select("pair_id", "section", "part", "first_turn", "n_turns", "text", F.to_json("targets").alias("targets"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spotsigs.fingerprints(table(spark, sf_dir, "documents"))
    return df.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        F.array_join("spots", "").alias("fingerprint"),
        F.array_join("edited_spots", "").alias("edited_fingerprint"),
        spotsigs.likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        spotsigs.likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "records")
    index = records.write_records(table(spark, sf_dir, "documents"), path, f"{TOKENIZERS}/word_bpe_49k.json", end_id=2)
    return records.read_records(index, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_max(F.transform("license_spans", lambda x: F.struct(licenses.weight(x).alias("w"), x["license"].alias("license"), x.alias("x"))))["x"]
    return df.select(
        "doc_id",
        F.size("license_spans").cast("long").alias("n_license_spans"),
        best["license"].alias("license"),
        best["start"].cast("long").alias("start_word"),
        best["n_words"].cast("long").alias("n_words"),
        best["dice"].alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("license_spans", lambda x: x["license"]))), ",").alias("licenses"),
    )


def op9_icws_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = near_dups.near_classes(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "class_id", (F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("is_first"))


def op10_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    df = mixing.take(mixing.sized(docs).select("doc_id", "source", "size"), "doc_id", "source", "size")
    return df.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.digest(*map(F.col, fields[:-1]), lowered))
    df = merkle.proofs(merkle.build(docs, fields, "source", "doc_id", {"tampered": tampered}))
    end = merkle.folded(F.coalesce("tampered", "digest"), F.col("proof"))
    df = df.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", merkle.siblings_digest(F.col("proof")).alias("proof_sha256"), end.alias("folded_root"))
    return df.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op13_byte_cnn_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0)
    model = langid.train(docs.where("NOT held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_vector_packing,
        op2_feistel_pseudonyms,
        op3_bloom_cascade,
        op4_preference_format,
        op5_spotsigs,
        op6_quality_rules,
        op7_record_files,
        op8_license_dice,
        op9_icws_near_dups,
        op10_systematic_mix,
        op11_merkle_manifest,
        op12_source_divergence,
        op13_byte_cnn_lang,
    )
}
