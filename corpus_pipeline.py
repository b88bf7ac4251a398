"""The corpus pipeline: documents to packed sequences, by stages that each write a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlog.llm import mixing, near_dups, packing, pseudonyms, quality
from chainlog.llm.common import table, written
from chainlog.llm.queries import TOKENIZERS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table.

    Null and empty texts have no words and go; very long ones are judged whole; repeated rows are judged each; further columns stay.
    """
    return quality.keep_good(docs)


def near_dup_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id; of equal rows, one.

    Null, empty and blank texts are alike to their equals only; a null id comes last in its class; ties are one row's.
    """
    return near_dups.keep_one(docs)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal numbers, dates and addresses replaced by pseudonyms; n_chars follows.

    A null text stays null, with a null n_chars; an empty one stays empty; repeated rows stay repeated.
    """
    return pseudonyms.pseudonymise(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null texts have size 0 and null sources are one source; ties and repeated rows are ordered by a digest of the row.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 token ids, and where each document's pieces lie.

    Null and empty texts are their end id alone; a text of any length is cut over as many sequences as it needs.
    """
    return packing.pack_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.json", end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dup_removal", near_dup_removal),
    ("pii_pseudonyms", pii_pseudonyms),
    ("source_mix", source_mix),
    ("packed", packed),
]

#: Near-dedup and packing have no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; each stage is written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
