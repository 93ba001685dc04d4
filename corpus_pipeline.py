"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, packing.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns the frame that, written as Parquet
and read again, is the next one's `docs`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, packing, passages, quality_rules, simhash
from strandloom.llm.queries import table, tokenizer_path
from strandloom.scratch import Scratch

#: The columns of `documents`, with n_chars as in a fresh table: code points of the text.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.drop_rejected(docs).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest id."""
    return simhash.drop_near_duplicates(docs).select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document of a smaller id has too are cut out; documents left without a word go."""
    cut = passages.remove_passages(docs, with_text=True, carry=("lang", "source")).filter("n_words > n_removed").withColumnRenamed("kept", "text")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark windows are cut out; documents left without a word go."""
    clean = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), remove_spans=True)
    clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.filter(~F.col("contaminated") | (F.regexp_replace("text", r"[\x20\x09-\x0D]+", "") != "")).select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Fuzzy passages and tokens cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage but the last is written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = docs
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
            if k:
                scratch.drop(before)
    return docs
