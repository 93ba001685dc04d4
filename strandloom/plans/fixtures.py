"""Reads made from the driver's tables, with known arrays, and documents written in four letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Customer keys that share an array with those of their nation, and copies of each array. Every customer is a spacer, so
#: arrays become more with the table and not longer.
KEYS, COPIES = 1500, 8
_HEX, _DNA = "0123456789abcdef", "ACGTACGTACGTACGT"
_AZ, _AZ_DNA = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def _dna(kind: str, *keys: str):
    return F.translate(F.md5(F.concat_ws(":", F.lit(kind), *(F.col(k).cast("string") for k in keys))), _HEX, _DNA)


def planted_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nk, block, seq, n): for each nation and block of customer keys a repeat, and between its copies a spacer for each customer."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_nationkey").alias("nk"), F.expr(f"(c_custkey - 1) div {KEYS}").alias("block"), F.col("c_custkey").alias("ck")
    )
    parts = rows.select("nk", "block", "ck", _dna("repeat", "nk", "block").alias("r"), _dna("spacer", "ck").alias("s"))
    grouped = parts.groupBy("nk", "block", "r").agg(F.array_sort(F.collect_list(F.struct("ck", "s"))).alias("all"), F.count("*").alias("n"))
    return grouped.select("nk", "block", F.concat("r", F.array_join(F.transform("all", lambda x: F.concat(x["s"], F.col("r"))), "")).alias("seq"), "n")


def planted_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = planted_arrays(spark, sf_dir).select(F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"), "nk", "block", "seq")
    read = (F.col("block") * 1000 + F.col("nk")) * COPIES + F.col("copy")
    return copies.select(F.lit("planted").alias("sample_id"), read.cast("long").alias("read_id"), F.lit(1).alias("mate"), "seq")


def lettered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq): the letters a to z of each document, as A, C, G and T."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), _AZ, _AZ_DNA).alias("seq"))
