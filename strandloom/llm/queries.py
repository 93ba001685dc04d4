"""The subpackage's registered queries: thin wrappers that read a table, apply an operator and derive its columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, language_id, packing, passages, quality_model, quality_rules, sharding, simhash, suffix_dedup, url_filter
from strandloom.llm.oracles import ORACLES

#: Fixed by the query's contract: (host, path, verdict).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = passages.remove_passages(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.size("spans").cast("long").alias("n_spans"), "sources", "kept_sha256")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def _remainder(parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"), learn=_remainder(5) != 0)
    return found.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=_remainder(4) != 2)
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_packing": op3_packing,
        "op4_decontaminate": op4_decontaminate,
        "op5_simhash": op5_simhash,
        "op6_sharding": op6_sharding,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_language_id": op8_language_id,
        "op9_quality_rules": op9_quality_rules,
        "op10_quality_model": op10_quality_model,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
