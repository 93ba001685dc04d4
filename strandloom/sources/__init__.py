"""Read sets and stored graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a stored graph.
EDGE_SCHEMA = "edge string, src string, dst string, mult long"


def read_fastq(spark: SparkSession, paths: str | list[str], sample_id: str = "sample") -> DataFrame:
    """reads(sample_id, name, mate, seq) of one (single-end) or two (paired) FASTQ files, plain or gzip.

    A file is split at line breaks before a `+`, which Spark's reader can do in parallel from any place in a plain
    file. The last line of a part is a sequence if the line before it is a header; parts that a quality line starting
    with `+` cuts off have no such pair of lines. Qualities are not kept. Lines may end in CR LF.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not 1 <= len(paths) <= 2:
        raise ValueError("one or two FASTQ files are needed")
    out = None
    for mate, path in enumerate(paths, 1):
        lines = F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\r?\n", -1)
        parts = spark.read.option("lineSep", "\n+").text(path).select(lines.alias("lines")).filter(F.size("lines") >= 2)
        reads = parts.select(F.element_at("lines", -2).alias("head"), F.element_at("lines", -1).alias("seq")).filter(F.col("head").startswith("@"))
        reads = reads.select(F.lit(sample_id).alias("sample_id"), F.substring("head", 2, 1 << 30).alias("name"), F.lit(mate).alias("mate"), F.upper("seq").alias("seq"))
        out = reads if out is None else out.unionByName(reads)
    return out


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """A graph written by sinks.write_graph."""
    return spark.read.schema(EDGE_SCHEMA).parquet(path)


def read_starts(spark: SparkSession, path: str) -> DataFrame:
    """Start edges written by sinks.write_starts."""
    return spark.read.parquet(path).select("edge", "mult", F.col("bucket").cast("int").alias("bucket"))


def search_text(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Lines of a text file that hold a plain string: (value, at), at from 1."""
    return spark.read.text(path).withColumn("at", F.instr("value", pattern)).filter("at > 0")
