"""Writers for graphs, starts, cycles, paths and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import label, windows
from strandloom.scratch import _delete


def write_graph(edges: DataFrame, path: str) -> None:
    edges.select("edge", "src", "dst", "mult").write.mode("overwrite").parquet(path)


def delete_graph(edges: DataFrame, path: str) -> None:
    _delete(edges.sparkSession, path)


def write_starts(starts: DataFrame, path: str) -> None:
    """(edge, mult, bucket), one folder for each bucket."""
    starts.select("edge", "mult", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _shown(nodes: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(nodes, ","), F.lit("]"))


def cycle_dump(cycles: DataFrame, k: int | None = None) -> DataFrame:
    """(start, line): `start:[a,b];[c,d]`, cycles in order of their nodes."""
    if k is not None and "seq" in cycles.columns:
        # gathered as what they walk over
        walks = cycles.groupBy("start").agg(F.collect_list("seq").alias("walks"))
        lines = walks.select("start", F.array_sort(F.transform("walks", lambda w: _shown(windows(w, k + 1)))).alias("all"))
    else:
        lines = cycles.select("start", _shown(F.col("nodes")).alias("shown")).groupBy("start").agg(F.array_sort(F.collect_list("shown")).alias("all"))
    return lines.select("start", F.concat("start", F.lit(":"), F.array_join("all", ";")).alias("line"))


def path_report(cycles: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(start, labels, ids, mults): a closed path's three parallel lines; the first node is repeated at the end.

    Cycles that have the mults of their nodes are not joined with the edges.
    """
    closed = lambda items: F.array_append(items, F.get(items, F.lit(0)))
    if "mults" in cycles.columns:
        paths = cycles.select("start", closed(F.col("nodes")).alias("ids"), closed(F.col("mults")).alias("mults"))
        shown = F.array_join(F.transform("ids", lambda e: label(e, k)), " ").alias("labels")
        return paths.select("start", shown, F.array_join("ids", " ").alias("ids"), F.array_join(F.col("mults").cast("array<string>"), " ").alias("mults"))
    paths = cycles.select("start", F.xxhash64("nodes").alias("path"), closed(F.col("nodes")).alias("nodes"))
    steps = paths.select("start", "path", F.posexplode("nodes").alias("at", "edge")).join(edges.select("edge", "mult"), "edge")
    lists = steps.groupBy("start", "path").agg(F.array_sort(F.collect_list(F.struct("at", "edge", "mult"))).alias("steps"))
    joined = lambda f: F.array_join(F.transform("steps", f), " ")
    return lists.select(
        "start", joined(lambda s: label(s["edge"], k)).alias("labels"), joined(lambda s: s["edge"]).alias("ids"), joined(lambda s: s["mult"].cast("string")).alias("mults")
    )


def write_path_report(report: DataFrame, folder: str) -> None:
    """Appends to three text folders."""
    for name in ("labels", "ids", "mults"):
        report.select(name).write.mode("append").text(f"{folder}/{name}")


def write_arrays(arrays: DataFrame, path: str) -> int:
    """One line for each array, in order; returns the number of spacers."""
    arrays.select("array_seq").orderBy("array_seq").write.mode("overwrite").text(path)
    return arrays.agg(F.sum("n_spacers")).first()[0] or 0
