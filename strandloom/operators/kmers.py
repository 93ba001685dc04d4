"""Reads to counted (k + 1)-letter edges.

An edge table is (edge, src, dst, mult). A coded one has numbers of two bits a letter in place of the three strings, which is
what a whole run shuffles and stores; operators that only compare edges and nodes take either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import code, letters, log2_bucket, reverse_complement, windows
from strandloom.params import Params
from strandloom.scratch import Scratch, release, shuffle_partitions

#: Longest node of a coded edge: k + 1 letters have to fit 62 bits.
MOST_CODED = 30
#: Letters that a worker cuts into windows at once.
CHUNK = 1 << 21
_DIGITS = np.full(256, 4, np.uint8)
_DIGITS[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def strands(reads: DataFrame, both: bool = True) -> DataFrame:
    """The reads, and each one's reverse complement."""
    other = reads.withColumn("seq", reverse_complement(F.col("seq")))
    return reads.unionByName(other) if both else reads


def edge_windows(reads: DataFrame, k: int) -> DataFrame:
    """One row (edge) for each window of k + 1 letters over ACGT."""
    return reads.select(F.explode(windows(F.col("seq"), k + 1)).alias("edge"))


def count_edges(edges: DataFrame, k: int, least: int = 1) -> DataFrame:
    """edges(edge, src, dst, mult). Counts are combined before the one shuffle, which is on the edge."""
    counted = edges.groupBy("edge").agg(F.count("*").alias("mult"))
    counted = counted.filter(F.col("mult") >= least) if least > 1 else counted
    return counted.select("edge", F.substring("edge", 1, k).alias("src"), F.substring("edge", 2, k).alias("dst"), "mult")


def build_graph(reads: DataFrame, params: Params = Params()) -> DataFrame:
    """All edges of a read set; the table knows what it is counted from, until something is done to it."""
    if params.k > MOST_CODED:
        found = count_edges(edge_windows(strands(reads, params.both_strands), params.k), params.k, params.min_edge_count)
    else:
        found = spelled(code_counts(reads, params), params.k)
    found._counted_from = (reads, params)
    return found


def counted_from(edges: DataFrame) -> tuple[DataFrame | None, Params | None]:
    """The reads and parameters that build_graph made the table from; None of another one."""
    return vars(edges).get("_counted_from", (None, None))


def numbered(text: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of `size` letters over ACGT in a text, as numbers, and their places."""
    digits = _DIGITS[np.frombuffer(text, np.uint8)]
    n = len(digits) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    odd = np.concatenate([[0], np.cumsum(digits > 3)])
    power, width, out, done = digits.astype(np.int64) & 3, 1, np.zeros(n, np.int64), 0
    while True:
        if size & width:
            out = out << 2 * width | power[done : done + n]
            done += width
        if 2 * width > size:
            break
        power = power[:-width] << 2 * width | power[width:]
        width *= 2
    at = np.flatnonzero(odd[size:] == odd[:n])
    return out[at], at


def _cut(size: int):
    """(edge, n) of reads (seq, n): counts of equal windows are added up within a chunk."""

    def counted(texts: list[bytes], ns: list[int]) -> pa.RecordBatch:
        edges, at = numbered(b"\n".join(texts), size)
        each = np.array(ns, np.int64)[np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), at, "right")]
        order = np.argsort(edges, kind="stable")
        edges = edges[order]
        new = np.flatnonzero(np.diff(edges, prepend=-1))
        sums = np.add.reduceat(each[order], new) if len(new) else each[:0]
        return pa.RecordBatch.from_arrays([pa.array(edges[new]), pa.array(sums)], names=["edge", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ns, held = [], [], 0
            for seq, n in zip(batch.column("seq"), batch.column("n").to_pylist(), strict=True):
                whole = seq.as_buffer() if seq.is_valid else b""
                for low in range(0, max(0, len(whole) - size + 1), CHUNK):
                    texts.append(bytes(whole[low : low + CHUNK + size - 1]))
                    ns.append(n)
                    held += len(texts[-1])
                    if held >= CHUNK:
                        yield counted(texts, ns)
                        texts, ns, held = [], [], 0
            if texts:
                yield counted(texts, ns)

    return run


def code_counts(reads: DataFrame, params: Params = Params()) -> DataFrame:
    """(edge, mult) of a read set, edges as numbers. Equal reads are cut into windows once."""
    once = reads.groupBy("seq").agg(F.count("*").alias("n")).repartition(shuffle_partitions(reads.sparkSession), "seq")
    cut = strands(once, params.both_strands).mapInArrow(_cut(params.k + 1), "edge long, n long")
    counted = cut.groupBy("edge").agg(F.sum("n").alias("mult"))
    return counted.filter(F.col("mult") >= params.min_edge_count) if params.min_edge_count > 1 else counted


def with_nodes(counts: DataFrame, k: int) -> DataFrame:
    """A coded edge table of (edge, mult)."""
    return counts.select("edge", F.shiftright("edge", 2).alias("src"), F.col("edge").bitwiseAND((1 << 2 * k) - 1).alias("dst"), "mult")


def spelled(counts: DataFrame, k: int, *more: str) -> DataFrame:
    """The edge table of coded (edge, mult), and `more` of its columns."""
    named = counts.select(letters(F.col("edge"), k + 1).alias("edge"), "mult", *more)
    return named.select("edge", F.substring("edge", 1, k).alias("src"), F.substring("edge", 2, k).alias("dst"), "mult", *more)


def is_coded(edges: DataFrame) -> bool:
    return edges.schema["edge"].dataType.typeName() == "long"


def coded(edges: DataFrame, k: int) -> DataFrame:
    """An edge table, or one of start edges, in numbers; as it is where it is already, or where k is too large."""
    if is_coded(edges) or k > MOST_CODED:
        return edges
    numbers = {"edge": code(F.col("edge"), k + 1), "src": code(F.col("src"), k), "dst": code(F.col("dst"), k)}
    return edges.withColumns({name: number for name, number in numbers.items() if name in edges.columns})


def keep_graph(reads: DataFrame, params: Params, scratch: Scratch, at_most: int = 0) -> DataFrame:
    """The written edge table of a read set without edges of `at_most` or fewer, coded if k allows; two columns are stored.

    Plans over it know its size, which those over the reads do not, and do not count again.
    """
    if params.k > MOST_CODED:
        return scratch.keep(drop_rare(build_graph(reads, params), at_most), "edges")
    counts = scratch.keep(drop_rare(code_counts(reads, params), at_most), "edges")
    release(reads.sparkSession)
    return with_nodes(counts, params.k)


def drop_rare(edges: DataFrame, at_most: int = 1) -> DataFrame:
    return edges.filter(F.col("mult") > at_most)


def spectrum(edges: DataFrame) -> DataFrame:
    """(bucket, n_edges, total): edges by ceil(log2(mult))."""
    return edges.groupBy(log2_bucket(F.col("mult")).alias("bucket")).agg(F.count("*").alias("n_edges"), F.sum("mult").alias("total"))
