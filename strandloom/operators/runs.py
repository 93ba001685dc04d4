"""Pieces of unbranched runs, joined in one exchange of a coded graph.

Rows are dealt by the minimizer of a node: the least hash of its words. Neighbours mostly have the same one, so an edge goes to
one place, or to two where its ends differ. A place sees every edge into and out of its nodes, and so knows which of them are
plain; within it, edges are joined over plain nodes by pointer jumping on arrays. What is left to do between places is a
fraction of the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import graph
from strandloom.scratch import Scratch, release, shuffle_partitions

#: Letters of a word; edges that a place has about; bins that are dealt to each place.
WORD, PLACE, BINS = 11, 400_000, 16
_SRC, _DST, _START = 1, 2, 4
PIECES = "last long, first long, previous long, n int, min_mult long, tail string, mults array<long>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def minimizers(nodes: np.ndarray, k: int) -> np.ndarray:
    """The least hash of the words of each node of k letters."""
    word = min(WORD, k)
    nodes, mask, least = nodes.astype(np.uint64), np.uint64((1 << 2 * word) - 1), None
    for at in range(k - word + 1):
        here = _mixed((nodes >> np.uint64(2 * at)) & mask)
        least = here if least is None else np.minimum(least, here)
    return least


def _dealt(k: int, bins: int):
    mask = (1 << 2 * k) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edge, mult, kind = (batch.column(c).to_numpy() for c in ("edge", "mult", "kind"))
            # mixed once more: the least of many hashes are small numbers
            src, dst = (_mixed(minimizers(x, k)) % np.uint64(bins) for x in (edge >> 2, edge & mask))
            here = np.where(kind == _START, _START, np.where(src == dst, _SRC | _DST, _SRC))
            other = np.flatnonzero((src != dst) & (kind != _START))
            columns = [np.concatenate([src, dst[other]]).astype(np.int32), np.concatenate([edge, edge[other]]), np.concatenate([mult, mult[other]])]
            kinds = np.concatenate([here, np.full(len(other), _DST)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(kinds)], names=["bin", "edge", "mult", "kind"])

    return run


def _ring_heads(previous: np.ndarray) -> np.ndarray:
    """The least place of each ring of pointers; -1 ends a run."""
    n = len(previous)
    to = np.where(previous >= 0, previous, np.arange(n))
    least = np.arange(n)
    for _ in range(n.bit_length()):
        least, to = np.minimum(least, least[to]), to[to]
    return np.flatnonzero((previous[to] >= 0) & (least == np.arange(n)))


def joined(edge: np.ndarray, mult: np.ndarray, kind: np.ndarray, k: int, rings: bool = False) -> pa.RecordBatch:
    """PIECES of one place: kind says if it has the edge's source, its destination or both, or marks a start edge.

    rings: closed runs without a branch are pieces, too, cut open at their least edge.
    """
    mask = (1 << 2 * k) - 1
    starts = edge[kind == _START]
    mine = np.flatnonzero(kind & _SRC)
    mine = mine[np.argsort(edge[mine], kind="stable")]
    own, mult = edge[mine], mult[mine]
    src = own >> 2
    into = edge[(kind & _DST) > 0]
    into = into[np.argsort(into & mask, kind="stable")]
    ends = into & mask
    low = np.searchsorted(ends, src)
    entering = np.searchsorted(ends, src, "right") - low
    leaving = np.searchsorted(src, src, "right") - np.searchsorted(src, src)
    head = (entering != 1) | (leaving != 1) | (src == (own & mask)) | np.isin(own, starts)
    before = np.where(head, -1, np.append(into, -1)[np.minimum(low, len(into))])
    at = np.minimum(np.searchsorted(own, before), max(0, len(own) - 1))
    previous = np.where(~head & (own[at] == before), at, -1)
    if rings:
        cut = _ring_heads(previous)
        previous[cut], head[cut] = -1, True
    to = np.where(previous >= 0, previous, np.arange(len(own)))
    steps = (previous >= 0).astype(np.int64)
    for _ in range(len(own).bit_length()):
        further = to[to]
        if (further == to).all():
            break
        steps += steps[to]
        to = further
    # a closed run without a branch has no first edge
    some = np.flatnonzero(previous[to] < 0)
    some = some[np.lexsort((steps[some], to[some]))]
    new = np.flatnonzero(np.diff(to[some], prepend=-1))
    sizes = np.diff(np.append(new, len(some)))
    first, last = some[new], some[new + sizes - 1]
    offsets = pa.py_buffer(np.append(new, len(some)).astype(np.int32))
    tails = pa.StringArray.from_buffers(len(new), offsets, pa.py_buffer(np.frombuffer(b"ACGT", np.uint8)[own[some] & 3].tobytes()))
    mults = pa.ListArray.from_arrays(pa.array(np.append(new, len(some)).astype(np.int32)), pa.array(mult[some]))
    least = np.minimum.reduceat(mult[some], new) if len(new) else mult[:0]
    columns = [pa.array(own[last]), pa.array(own[first]), pa.array(before[first], mask=head[first]), pa.array(sizes.astype(np.int32)), pa.array(least), tails, mults]
    return pa.RecordBatch.from_arrays(columns, names=["last", "first", "previous", "n", "min_mult", "tail", "mults"])


def _joined(k: int, rings: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[batch.column(c).to_numpy() for c in ("edge", "mult", "kind")] for batch in batches if batch.num_rows]
        if rows:
            out = joined(*map(np.concatenate, zip(*rows, strict=True)), k, rings)
            for at in range(0, out.num_rows, 1 << 14):
                yield out.slice(at, 1 << 14)

    return run


def pieces(edges: DataFrame, starts: DataFrame, k: int, rings: bool = False) -> DataFrame:
    """(last, first, previous, n, min_mult, tail, mults): runs of n edges from `first` to `last`, each edge in one run.

    previous: the edge that the run goes on from, null if it is the head of an unbranched run; each start is one. tail has
    the last letter of each edge and mults its multiplicity. Edges of closed runs without a branch may be missing, but for `rings`.
    """
    if edges.schema["edge"].dataType.typeName() != "long":
        return _single(edges, starts, k)
    places = max(shuffle_partitions(edges.sparkSession), edges.count() // PLACE + 1)
    rows = edges.select("edge", "mult", F.lit(0).alias("kind")).unionByName(starts.select("edge", F.lit(0).cast("long").alias("mult"), F.lit(_START).alias("kind")))
    return rows.mapInArrow(_dealt(k, places * BINS), "bin int, edge long, mult long, kind int").repartition(places, "bin").mapInArrow(_joined(k, rings), PIECES)


def _edges(k: int):
    mask = (1 << 2 * k + 2) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.zeros(256, np.int64)
        digits[np.frombuffer(b"ACGT", np.uint8)] = range(4)
        for batch in batches:
            if not batch.num_rows:
                continue
            n, at = batch.column("n").to_numpy().astype(np.int64), batch.column("first").to_numpy()
            letter = digits[np.frombuffer("".join(batch.column("tail").to_pylist()).encode(), np.uint8)]
            begin = np.concatenate([[0], np.cumsum(n)])
            out, going, step = np.empty(begin[-1], np.int64), np.arange(len(n)), 0
            while len(going):
                out[begin[going] + step] = at
                step += 1
                on = n[going] > step
                going, at = going[on], at[on]
                at = (at << 2 | letter[begin[going] + step]) & mask
            yield pa.RecordBatch.from_arrays([pa.array(out), batch.column("mults").flatten()], names=["edge", "mult"])

    return run


def edges_of(parts: DataFrame, k: int) -> DataFrame:
    """(edge, mult) of all edges of coded pieces (first, n, tail, mults)."""
    return parts.select("first", "n", "tail", "mults").mapInArrow(_edges(k), "edge long, mult long")


def _single(edges: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """The same of a graph whose edges have no numbers: each edge is a piece."""
    leaving = edges.groupBy("src").agg(F.count("*").alias("n_leaving"))
    before = edges.select(F.col("edge").alias("entering"), F.col("dst").alias("src"))
    forced = starts.select("edge", F.lit(True).alias("is_start"))
    plain = graph.degrees(edges).join(leaving.hint("merge"), "src").join(forced, "edge", "left").withColumn(
        "is_head", (F.col("indegree") != 1) | (F.col("n_leaving") != 1) | F.coalesce("is_start", F.lit(False)) | (F.col("src") == F.col("dst"))
    )
    others = plain.filter("not is_head").join(before.hint("merge"), "src")
    every = plain.filter("is_head").withColumn("entering", F.lit(None).cast("string")).select("edge", "entering", "mult").unionByName(others.select("edge", "entering", "mult"))
    return every.select(
        F.col("edge").alias("last"), F.col("edge").alias("first"), F.col("entering").alias("previous"), F.lit(1).alias("n"), F.col("mult").alias("min_mult"),
        F.substring("edge", k + 1, 1).alias("tail"), F.array("mult").alias("mults"),
    )


def reduce_tips(edges: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """graph.reduce_tips; of a coded edge table by pieces, which stay or go as a whole, with the node that they end in."""
    if edges.schema["edge"].dataType.typeName() != "long":
        return graph.reduce_tips(edges, k, scratch)
    mask = (1 << 2 * k) - 1
    parts = scratch.keep(pieces(edges, edges.select("edge").limit(0), k, True).withColumn("dst", F.col("last").bitwiseAND(mask)), "pieces")
    release(edges.sparkSession)
    left = graph.endless(parts.select(F.shiftright("first", 2).alias("src"), "dst"), scratch)
    found = edges_of(parts.join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"), k)
    return found.select("edge", F.shiftright("edge", 2).alias("src"), F.col("edge").bitwiseAND(mask).alias("dst"), "mult")
