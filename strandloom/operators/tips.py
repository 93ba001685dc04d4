"""Tips taken away from the graph of a read set, by walks over it.

A read is a walk. Where a node has one way out, every read that passes it goes the same way; so whether a walk can go on without
end is decided at key nodes: those with several ways out, and those where a read ends. What is left of a read is all up to its
last key node that is on an endless walk, and what is left of the graph is the edges of those beginnings. The nodes of a read are
dealt by their minimizers, as runs of windows that share one: a place sees every edge out of its nodes, and finds the key nodes
and their places in reads. A read that comes to a node again is on an endless walk up to there, and so is what leads to it; that
leaves few key nodes open, which are peeled in one task, or by joins where they are too many.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators import graph, kmers, runs
from strandloom.params import Params
from strandloom.scratch import Scratch, release, shuffle_partitions

#: Windows of a run at most, whose letters fit 62 bits; windows that a place has about, and that are spread at once; rows of a batch.
RUN, PLACE, SPREAD, ROWS = 31, 2_000_000, 1 << 20, 1 << 16
#: Rounds in which what leads to an endless walk is marked, at most; links between open key nodes that go to one task at most.
ROUNDS, MOST_LINKS = 8, 500_000
_KINDS = {"head": np.int64, "tail": np.int64, "n": np.uint8, "walk": np.int64, "at": np.int32, "times": np.int64}


def _walks(k: int):
    """(seq, n) of reads: their parts over ACGT with a window at least, long ones cut where both sides share a node."""
    whole = re.compile(rb"[ACGT]{%d,}" % (k + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, ns, held = [], [], 0
            for seq, n in zip(batch.column("seq"), batch.column("n").to_pylist(), strict=True):
                for found in whole.finditer(seq.as_buffer() if seq.is_valid else b""):
                    text = found[0]
                    for low in range(0, len(text) - k, kmers.CHUNK):
                        parts.append(text[low : low + kmers.CHUNK + k].decode())
                        ns.append(n)
                        held += len(parts[-1])
                        if held >= kmers.CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(ns, pa.int64())], names=["seq", "n"])
                            parts, ns, held = [], [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(ns, pa.int64())], names=["seq", "n"])

    return run


def _least(text: bytes, k: int) -> np.ndarray:
    """The minimizer of the node at each place of a text, as runs.minimizers has it; anything where there is no node."""
    word = min(runs.WORD, k)
    digits = kmers._DIGITS[np.frombuffer(text, np.uint8)].astype(np.uint64) & np.uint64(3)
    words = np.zeros(len(digits) - word + 1, np.uint64)
    for at in range(word):
        words = words << np.uint64(2) | digits[at : at + len(words)]
    least, width, span = runs._mixed(words), 1, k - word + 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    return np.minimum(least[: len(least) - (span - width)], least[span - width :])


def cut(texts: list[bytes], k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share a minimizer: owner, at, head, tail, n, minimizer.

    A run begins `at` in its text with node `head` and goes on by the n letters of `tail`. One of no letter is the end of a text.
    """
    text = b"\n".join(texts)
    nodes, places = kmers.numbered(text, k)
    least = _least(text, k)[places]
    counts = np.array([len(t) - k + 1 for t in texts])
    begin = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.empty(len(nodes), bool)
    first[1:] = least[1:] != least[:-1]
    first[begin[:-1]] = first[begin[1:] - 1] = True
    starts = np.flatnonzero(first)
    first |= (np.arange(len(nodes)) - starts[np.cumsum(first) - 1]) % RUN == 0
    starts = np.flatnonzero(first)
    n = np.diff(np.append(starts, len(nodes)))
    n[starts == begin[1:][owner[starts]] - 1] = 0
    tail, going = np.zeros(len(starts), np.int64), np.flatnonzero(n > 0)
    for step in range(1, RUN + 1):
        going = going[n[going] >= step]
        tail[going] = tail[going] << 2 | nodes[starts[going] + step] & 3
    return owner[starts], starts - begin[:-1][owner[starts]], nodes[starts], tail, n, least[starts]


def spread(head: np.ndarray, tail: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges of runs, and the run and the step that each is of."""
    n, mask = n.astype(np.int64), (1 << 2 * k) - 1
    begin = np.concatenate([[0], np.cumsum(n)])
    edges, node, going, step = np.empty(begin[-1], np.int64), head[n > 0], np.flatnonzero(n > 0), 0
    while len(going):
        edge = node << 2 | tail[going] >> 2 * (n[going] - 1 - step) & 3
        edges[begin[going] + step] = edge
        step += 1
        on = n[going] > step
        going, node = going[on], edge[on] & mask
    owner = np.repeat(np.arange(len(n)), n)
    return edges, owner, np.arange(begin[-1]) - begin[owner]


def _dealt(k: int, bins: int, more: tuple[str, ...]):
    """Runs of walks by bin, each column as the bytes of an array; more: walk and at, or times."""
    names = ("head", "tail", "n", *more)

    def dealt(texts: list[bytes], each: list[int]) -> pa.RecordBatch:
        owner, at, head, tail, n, least = cut(texts, k)
        own = np.array(each, np.int64)[owner]
        columns = {"head": head, "tail": tail, "n": n, "walk": own, "at": at, "times": own}
        if "times" in more:  # ends of texts do not count
            some = np.flatnonzero(n)
            columns, least = {name: column[some] for name, column in columns.items()}, least[some]
        place = (runs._mixed(least) % np.uint64(bins)).astype(np.int32)
        order = np.argsort(place, kind="stable")
        place = place[order]
        new = np.flatnonzero(np.diff(place, prepend=-1))
        ends = np.append(new, len(place))
        held = {name: columns[name][order].astype(_KINDS[name]) for name in names}
        blobs = [pa.array([held[name][low:high].tobytes() for low, high in zip(ends, ends[1:])], pa.binary()) for name in names]
        return pa.RecordBatch.from_arrays([pa.array(place[new]), *blobs], names=["bin", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, each, held = [], [], 0
        for batch in batches:
            for seq, one in zip(batch.column("seq"), batch.column("each").to_pylist(), strict=True):
                texts.append(bytes(seq.as_buffer()))
                each.append(one)
                held += len(texts[-1])
                if held >= kmers.CHUNK:
                    yield dealt(texts, each)
                    texts, each, held = [], [], 0
        if texts:
            yield dealt(texts, each)

    return run


def _held(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """All runs of a place, and slices of them of some SPREAD windows."""
    parts = [[] for _ in names]
    for batch in batches:
        for part, name in zip(parts, names, strict=True):
            part.extend(np.frombuffer(blob, _KINDS[name]) for blob in batch.column(name).to_pylist())
    columns = [np.concatenate([np.zeros(0, _KINDS[name]), *part]) for part, name in zip(parts, names, strict=True)]
    ends = np.cumsum(columns[2], dtype=np.int64)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(SPREAD, ends[-1] if len(ends) else 0, SPREAD)), [len(ends)]]))
    return columns, [*zip(cuts.tolist(), cuts[1:].tolist())]


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.flatnonzero(np.diff(values, prepend=-1))]


def _keys(k: int):
    """(walk, at, node): each place of a key node in a walk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (head, tail, n, walk, at), slices = _held(batches, ("head", "tail", "n", "walk", "at"))
        every = np.zeros(0, np.int64)
        for low, high in slices:
            every = _distinct(np.concatenate([every, spread(head[low:high], tail[low:high], n[low:high], k)[0]]))
        src = every >> 2
        ended = n == 0
        keys = _distinct(np.concatenate([src[1:][src[1:] == src[:-1]], head[ended]]))
        del every, src
        if not len(keys):
            return
        out = [(walk[ended], at[ended], head[ended])]
        for low, high in slices:
            edges, owner, step = spread(head[low:high], tail[low:high], n[low:high], k)
            node = edges >> 2
            hit = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, node), len(keys) - 1)] == node)
            owner = owner[hit] + low
            out.append((walk[owner], at[owner] + step[hit].astype(np.int32), node[hit]))
        for columns in out:
            for low in range(0, len(columns[0]), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[low : low + ROWS]) for c in columns], names=["walk", "at", "node"])

    return run


def _spelled(numbers: np.ndarray, n: int) -> np.ndarray:
    """The n letters of each number, a row each."""
    digits = np.empty((len(numbers), n), np.uint8)
    for at in range(n):
        digits[:, at] = numbers >> 2 * (n - 1 - at) & 3
    return np.frombuffer(b"ACGT", np.uint8)[digits]


def _strings(letters: np.ndarray) -> pa.StringArray:
    rows, n = letters.shape
    return pa.StringArray.from_buffers(rows, pa.py_buffer(np.arange(0, (rows + 1) * n, n, dtype=np.int32)), pa.py_buffer(letters.tobytes()))


def _counted(k: int):
    """The edge table of the runs of a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (head, tail, n, times), slices = _held(batches, ("head", "tail", "n", "times"))
        every, mults = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for low, high in slices:
            edges, owner, _ = spread(head[low:high], tail[low:high], n[low:high], k)
            edges, ns = np.concatenate([every, edges]), np.concatenate([mults, times[low:high][owner]])
            order = np.argsort(edges, kind="stable")
            edges = edges[order]
            new = np.flatnonzero(np.diff(edges, prepend=-1))
            every, mults = edges[new], np.add.reduceat(ns[order], new) if len(new) else ns[:0]
        for low in range(0, len(every), ROWS):
            letters = _spelled(every[low : low + ROWS], k + 1)
            columns = [_strings(letters), _strings(letters[:, :-1]), _strings(letters[:, 1:]), pa.array(mults[low : low + ROWS])]
            yield pa.RecordBatch.from_arrays(columns, names=["edge", "src", "dst", "mult"])

    return run


def _peeled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """graph.endless of distinct links(src, dst) that are all here."""
    rows = [[batch.column(c).to_numpy() for c in ("src", "dst")] for batch in batches if batch.num_rows]
    if not rows:
        return
    src, dst = map(np.concatenate, zip(*rows, strict=True))
    names, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    src, dst = at[: len(src)], at[len(src) :]
    ways = np.bincount(src, minlength=len(names))
    src = src[np.argsort(dst, kind="stable")].tolist()
    into = np.concatenate([[0], np.cumsum(np.bincount(dst, minlength=len(names)))]).tolist()
    dead, left = np.flatnonzero(ways == 0).tolist(), ways.tolist()
    while dead:
        node = dead.pop()
        for before in src[into[node] : into[node + 1]]:
            left[before] -= 1
            if not left[before]:
                dead.append(before)
    yield pa.RecordBatch.from_arrays([pa.array(names[np.array(left) > 0])], names=["node"])


def _endless_upto(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(walk, upto): the last place of a walk in keys(walk, at, node) from which a walk can go on without end."""
    again = keys.groupBy("walk", "node").agg(F.min("at").alias("low"), F.max("at").alias("upto")).filter("low < upto")
    upto, before = scratch.keep(again.groupBy("walk").agg(F.max("upto").alias("upto")), "upto"), 0
    for _ in range(ROUNDS):
        sure = scratch.keep(keys.join(upto, "walk").filter("at <= upto").select("node").distinct(), "sure")
        n = sure.count()
        further = scratch.keep(keys.join(sure, "node", "left_semi").groupBy("walk").agg(F.max("at").alias("upto")), "upto")
        for table in (sure, upto):
            scratch.drop(table)
        upto = further
        if n - before <= n // 64:
            break
        before = n
    # whatever the rounds have not marked is open: what lies behind, with all its links but for nodes that are marked elsewhere
    open_keys = scratch.keep(keys.join(upto, "walk", "left").filter("upto is null or at > upto").select("walk", "at", "node"), "open")
    marked = keys.join(upto, "walk").filter("at <= upto").select("node").distinct().join(open_keys.select("node").distinct(), "node", "left_semi")
    following = F.lead("node").over(Window.partitionBy("walk").orderBy("at"))
    links = open_keys.select(F.col("node").alias("src"), following.alias("dst")).filter("dst is not null")
    links = scratch.keep(links.unionByName(marked.select(F.col("node").alias("src"), F.col("node").alias("dst"))).distinct(), "links")
    few = links.count() <= MOST_LINKS
    alive = links.repartition(1).mapInArrow(_peeled, "node long") if few else graph.endless(links, scratch)
    more = open_keys.join(alive, "node", "left_semi").select("walk", F.col("at").alias("upto"))
    return upto.unionByName(more).groupBy("walk").agg(F.max("upto").alias("upto"))


def reduce_tips(edges: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """graph.reduce_tips; by walks over the reads, where the table is the whole graph of a read set and was not counted yet."""
    reads, params = kmers.counted_from(edges)
    if reads is None or params.k != k or k > kmers.MOST_CODED or params.min_edge_count > 1:
        left = runs.reduce_tips(edges, k, scratch)
        return kmers.spelled(left, k) if kmers.is_coded(left) else left
    spark = edges.sparkSession
    once = reads.groupBy("seq").agg(F.count("*").alias("n")).repartition(shuffle_partitions(spark), "seq")
    walks = kmers.strands(once, params.both_strands).mapInArrow(_walks(k), "seq string, n long")
    walks = scratch.keep(walks.withColumn("walk", F.monotonically_increasing_id()), "walks")
    release(spark)
    places = max(shuffle_partitions(spark), (walks.agg(F.sum(F.length("seq"))).first()[0] or 0) // PLACE + 1)
    bins = places * runs.BINS
    dealt = walks.select("seq", F.col("walk").alias("each")).mapInArrow(_dealt(k, bins, ("walk", "at")), "bin int, head binary, tail binary, n binary, walk binary, at binary")
    keys = scratch.keep(dealt.repartition(places, "bin").mapInArrow(_keys(k), "walk long, at int, node long"), "keys")
    release(spark)
    upto = _endless_upto(keys, scratch).filter("upto > 0")
    left = walks.join(upto, "walk").select(F.expr(f"left(seq, upto + {k})").alias("seq"), F.col("n").alias("each"))
    dealt = left.mapInArrow(_dealt(k, bins, ("times",)), "bin int, head binary, tail binary, n binary, times binary")
    return dealt.repartition(places, "bin").mapInArrow(_counted(k), "edge string, src string, dst string, mult long")
