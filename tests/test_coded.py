"""Edge tables in numbers, and plans that hold at any size."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom import functions as S
from strandloom.operators import cycles, graph, kmers, runs
from strandloom.params import Params
from strandloom.plans.fixtures import planted_reads
from strandloom.queries import QUERIES
from strandloom.scratch import Scratch
from tests import brute

ODD = ["ACGTNACGTTGCA0123ACGGT", "", None, "ACG", "acgtacgt", "T" * 12, "ACGTNACGTTGCA0123ACGGT"]


def reads(spark, seqs):
    return spark.createDataFrame([(s,) for s in seqs], "seq string")


@pytest.mark.parametrize("k", [4, 23, 30, 31])
@pytest.mark.parametrize("both", [False, True])
def test_graphs_equal_counted_windows(spark, k, both):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(4)]
    seqs = [*ODD, *seqs, *seqs[:2], "C" + "A" * 70, "T" * 70]
    want = brute.edges([s for s in seqs if s], k, both)
    p = Params(k=k, both_strands=both)
    got = kmers.build_graph(reads(spark, seqs), p).collect()
    assert {r.edge: r.mult for r in got} == want and len(got) == len(want)
    assert all((r.src, r.dst) == (r.edge[:k], r.edge[1:]) for r in got)
    kept = kmers.keep_graph(reads(spark, seqs), p, Scratch(spark), 1)
    if kmers.is_coded(kept):
        kept = kept.select(S.letters(F.col("edge"), k + 1).alias("edge"), S.letters(F.col("src"), k).alias("src"), S.letters(F.col("dst"), k).alias("dst"), "mult")
    assert Counter((r.edge, r.src, r.dst, r.mult) for r in kept.collect()) == Counter((e, e[:k], e[1:], m) for e, m in want.items() if m > 1)


def plan(frame):
    return frame._jdf.queryExecution().toString()


def test_degrees_are_not_broadcast(spark):
    """The size of a graph is not that of the reads that it is built from, by which Spark would choose."""
    edges = kmers.build_graph(reads(spark, ["ACGTACGGTACCAGT" * 4]), Params(k=4))
    assert "Broadcast" not in plan(graph.degrees(edges))
    for frame in (graph.tips(edges), graph.without_predecessor(edges)):
        assert "Broadcast" not in plan(frame)


@pytest.mark.parametrize("least", [1, 20])
@pytest.mark.parametrize("neighbours", [graph.successors, graph.predecessors])
def test_neighbours_are_not_broadcast(spark, neighbours, least):
    edges = kmers.build_graph(reads(spark, ["ACGTACGGTACCAGT" * 4]), Params(k=4))
    assert "Broadcast" not in plan(neighbours(edges, least))


@pytest.mark.parametrize("least", [1, 20])
@pytest.mark.parametrize("name", ["successors", "predecessors"])
def test_queries_of_neighbours_broadcast_nothing_as_they_run(spark, name, least):
    """The plan that ran, after adaptive changes to it; and all pairs are there."""
    found = QUERIES[name if least == 1 else f"{name}_covered"](spark, "/root/testdata/sf0.001")
    got = Counter(tuple(r) for r in found.collect())
    assert "isFinalPlan=true" in plan(found) and "Broadcast" not in plan(found)
    mults = brute.edges([r.seq for r in planted_reads(spark, "/root/testdata/sf0.001").collect()], 23)
    leaving = {e + c for e in mults for c in "ACGT" if e[1:] + c in mults}
    pairs = [(w[:-1], w[1:]) if name == "successors" else (w[1:], w[:-1]) for w in leaving]
    assert got == Counter((a, b, mults[b]) for a, b in pairs if mults[b] >= least) and got


def test_pieces_hold_each_edge_once():
    """One place that has all nodes joins whole runs; a start in the middle of one begins a piece."""
    import numpy as np

    number = lambda s: int(s.translate(str.maketrans("ACGT", "0123")), 4)
    mults = {"ACGTT": 5, "CGTTA": 3, "GTTAC": 4, "TTACC": 6, "TTACG": 2}
    edge = np.array([*map(number, mults), number("GTTAC")], np.int64)
    got = runs.joined(edge, np.array([*mults.values(), 0], np.int64), np.array([3] * 5 + [4]), 4).to_pylist()
    assert sorted((r["first"], r["last"], r["n"], r["tail"], r["min_mult"]) for r in got) == sorted(
        (number(a), number(b), len(t), t, m) for a, b, t, m in [("ACGTT", "CGTTA", "TA", 3), ("GTTAC", "GTTAC", "C", 4), ("TTACC", "TTACC", "C", 6), ("TTACG", "TTACG", "G", 2)]
    )
    assert {r["first"]: r["previous"] for r in got}[number("GTTAC")] is None


def test_cycles_of_edges_too_long_for_numbers(spark):
    rng = random.Random(4)
    body = "".join(rng.choice("ACGT") for _ in range(45))
    one = body + body[:33]
    mults = brute.edges([one] * 30 + ["G" * 9 + body[:34], "T" * 9 + body[:34]] * 3, 31)
    rows = [(e, e[:-1], e[1:], m) for e, m in mults.items() if m > 1]
    edges = spark.createDataFrame(rows, "edge string, src string, dst string, mult long")
    p = Params(k=31)
    starts = cycles.candidates(edges, p)
    names = {r.edge for r in starts.collect()}
    got = {tuple(r.nodes) for r in cycles.bounded_cycles(edges, starts, p)[0].collect()}
    assert got == {c for s in names for c in brute.cycles({e: m for e, _, _, m in rows}, s, 31, 28, 77, 500)} and got
