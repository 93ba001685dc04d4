"""Windows in numbers, and tips that are taken away by pieces."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom import functions as S
from strandloom.operators import kmers, runs
from strandloom.scratch import Scratch
from tests import brute
from tests.test_cycles import dna, loop, table, tangle, without_tips


def number(s):
    return int(s.translate(str.maketrans("ACGT", "0123")), 4)


def test_long_texts_are_cut_with_overlap(monkeypatch):
    monkeypatch.setattr(kmers, "CHUNK", 50)
    seqs = [*(dna(random.Random(n), n) for n in (4, 5, 49, 50, 51, 54, 130, 300)), "", None, "ACGTN" * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(seqs, pa.string()), pa.array([2] * len(seqs), pa.int64())], names=["seq", "n"])
    got = Counter()
    for out in kmers._cut(5)(iter([batch])):
        for r in out.to_pylist():
            got[r["edge"]] += r["n"]
    assert got == {number(e): 2 * m for e, m in brute.edges([s for s in seqs if s], 4).items()}


def test_rings_are_pieces_and_pieces_are_edges():
    mults = brute.edges(["ACGGTCATTGCAACGG", "TTTTT", "CCCCA"], 4)
    import numpy as np

    edge = np.array([*map(number, mults)], np.int64)
    out = runs.joined(edge, np.array([*mults.values()], np.int64), np.array([3] * len(edge)), 4, True)
    assert sorted(out.column("n").to_pylist()) == [1, 1, 12]
    assert 12 not in runs.joined(edge, np.array([*mults.values()], np.int64), np.array([3] * len(edge)), 4).column("n").to_pylist()
    back = [(r["edge"], r["mult"]) for b in runs._edges(4)(iter([out])) for r in b.to_pylist()]
    assert sorted(back) == sorted((number(e), m) for e, m in mults.items())


@pytest.mark.parametrize("k", [4, 9])
def test_tips_go_to_the_last_by_pieces(spark, k):
    rng = random.Random(k)
    seqs = [*tangle(k), loop(40), dna(rng, 60) + loop(30), *[loop(40)[:20] + dna(rng, n) for n in (5, 90, 400)], (ring := dna(rng, 200)) + ring[:30]]
    mults = brute.edges(seqs, k)
    left = runs.reduce_tips(kmers.coded(table(spark, mults), k), k, Scratch(spark))
    got = left.select(S.letters(F.col("edge"), k + 1).alias("edge"), S.letters(F.col("dst"), k).alias("dst"), "mult").collect()
    assert {r.edge for r in got} == without_tips(mults) and len(got) == len(without_tips(mults))
    assert all(r.mult == mults[r.edge] and r.dst == r.edge[1:] for r in got)
