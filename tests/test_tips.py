"""Tips that are taken away by walks over the reads."""

import random

import numpy as np
import pytest

from strandloom.operators import kmers, runs, tips
from strandloom.params import Params
from strandloom.scratch import Scratch
from tests import brute
from tests.test_cycles import dna, loop, table, tangle, without_tips


def number(s):
    return int(s.translate(str.maketrans("ACGT", "0123")), 4)


@pytest.mark.parametrize("k", [4, 9, 13, 23, 30])
def test_runs_are_the_windows_of_texts_by_minimizer(k):
    rng = random.Random(k)
    texts = [dna(rng, k + 1), dna(rng, 300), "A" * 200, "ACG" * 50, dna(rng, k + 2)]
    owner, at, head, tail, n, least = tips.cut([t.encode() for t in texts], k)
    assert (np.diff(owner) >= 0).all() and n.max() <= tips.RUN and (least == runs.minimizers(head, k)).all()
    assert [(o, a) for o, a, m in zip(owner, at, n, strict=True) if not m] == [(i, len(t) - k) for i, t in enumerate(texts)]
    edges, run, step = tips.spread(head, tail, n.astype(np.uint8), k)
    assert [(owner[r], at[r] + s, e) for e, r, s in zip(edges.tolist(), run, step, strict=True)] == [(i, j, number(t[j : j + k + 1])) for i, t in enumerate(texts) for j in range(len(t) - k)]
    assert (runs.minimizers(edges >> 2, k) == least[run]).all()


@pytest.mark.parametrize("k, both, chunk, rounds, links", [(4, False, 1 << 21, 8, 500_000), (9, False, 50, 1, 500_000), (9, False, 1 << 21, 1, 0), (9, True, 1 << 21, 8, 500_000)])
def test_tips_go_to_the_last_by_walks(spark, monkeypatch, k, both, chunk, rounds, links):
    """Equal to brute force, with multiplicities; no edge is counted before the tips are gone, and the edges of cut ends never are."""
    rng = random.Random(k)
    monkeypatch.setattr(kmers, "CHUNK", chunk)
    monkeypatch.setattr(tips, "SPREAD", chunk)
    monkeypatch.setattr(tips, "ROUNDS", rounds)
    monkeypatch.setattr(tips, "MOST_LINKS", links)
    seqs = [*tangle(k), loop(40), dna(rng, 60) + loop(30), *[loop(40)[:20] + dna(rng, n) for n in (5, 90, 400)], (ring := dna(rng, 200)) + ring[:30]]
    line = dna(rng, 500)  # tiled: each read goes on in the next one, the last at a tip
    other = dna(rng, 300) + loop(40)[:20]  # the same, to a loop
    seqs += [*(s[i : i + 40] for s in (line, other) for i in range(0, len(s) - 20, 20)), "ACGT", "AC", "", "NNNN", dna(rng, 30) + "N" + loop(40) + "n" + dna(rng, 30), loop(40)]
    reads = spark.createDataFrame([(s,) for s in [*seqs, None]], "seq string")
    monkeypatch.setattr(kmers, "code_counts", lambda reads, params: table(spark, {}).select("edge", "mult"))
    edges = kmers.build_graph(reads, Params(k=k, both_strands=both))
    mults = brute.edges(seqs, k, both)
    got = tips.reduce_tips(edges, k, Scratch(spark)).collect()
    assert {r.edge: r.mult for r in got} == {e: mults[e] for e in without_tips(mults)} and len(got) == len(without_tips(mults)) > 0
    assert all(r.src == r.edge[:-1] and r.dst == r.edge[1:] for r in got)


def test_tables_that_are_no_whole_graph_of_reads_go_by_edges(spark):
    seqs = [loop(40), dna(random.Random(1), 60)]
    edges = kmers.build_graph(spark.createDataFrame([(s,) for s in seqs], "seq string"), Params(k=9, both_strands=False))
    assert kmers.counted_from(edges)[0] is not None and kmers.counted_from(edges.filter("mult > 1"))[0] is None
    some = edges.filter("mult > 1")
    mults = {e: m for e, m in brute.edges(seqs, 9).items() if m > 1}
    assert {r.edge for r in tips.reduce_tips(some, 9, Scratch(spark)).collect()} == without_tips(mults)


def test_no_reads_no_edges(spark):
    edges = kmers.build_graph(spark.createDataFrame([], "seq string"), Params(k=9))
    assert tips.reduce_tips(edges, 9, Scratch(spark)).count() == 0
