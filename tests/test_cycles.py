import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom import queries
from strandloom.operators import arrays, cycles, graph, kmers
from strandloom.operators.components import connected_components
from strandloom.params import Params
from strandloom.plans import find_arrays
from strandloom.scratch import Scratch
from tests import brute

SMALL = Params(k=4, both_strands=False, min_cycle=3, max_cycle=14, min_start_mult=2, max_ratio=20)


def table(spark, mults):
    rows = [(e, e[:-1], e[1:], m) for e, m in mults.items()]
    return spark.createDataFrame(rows, "edge string, src string, dst string, mult long")


def tangle(seed, n=14, length=26):
    """Reads that repeat pieces of each other."""
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(3, 9))) for _ in range(5)]
    return ["".join(rng.choice(pieces) for _ in range(length // 6)) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cycles_equal_a_depth_first_search(spark, seed):
    mults = {e: m for e, m in brute.edges(tangle(seed), 4).items() if m > 1}
    edges = table(spark, mults)
    starts = cycles.candidates(edges, SMALL)
    names = {r.edge for r in starts.collect()}
    assert names == brute.starts(mults, 4, 2)
    found, truncated = cycles.bounded_cycles(edges, starts, SMALL)
    got = {(r.start, tuple(r.nodes)) for r in found.collect()}
    assert got == {(s, c) for s in names for c in brute.cycles(mults, s, 4, 3, 14, 20)} and got
    assert truncated.count() == 0
    for start, nodes in got:
        assert nodes[0] == start and len(set(nodes)) == len(nodes)
        assert all(a[1:] == b[:-1] for a, b in zip(nodes, (*nodes[1:], start), strict=True))
    walks = {r.edge: r.closed_walk for r in cycles.reachability(edges, starts, 14, 4).collect()}
    shortest = {s: min(map(len, c)) for s in names if (c := brute.cycles(mults, s, 4, 2, 14, 10**9))}
    assert walks == shortest


def test_truncated_starts_are_reported_and_keep_what_was_closed(spark):
    mults = {e: m for e, m in brute.edges(tangle(1), 4).items() if m > 1}
    edges = table(spark, mults)
    starts = cycles.candidates(edges, SMALL)
    every = {(r.start, tuple(r.nodes)) for r in cycles.bounded_cycles(edges, starts, SMALL)[0].collect()}
    few = Params(**{**SMALL.__dict__, "max_frontier": 1})
    found, truncated = cycles.bounded_cycles(edges, starts, few)
    got = {(r.start, tuple(r.nodes)) for r in found.collect()}
    given_up = {r.start for r in truncated.collect()}
    assert given_up and got < every
    assert {x for x in every if x[0] not in given_up} <= got


def in_turn(rows, cap):
    """The greedy choice, one start after the other."""
    taken, kept = set(), []
    for start, mult in sorted({(s, m) for s, m, _ in rows}, key=lambda x: (-x[1], x[0])):
        own = [n for s, _, n in rows if s == start and taken.isdisjoint(n)]
        if start not in taken and 0 < len(own) < cap:
            kept += [(start, tuple(n)) for n in own]
            taken.update(*own)
    return sorted(kept)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_rounds_equal_turns(spark, seed):
    """One component of many starts and cycles; nodes may be starts, multiplicities tie."""
    rng = random.Random(seed)
    names = [f"n{k:02}" for k in range(40 * (1 + seed))]
    rows = []
    for start in rng.sample(names, 24):
        mult = rng.randrange(20, 30)
        for _ in range(rng.randrange(1, 6)):
            rows.append((start, mult, [start, *rng.sample([n for n in names if n != start], rng.randrange(1, 5))]))
    found = spark.createDataFrame(rows, "start string, mult long, nodes array<string>")
    got = cycles.greedy(found, Params(cycle_cap=5)).collect()
    assert sorted((r.start, tuple(r.nodes)) for r in got) == in_turn(rows, 5)


def loop(n, tail=""):
    """A cycle of n distinct nodes that a second way enters."""
    rng = random.Random(n)
    body = "".join(rng.choice("ACGT") for _ in range(n))
    return body + body[:23] + tail


@pytest.mark.parametrize(("nodes", "kept"), [(27, False), (28, True), (77, True), (78, False)])
def test_cycle_length_bounds(spark, nodes, kept):
    one = loop(nodes)
    seqs = [one + one[23:24]] * 30 + ["T" * 9 + one[:26], "G" * 9 + one[:26]] * 3
    p = Params(both_strands=False)
    edges = kmers.drop_rare(kmers.build_graph(spark.createDataFrame([(s,) for s in seqs], "seq string"), p))
    starts = cycles.candidates(edges, p)
    assert starts.count() >= 1
    assert (cycles.bounded_cycles(edges, starts, p)[0].count() > 0) == kept


@pytest.mark.parametrize(("mult", "is_start"), [(19, False), (20, True)])
def test_start_multiplicity(spark, mult, is_start):
    edges = table(spark, {"ACGTA": mult, "CACGT": 5, "GACGT": 5, "AAAAA": 90, "CAAAA": 3})
    assert ([r.edge for r in cycles.candidates(edges, Params(k=4)).collect()] == ["ACGTA"]) == is_start


@pytest.mark.parametrize(("low", "followed"), [(20, True), (19, False)])
def test_ratio_is_of_whole_numbers(spark, low, followed):
    edges = table(spark, {"ACGTA": 10019, "CGTAC": low})
    starts = edges.filter("edge = 'ACGTA'")
    assert (graph.ratio_neighbours(edges, starts, 500).count() == 1) == followed
    assert graph.ratio_neighbours(edges, starts, 10000, edges.filter("mult < 1000")).count() == 0


@pytest.mark.parametrize(("n", "kept"), [(499, True), (500, False)])
def test_cap_on_cycles(spark, n, kept):
    rows = [("s", 40, ["s", f"a{k}", f"b{k}"]) for k in range(n)]
    found = spark.createDataFrame(rows, "start string, mult long, nodes array<string>")
    assert (cycles.under_cap(found, 500).count() == n) == kept
    assert (cycles.greedy(found).count() == n) == kept


def test_greedy_takes_turns(spark):
    rows = [("s", 100, ["s", "a", "b"]), ("s", 100, ["s", "c", "d"]), ("t", 60, ["t", "a", "e"]), ("t", 60, ["t", "f"]), ("u", 50, ["u", "x"]), ("a", 99, ["a", "z"]), ("v", 70, ["v", "u", "y"])]
    found = spark.createDataFrame(rows, "start string, mult long, nodes array<string>")
    assert sorted((r.start, r.nodes) for r in cycles.greedy(found).collect()) == [("s", ["s", "a", "b"]), ("s", ["s", "c", "d"]), ("t", ["t", "f"]), ("v", ["v", "u", "y"])]
    assert cycles.greedy(found.limit(0)).count() == 0


def test_tips(spark):
    edges = table(spark, {"ACGTA": 1, "CGTAC": 1, "GTACG": 1, "TACGT": 1, "GTACC": 1, "TACCA": 1, "ACCAT": 1})
    assert [r.edge for r in graph.tips(edges).collect()] == ["ACCAT"]
    left = {r.edge for r in graph.reduce_tips(edges, 4).collect()}
    assert left == {"ACGTA", "CGTAC", "GTACG", "TACGT"}
    assert graph.invalidate(edges, edges.limit(2)).count() == 5


def without_tips(mults):
    left = set(mults)
    while True:
        ways = {e[:-1] for e in left}
        fewer = {e for e in left if e[1:] in ways}
        if fewer == left:
            return left
        left = fewer


@pytest.mark.parametrize("seed", range(3))
def test_tips_go_to_the_last(spark, seed):
    rng = random.Random(seed)
    # long dead ends, branched ones, and one that leads to a cycle
    seqs = [*tangle(seed), loop(40), dna(rng, 60) + loop(30), *[loop(40)[:20] + dna(rng, n) for n in (5, 90, 400)]]
    for k in (4, 9):
        mults = brute.edges(seqs, k)
        got = {r.edge for r in graph.reduce_tips(table(spark, mults), k).collect()}
        assert got == without_tips(mults)
        assert k == 4 or len(got) < len(mults)


def test_registered_tip_reduction_goes_to_the_last(spark, monkeypatch):
    mults = brute.edges([dna(random.Random(6), 300), "AC" * 30], 9)
    monkeypatch.setattr(queries, "_document_edges", lambda *a: table(spark, mults))
    assert {r.edge for r in queries.QUERIES["tip_reduction"](spark, "").collect()} == without_tips(mults) != set()


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(120)] + [(2000, 2001 + k) for k in range(200)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b", Scratch(spark)).collect()
    assert {r.vertex: r.component for r in got} == {v: find(v) for v in root}
    assert len(got) == len(root)


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def array(rng, repeat, spacers):
    return repeat + "".join(s + repeat for s in spacers)


@pytest.mark.parametrize("size", [21, 22, 35, 49, 50])
def test_spacer_length_bounds(spark, size):
    """A spacer is reported with the repeat's last letter, so one letter longer; 23 to 50 letters fit."""
    rng = random.Random(size)
    repeat = dna(rng, 30)
    spacers = ["A" + dna(rng, size - 2) + "C", "C" + dna(rng, size - 2) + "G", "G" + dna(rng, size - 2) + "T", "T" + dna(rng, size - 2) + "A"]
    found = find_arrays(spark.createDataFrame([(array(rng, repeat, spacers),)] * 8, "seq string"), Params(both_strands=False)).arrays.collect()
    if 22 <= size <= 47:
        assert [r.repeat for r in found] == [repeat[:-1]]
        assert sorted(found[0].spacers) == sorted(repeat[-1] + s for s in spacers)
    elif size < 22:
        assert found == []


@pytest.mark.parametrize(("n", "called"), [(2, False), (3, True)])
def test_least_spacers(spark, n, called):
    rng = random.Random(1)
    repeat = dna(rng, 32)
    spacers = [f + dna(rng, 30) + f for f in "ACG"[:n]]
    found = find_arrays(spark.createDataFrame([(array(rng, repeat, spacers),)] * 10, "seq string"), Params(both_strands=False))
    assert (found.arrays.count() == 1) == called
    counts = {r.name: r.value for r in found.metrics().collect()}
    assert counts["arrays"] == int(called) and counts["spacers"] == n * called


@pytest.mark.parametrize(("nodes", "kept"), [(26, True), (27, False)])
def test_repeat_size(spark, nodes, kept):
    shared = [f"s{k}" for k in range(nodes)]
    rows = [(shared[0], 40, [*shared, *[f"x{c}_{k}" for k in range(25)]]) for c in range(4)]
    found = spark.createDataFrame(rows, "start string, mult long, nodes array<string>")
    for support in (1.0, 0.9):
        groups = arrays.repeat_nodes(arrays.cycle_groups(found), Params(support=support))
        assert (groups.count() == 1) == kept
    assert arrays.cycle_groups(found.limit(1)).count() == 0


def test_equal_repeats_and_both_strands(spark):
    rng = random.Random(5)
    repeat = dna(rng, 32)
    one = array(rng, repeat, [f + dna(rng, 30) + f for f in "ACGT"])
    found = find_arrays(spark.createDataFrame([(one,)] * 8, "seq string")).arrays.collect()
    assert len(found) == 2 and {r.n_spacers for r in found} == {4}
    groups = spark.createDataFrame([("R", "b", 3, "s1"), ("R", "a", 4, "s2"), ("Q", "c", 3, "s3"), ("R", "0", 4, "s4")], "repeat string, array_seq string, n_spacers int, start string")
    assert sorted((r.repeat, r.array_seq) for r in arrays.distinct_repeats(groups).collect()) == [("Q", "c"), ("R", "0")]


def test_spaced_substrings(spark):
    rng = random.Random(9)
    texts = [(k, dna(rng, 60) + "ACGTT" * (k % 3)) for k in range(12)] + [(50, ""), (51, None)]
    want = {}
    for i, t in texts:
        places = {}
        for size in (3, 4):
            for at in range(len(t or "") - size + 1):
                places.setdefault(t[at : at + size], []).append(at)
        ok = {s: len(p) for s, p in places.items() if len(p) > 1 and all(4 <= b - a <= 30 for a, b in zip(p, p[1:], strict=False))}
        if ok:
            want[i] = ok
    frame = spark.createDataFrame(texts, "id long, text string")
    got = {}
    for r in arrays.spaced_substrings(frame, 3, 4, 4, 30).collect():
        got.setdefault(r.id, {})[r.substring] = r.frequency
    assert got == want
    top = {r.id: r.substring for r in arrays.top_spaced_substring(frame, 3, 4, 4, 30).collect()}
    assert top == {i: min(ok, key=lambda s, ok=ok: (-ok[s], s)) for i, ok in want.items()}


def test_long_texts_take_one_pass(spark):
    rng = random.Random(3)
    seq = dna(rng, 100_000) + "N" + dna(rng, 100_000)
    frame = spark.createDataFrame([(1, seq)], "id long, seq string")
    began = time.perf_counter()
    got = [r.edge for r in kmers.edge_windows(frame, 23).collect()]
    assert got == [seq[i : i + 24] for i in range(len(seq) - 23) if "N" not in seq[i : i + 24]]
    text = "ä😀" + seq[:60] + "😀ä"
    rows = spark.createDataFrame([(1, text + text)], "id long, text string")
    want = {text[i : i + 3] for i in range(len(text) - 2)}
    assert want <= {r.substring for r in arrays.spaced_substrings(rows, 3, 3, 1, 200).collect()}
    assert time.perf_counter() - began < 30


def test_goals_and_edges_without_predecessor(spark):
    mults = brute.edges(tangle(2), 4)
    rng = random.Random(2)
    inside = set(rng.sample(sorted(mults), len(mults) * 3 // 4))
    pairs = [(rng.choice(sorted(mults)), rng.choice(sorted(mults))) for _ in range(40)]
    want = {}
    for a, b in set(pairs):
        front, steps, seen = {a} & inside, 0, set()
        while front and b not in front:
            seen |= front
            front, steps = {e for e in inside for f in front if f[1:] == e[:-1]} - seen, steps + 1
        if front:
            want[a, b] = steps
    edges = table(spark, mults)
    got = graph.goal_walks(edges, spark.createDataFrame(pairs, "start string, goal string"), edges.filter(F.col("edge").isin(*inside)))
    assert {(r.start, r.goal): r.steps for r in got.collect()} == want and want
    assert {r.edge for r in graph.without_predecessor(edges).collect()} == {e for e in mults if e[:-1] not in {x[1:] for x in mults}}
    near = {(r.edge, r.previous) for r in graph.ratio_predecessors(edges, edges, 2).collect()}
    assert near == {(a, b) for a in mults for b in mults if a != b and b[1:] == a[:-1] and mults[a] // mults[b] <= 2}


def test_degrees_and_neighbours(spark):
    mults = brute.edges(tangle(4), 4)
    edges = table(spark, mults)
    into, out = Counter(e[1:] for e in mults), Counter(e[:-1] for e in mults)
    assert {r.edge: (r.indegree, r.outdegree) for r in graph.degrees(edges).collect()} == {e: (into[e[:-1]], out[e[1:]]) for e in mults}
    pairs = {(a, b) for a in mults for b in mults if a[1:] == b[:-1]}
    assert {(r.edge, r.next) for r in graph.successors(edges).collect()} == pairs
    assert {(r.previous, r.edge) for r in graph.predecessors(edges).collect()} == pairs
    assert {(r.edge, r.next) for r in graph.successors(edges, 2).collect()} == {(a, b) for a, b in pairs if mults[b] > 1}
    size = graph.graph_size(edges).first()
    assert (size.n_edges, size.n_nodes, size.total) == (len(mults), len(into.keys() | out.keys()), sum(mults.values()))
    assert F is not None
