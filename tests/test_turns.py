"""The greedy choice inside components."""

import pytest

from strandloom.operators import cycles, kmers, turns
from strandloom.params import Params
from strandloom.scratch import Scratch
from tests import brute
from tests.test_cycles import SMALL, table, tangle


def brute_turns(mults, params):
    """Starts one after the other, each with all its cycles from a search of the whole graph."""
    kept, taken = set(), set()
    names = brute.starts(mults, params.k, params.min_start_mult)
    for start in sorted(names, key=lambda e: (-mults[e], e)):
        found = [c for c in brute.cycles(mults, start, params.k, params.min_cycle, params.max_cycle, params.max_ratio) if not taken & set(c)]
        if start not in taken and len(found) < params.cycle_cap:
            kept |= set(found)
            taken |= {e for c in found for e in c}
    return kept


def walked(found, k):
    return [tuple(r.seq[i : i + k + 1] for i in range(len(r.seq) - k)) for r in found]


@pytest.mark.parametrize("seed, cap", [(1, 500), (2, 2), (3, 5)])
def test_turns_in_components_equal_brute_force_and_joins(spark, seed, cap):
    mults = {e: m for e, m in brute.edges(tangle(seed), 4).items() if m > 1}
    p = Params(**{**SMALL.__dict__, "cycle_cap": cap})
    edges = kmers.coded(table(spark, mults), 4)
    starts = cycles.candidates(edges, p)
    scratch = Scratch(spark)
    parts = cycles.unitigs(edges, starts, p.max_cycle, 4, scratch)
    want = brute_turns(mults, p)
    found, rest = turns.choose(parts, starts, p, scratch)
    rows = found.collect()
    assert sorted(walked(rows, 4)) == sorted(want) and not rest.count()
    assert all(r.start == r.seq[:5] and r.mult == mults[r.start] and r.mults == [mults[e] for e in w] for r, w in zip(rows, walked(rows, 4), strict=True))
    paths, more, _ = cycles.closed_paths(edges, starts, p, scratch)
    assert sorted(walked(cycles.walks(cycles.greedy(paths, p, scratch), more, 4).collect(), 4)) == sorted(want)


@pytest.mark.parametrize("limit", [{"most_unitigs": 3}, {"most_steps": 20}])
def test_components_beyond_a_task_are_left_to_the_joins(spark, monkeypatch, limit):
    """Whole either way: what is not searched in a task is in the rest, and kept_walks has both."""
    mults = {e: m for s in (1, 2, 3) for e, m in brute.edges(tangle(s), 4).items() if m > 1}
    mults |= {"AAAAC": 9, "AAACA": 9, "AACAA": 9, "ACAAA": 9, "CAAAA": 9}
    edges = kmers.coded(table(spark, mults), 4)
    starts = cycles.candidates(edges, SMALL)
    choose, left = cycles.choose, []

    def limited(parts, *rest):
        out = choose(parts, *rest, **limit)
        left.append(out[1].count())
        return out

    monkeypatch.setattr(cycles, "choose", limited)
    found, truncated = cycles.kept_walks(edges, starts, SMALL, Scratch(spark))
    assert sorted(walked(found.collect(), 4)) == sorted(brute_turns(mults, SMALL)) and left[0] > 0
    assert truncated.count() == 0


def test_no_starts_no_cycles(spark):
    edges = kmers.coded(table(spark, {"ACGTA": 3, "CGTAC": 3}), 4)
    found, truncated = cycles.kept_walks(edges, cycles.candidates(edges, SMALL), SMALL, Scratch(spark))
    assert found.columns == ["start", "mult", "seq", "mults"] and not found.count() and not truncated.count()


def test_search_stops_at_the_cap():
    """Thirty links in a row of two ways each: 2^30 cycles, of which a start needs to see no more than the cap."""
    unitigs = [(0, 60, 0, 1, 50, 50)]
    for i in range(30):
        unitigs += [(100 + 4 * i + j, 2 * i, 2 * i + 2, 1, 50, None) for j in range(2)]
    assert turns.turns(unitigs, Params()) == []


def test_components_span_batches():
    """A component's rows may come in several batches, and a batch may have several components."""
    import pyarrow as pa

    p = Params(k=4, min_cycle=2, max_cycle=9)
    rows = [(c, 10 * c + i, c * 4 + i, c * 4 + 1 - i, 1, 30, 30 if i == 0 else None, "A", [30]) for c in (1, 2, 3) for i in (0, 1)]
    numbers = [(c, pa.int64()) for c in ("component", "id", "src", "dst", "n", "min_mult", "start_mult")]
    schema = pa.schema([*numbers, ("tail", pa.string()), ("mults", pa.list_(pa.int64()))])
    batch = lambda some: pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in some], schema)
    out = [r for b in turns._chosen(p, 1000)(iter([batch(rows[:3]), batch(rows[3:5]), batch(rows[5:])])) for r in b.to_pylist()]
    assert [(r["component"], r["mult"], r["mults"]) for r in out] == [(c, 30, [30, 30]) for c in (1, 2, 3)]
