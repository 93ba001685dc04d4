"""The greedy choice of cycles inside connected components of unitigs that fit a task.

Cycles of different components share no edge, so a component's starts can take their turns by themselves. A worker gets all
unitigs of a component at once and closes cycles by depth-first search, for the starts that are still free when their turn
comes; cycles of starts that are passed over are never made. Components with too many unitigs, or whose search takes too many
steps, are reported, and go the way of joins (cycles.closed_paths, cycles.greedy).
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.components import connected_components
from strandloom.params import Params
from strandloom.scratch import Scratch, release, shuffle_partitions

#: Unitigs of a component that goes to one worker at most; steps of its search at most; unitigs that a task has about.
MOST_UNITIGS, MOST_STEPS, PLACE = 20_000, 5_000_000, 50_000
#: seq is null for a component that is left to the joins.
CHOSEN = "component long, mult long, seq string, mults array<long>"
_ROWS = ("id", "src", "dst", "n", "min_mult", "start_mult")


def turns(unitigs: list[tuple], params: Params, most_steps: int = MOST_STEPS) -> list[list[int]] | None:
    """The kept cycles of a component, each as places in `unitigs` from its start on; None beyond so many steps.

    unitigs: (id, src, dst, n, min_mult, start_mult), the last None if it is no start. Starts take turns by multiplicity, most
    first, and id. A start on a kept cycle is passed over; of the others' cycles those without a unitig of a kept cycle
    count, and are kept if they are fewer than params.cycle_cap.
    """
    leaving, arriving = defaultdict(list), defaultdict(list)
    for i, (_, src, dst, *_) in enumerate(unitigs):
        leaving[src].append(i)
        arriving[dst].append(i)
    taken, kept, steps = set(), [], 0
    for start in sorted((i for i, u in enumerate(unitigs) if u[5] is not None), key=lambda i: (-unitigs[i][5], unitigs[i][0])):
        _, home, first, size, least, mult = unitigs[start]
        if start in taken or mult // least > params.max_ratio or size > params.max_cycle:
            continue
        # the least number of edges back to the start, over what its cycles may use
        back, near = {}, [(0, home)]
        while near:
            far, node = heapq.heappop(near)
            if node in back:
                continue
            back[node] = far
            for i in arriving[node]:
                steps += 1
                _, before, _, more, least, _ = unitigs[i]
                if i != start and i not in taken and before not in back and size + far + more <= params.max_cycle and mult // least <= params.max_ratio:
                    heapq.heappush(near, (far + more, before))
        if first not in back:
            continue
        path, on, found = [start], {start}, []
        if first == home and size >= params.min_cycle:
            found.append([start])
        ways, sizes = [iter(leaving[first])], [size]
        while ways and len(found) < params.cycle_cap:
            i = next(ways[-1], None)
            if i is None:
                ways.pop()
                sizes.pop()
                on.discard(path.pop())
                continue
            steps += 1
            if steps > most_steps:
                return None
            _, _, to, more, least, _ = unitigs[i]
            size = sizes[-1] + more
            if i in on or i in taken or to not in back or size + back[to] > params.max_cycle or mult // least > params.max_ratio:
                continue
            path.append(i)
            if to == home and size >= params.min_cycle:
                # back at its source a path is closed; it may also go on
                found.append(path.copy())
            on.add(i)
            ways.append(iter(leaving[to]))
            sizes.append(size)
        if len(found) < params.cycle_cap:
            kept.extend(found)
            taken.update(i for cycle in found for i in cycle)
    return kept


def _letters(number: int, n: int) -> str:
    return "".join("ACGT"[number >> 2 * at & 3] for at in range(n - 1, -1, -1))


def _chosen(params: Params, most_steps: int):
    def one(component: int, rows: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
        columns = [rows.column(c).to_pylist() for c in _ROWS]
        kept = turns(list(zip(*columns, strict=True)), params, most_steps)
        if kept is None:
            return pa.RecordBatch.from_arrays([pa.array([component]), pa.array([None], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.list_(pa.int64()))], names=["component", "mult", "seq", "mults"])
        tails, lists = rows.column("tail").to_pylist(), rows.column("mults").combine_chunks()
        held, offsets = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        heads = {i: _letters(columns[1][i], params.k) for i in {c[0] for c in kept}}
        walked = [np.concatenate([held[offsets[i] : offsets[i + 1]] for i in c]) for c in kept]
        places = np.concatenate([[0], np.cumsum([len(w) for w in walked])]).astype(np.int32)
        mults = pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate([*walked, np.zeros(0, np.int64)]).astype(np.int64)))
        seqs = pa.array([heads[c[0]] + "".join(tails[i] for i in c) for c in kept], pa.string())
        return pa.RecordBatch.from_arrays([pa.array([component] * len(kept), pa.int64()), pa.array([columns[5][c[0]] for c in kept], pa.int64()), seqs, mults], names=["component", "mult", "seq", "mults"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one component, whose rows may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("component").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if held and held[0].column("component")[0].as_py() != names[low]:
                    yield one(held[0].column("component")[0].as_py(), pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(low, high - low))
        if held:
            yield one(held[0].column("component")[0].as_py(), pa.Table.from_batches(held))

    return run


def choose(parts: DataFrame, starts: DataFrame, params: Params, scratch: Scratch, most_unitigs: int = MOST_UNITIGS, most_steps: int = MOST_STEPS) -> tuple[DataFrame, DataFrame]:
    """walks(start, mult, seq, mults) that are kept in the components that fit a task, and the unitigs of all others.

    parts: unitigs in numbers; starts: (edge, mult).
    """
    spark = parts.sparkSession
    named = connected_components(parts, "src", "dst", scratch).select(F.col("vertex").alias("src"), "component")
    sized = parts.join(named.hint("merge"), "src", "left").withColumn("component", F.coalesce("component", "src"))
    begun = starts.select(F.col("edge").alias("id"), F.col("mult").alias("start_mult"))
    sized = scratch.keep(sized.join(begun.hint("merge"), "id", "left"), "components")
    release(spark)
    # components without a start have no cycle to keep
    counts = sized.groupBy("component").agg(F.count("*").alias("n_unitigs"), F.count("start_mult").alias("n_starts")).filter("n_starts > 0")
    large = scratch.keep(counts.filter(F.col("n_unitigs") > most_unitigs).select("component"), "large")
    places = max(shuffle_partitions(spark), sized.count() // PLACE + 1)
    rows = sized.join(large, "component", "left_anti") if large.limit(1).count() else sized
    dealt = rows.select("component", *_ROWS, "tail", "mults").repartition(places, "component").sortWithinPartitions("component")
    found = scratch.keep(dealt.mapInArrow(_chosen(params, most_steps), CHOSEN), "chosen")
    release(spark)
    left = large.unionByName(found.filter("seq is null").select("component"))
    rest = scratch.keep(sized.join(left, "component", "left_semi").select(*parts.columns), "rest")
    for table in (sized, large):
        scratch.drop(table)
    kept = found.filter("seq is not null")
    return kept.select(F.substring("seq", 1, params.k + 1).alias("start"), "mult", "seq", "mults"), rest
