"""Start edges, bounded simple cycles through them, and their greedy selection.

The graph is first compacted to unitigs (unbranched runs of edges): to pieces of them in one exchange (runs.py), then by
pointer jumping over pieces. Paths grow by whole unitigs, so a cycle through a repeat and a spacer takes two or three joins
instead of one for each letter, and the greedy choice can be made among paths of unitigs, too. Only what is kept is spelled,
as the letters that it walks over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import letters, log2_bucket, windows
from strandloom.operators.kmers import coded, is_coded
from strandloom.operators.runs import pieces
from strandloom.operators.turns import choose
from strandloom.params import Params
from strandloom.scratch import Scratch, release


def candidates(edges: DataFrame, params: Params = Params()) -> DataFrame:
    """starts(edge, src, dst, mult, indegree, bucket): well covered edges where paths meet; edges that follow themselves are out."""
    met = edges.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("indegree")).filter(F.col("indegree") >= params.min_start_indegree)
    found = edges.filter((F.col("mult") >= params.min_start_mult) & (F.col("src") != F.col("dst"))).join(met.hint("merge"), "src")
    return found.select("edge", "src", "dst", "mult", "indegree", log2_bucket(F.col("mult")).alias("bucket"))


def bucket_sizes(starts: DataFrame) -> DataFrame:
    return starts.groupBy("bucket").agg(F.count("*").alias("n_starts"))


def unitigs(edges: DataFrame, starts: DataFrame, longest: int, k: int, scratch: Scratch) -> DataFrame:
    """unitigs(id, src, dst, tail, mults, n, min_mult) of at most `longest` edges, written; each start is a first edge.

    An edge joins its only successor if that has no other predecessor. id is the first edge, src and dst are the nodes that
    a unitig runs between, tail and mults are its edges' last letters and multiplicities. Runs that are still open after the
    rounds are longer than `longest` or closed without a branch; neither lies on a bounded cycle through a start.
    """
    parts = scratch.keep(pieces(edges, starts, k), "pieces")
    release(edges.sparkSession)
    placed = scratch.keep(parts.select("last", F.coalesce("previous", "last").alias("at"), F.col("previous").isNotNull().cast("int").alias("steps"), F.col("previous").isNull().alias("done")), "pointers")
    for _ in range(max(1, longest.bit_length())):
        if not placed.filter("not done").limit(1).count():
            break
        jump = placed.select(F.col("last").alias("at"), F.col("at").alias("to"), F.col("steps").alias("more"), F.col("done").alias("ends"))
        moved = placed.filter("not done").join(jump, "at").select("last", F.col("to").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done"))
        after = scratch.keep(placed.filter("done").unionByName(moved), "pointers")
        scratch.drop(placed)
        placed = after
    ended = placed.filter(F.col("done") & (F.col("steps") <= longest)).join(parts, "last").groupBy("at")
    runs = ended.agg(F.array_sort(F.collect_list(F.struct("steps", "first", "last", "tail", "mults"))).alias("run"), F.sum("n").cast("int").alias("n"), F.min("min_mult").alias("min_mult"))
    first, last = F.col("run")[0]["first"], F.element_at("run", -1)["last"]
    ends = (F.shiftright(first, 2), last.bitwiseAND((1 << 2 * k) - 1)) if is_coded(edges) else (F.substring(first, 1, k), F.substring(last, 2, k))
    runs = runs.filter(F.col("n") <= longest).select(
        first.alias("id"), ends[0].alias("src"), ends[1].alias("dst"), F.array_join(F.transform("run", lambda x: x["tail"]), "").alias("tail"),
        F.flatten(F.transform("run", lambda x: x["mults"])).alias("mults"), "n", "min_mult",
    )
    out = scratch.keep(runs, "unitigs")
    for table in (placed, parts):
        scratch.drop(table)
    release(edges.sparkSession)
    return out


def _ways_back(steps: DataFrame, begun: DataFrame, limit: int, max_ratio: int | None, scratch: Scratch) -> DataFrame:
    """(start, at, left): the least number of edges from a node back to the source of each start, `limit` with the start's own at most.

    steps: (id, src, dst, n, min_mult); begun: (start, mult, home, n), a start's unitig, source node and edges.
    """
    within = F.lit(True) if max_ratio is None else F.expr("mult div min_mult") <= max_ratio
    front = scratch.keep(begun.select("start", "mult", F.col("n").alias("own"), F.col("home").alias("at"), F.lit(0).alias("left")), "back")
    seen = scratch.keep(front.select("start", "at", "left"), "ways")
    into = steps.select("id", F.col("src").alias("from"), F.col("dst").alias("at"), F.col("n").alias("more"), "min_mult")
    while True:
        moved = front.join(into, "at").filter((F.col("id") != F.col("start")) & (F.col("own") + F.col("left") + F.col("more") <= limit) & within)
        nearer = moved.groupBy("start", "mult", "own", F.col("from").alias("at")).agg(F.min(F.col("left") + F.col("more")).alias("left"))
        known = seen.withColumnRenamed("left", "known")
        further = scratch.keep(nearer.join(known, ["start", "at"], "left").filter("known is null or left < known").select("start", "mult", "own", "at", "left"), "back")
        scratch.drop(front)
        front = further
        if not front.limit(1).count():
            return seen
        merged = scratch.keep(seen.unionByName(front.select("start", "at", "left")).groupBy("start", "at").agg(F.min("left").alias("left")), "ways")
        scratch.drop(seen)
        seen = merged


def _begun(parts: DataFrame, starts: DataFrame) -> DataFrame:
    return starts.select(F.col("edge").alias("id"), "mult").join(parts, "id").select(F.col("id").alias("start"), "mult", F.col("src").alias("home"), "dst", "n", "min_mult")


def reachability(edges: DataFrame, starts: DataFrame, limit: int, k: int, scratch: Scratch | None = None) -> DataFrame:
    """(edge, closed_walk): the least number of edges of a closed walk through each start, where it is 2 to `limit`."""
    scratch, given = scratch or Scratch(edges.sparkSession), edges
    edges, starts = coded(edges, k), coded(starts, k)
    parts = unitigs(edges, starts, limit, k, scratch).drop("tail", "mults")
    begun = scratch.keep(_begun(parts, starts), "begun")
    back = _ways_back(parts, begun, limit, None, scratch).withColumnRenamed("at", "dst")
    closed = begun.join(back, ["start", "dst"]).select(F.col("start").alias("edge"), (F.col("n") + F.col("left")).alias("closed_walk"))
    closed = closed.withColumn("edge", letters(F.col("edge"), k + 1)) if is_coded(edges) and not is_coded(given) else closed
    return closed.filter(f"closed_walk between 2 and {limit}")


def bounded_cycles(edges: DataFrame, starts: DataFrame, params: Params = Params(), scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """cycles(start, mult, nodes) and truncated(start).

    All simple cycles of params.min_cycle to params.max_cycle nodes through each start, each beginning with it, over
    edges whose multiplicity is at most params.max_ratio times below the start's. A path is followed only while it can
    get back to its start within the length, and holds numbers of unitigs; only closed ones are spelled. Where
    params.max_frontier is set, a start with more open paths stops there with the cycles closed so far, and is in
    truncated.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    paths, parts, given_up = closed_paths(edges, starts, params, scratch)
    out = scratch.keep(walks(paths, parts, params.k), "cycles")
    for table in (paths, parts):
        scratch.drop(table)
    return with_nodes(out, params.k), given_up


def kept_walks(edges: DataFrame, starts: DataFrame, params: Params, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """walks(start, mult, seq, mults) of the cycles that are kept when starts take turns as in greedy, written, and truncated(start).

    Components of unitigs that fit a task are searched there (turns.py); cycles of the others are made and chosen by joins, and
    so are all of them where open paths are limited or edges have no numbers.
    """
    edges, starts = coded(edges, params.k), coded(starts, params.k)
    rest, kept = unitigs(edges, starts, params.max_cycle, params.k, scratch), None
    if params.max_frontier is None and is_coded(edges):
        every = rest
        kept, rest = choose(every, starts, params, scratch)
        scratch.drop(every)
        if not rest.limit(1).count():
            given_up = starts.select(_name(starts, "edge", params.k).alias("start")).limit(0)
            return kept, given_up
    paths, rest, given_up = closed_paths(edges, starts, params, scratch, rest)
    others = scratch.keep(walks(greedy(paths, params, scratch), rest, params.k), "kept")
    for table in (paths, rest):
        scratch.drop(table)
    return others if kept is None else kept.unionByName(others), given_up


def closed_paths(edges: DataFrame, starts: DataFrame, params: Params, scratch: Scratch, parts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """bounded_cycles as paths(start, mult, nodes) of unitigs' ids, the unitigs, and truncated(start).

    Two cycles share an edge if their paths share a unitig, and a start is the id of its unitig; so greedy may have the paths.
    parts: the unitigs, written, if they are there already, or those of some components.
    """
    edges, starts = coded(edges, params.k), coded(starts, params.k)
    parts = parts or unitigs(edges, starts, params.max_cycle, params.k, scratch)
    begun = scratch.keep(_begun(parts, starts).filter(F.expr("mult div min_mult") <= params.max_ratio), "begun")
    back = _ways_back(parts, begun, params.max_cycle, params.max_ratio, scratch)
    way = back.withColumnRenamed("at", "dst")
    front = begun.select("start", "mult", F.array("start").alias("path"), F.col("n").alias("size"), "dst")
    front = scratch.keep(front.join(way, ["start", "dst"]).filter(F.col("size") + F.col("left") <= params.max_cycle), "front")
    closed, truncated = [], None
    steps = parts.select("id", F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("n").alias("more"), "min_mult")
    while front.limit(1).count():
        # back at the source of its start a path is closed; it may also go on, past the start
        closed.append(front)
        going = front
        if params.max_frontier is not None:
            full = scratch.keep(front.groupBy("start").agg(F.count("*").alias("paths")).filter(F.col("paths") > params.max_frontier).select("start"), "full")
            if full.limit(1).count():
                truncated = full if truncated is None else truncated.unionByName(full)
                going = front.join(full, "start", "left_anti")
        moved = going.join(steps, "dst").filter(~F.array_contains("path", F.col("id")) & (F.expr("mult div min_mult") <= params.max_ratio))
        grown = moved.select("start", "mult", F.array_append("path", F.col("id")).alias("path"), (F.col("size") + F.col("more")).alias("size"), F.col("to").alias("dst"))
        front = scratch.keep(grown.join(way, ["start", "dst"]).filter(F.col("size") + F.col("left") <= params.max_cycle), "front")
    found = None
    for table in closed:
        here = table.filter((F.col("left") == 0) & (F.col("size") >= params.min_cycle)).select("start", "mult", "path")
        found = here if found is None else found.unionByName(here)
    found = front.select("start", "mult", "path") if found is None else found
    out = scratch.keep(found.withColumnRenamed("path", "nodes"), "paths")
    given_up = begun.select("start").limit(0) if truncated is None else truncated.distinct()
    given_up = scratch.keep(given_up.select(_name(given_up, "start", params.k).alias("start")), "truncated")
    for table in (*closed, back, begun):
        scratch.drop(table)
    return out, parts, given_up


def _name(rows: DataFrame, edge: str, k: int):
    return letters(F.col(edge), k + 1) if rows.schema[edge].dataType.typeName() == "long" else F.col(edge)


def walks(paths: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """walks(start, mult, seq, mults): the letters that each path of unitigs walks over and the multiplicities of its edges."""
    placed = paths.select("nodes", "mult", F.posexplode("nodes").alias("at", "id")).join(parts.select("id", "tail", "mults"), "id")
    steps = placed.groupBy("nodes", "mult").agg(F.array_sort(F.collect_list(F.struct("at", "tail", "mults"))).alias("steps"))
    start = steps.withColumn("start", F.col("nodes")[0])
    seq = F.concat(F.substring(_name(start, "start", k), 1, k), F.array_join(F.transform("steps", lambda x: x["tail"]), ""))
    return start.select(_name(start, "start", k).alias("start"), "mult", seq.alias("seq"), F.flatten(F.transform("steps", lambda x: x["mults"])).alias("mults"))


def with_nodes(found: DataFrame, k: int) -> DataFrame:
    """Walks as cycles(start, mult, nodes, seq, mults); seq is what stands for the nodes where that is shorter."""
    return found.select("start", "mult", windows(F.col("seq"), k + 1).alias("nodes"), "seq", "mults")


def under_cap(cycles: DataFrame, cap: int) -> DataFrame:
    """Cycles of starts that have fewer than `cap`."""
    few = cycles.groupBy("start").agg(F.count("*").alias("n_cycles")).filter(F.col("n_cycles") < cap).select("start")
    return cycles.join(few, "start", "left_semi")


def greedy(cycles: DataFrame, params: Params = Params(), scratch: Scratch | None = None) -> DataFrame:
    """cycles(start, mult, nodes) that are kept when starts take turns by bucket, multiplicity and edge.

    A start that lies on a kept cycle is passed over; of the others the cycles without a node of a kept cycle count, and
    all of them are kept if there are any and fewer than params.cycle_cap.

    A start's turn depends only on earlier starts that share a node with it. So in each round every start that is the
    first at all its nodes takes its turn at once; cycles that touch what it keeps go, and with them most of what others
    waited for. (Buckets rise with the multiplicity, so that and the edge are the order.)
    """
    scratch = scratch or Scratch(cycles.sparkSession)
    rank = F.struct((-F.col("mult")).alias("order"), F.col("start").alias("name"))
    left = scratch.keep(cycles.select(F.monotonically_increasing_id().alias("cycle"), "start", "mult", "nodes"), "cycles")
    kept = None
    while left.limit(1).count():
        placed = scratch.keep(left.select("cycle", "start", rank.alias("rank"), F.explode("nodes").alias("node")).distinct(), "nodes")
        first = placed.groupBy("node").agg(F.min("rank").alias("first"))
        waiting = placed.join(first, "node").filter("rank > first").select("start").distinct()
        turns = scratch.keep(left.join(waiting, "start", "left_anti"), "turns")
        few = turns.groupBy("start").agg(F.count("*").alias("n")).filter(F.col("n") < params.cycle_cap).select("start")
        taking = scratch.keep(turns.join(few, "start", "left_semi"), "kept")
        kept = taking if kept is None else kept.unionByName(taking)
        taken = taking.select(F.explode("nodes").alias("node")).distinct()
        touched = placed.join(taken, "node", "left_semi").select("cycle").distinct()
        others = left.join(turns.select("start").distinct(), "start", "left_anti").join(taken.withColumnRenamed("node", "start"), "start", "left_anti")
        after = scratch.keep(others.join(touched, "cycle", "left_anti").select("cycle", "start", "mult", "nodes"), "cycles")
        for table in (placed, turns, left):
            scratch.drop(table)
        left = after
    return (left if kept is None else kept).select("start", "mult", "nodes")
