"""Adjacency, degrees and pruning of an edge table.

An edge follows another if its source is the other's destination. Deleted edges are rows that are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import code
from strandloom.scratch import Scratch


def degrees(edges: DataFrame) -> DataFrame:
    """edges with indegree (edges that end in its source) and outdegree (edges that start in its destination).

    Here and below, joins of an edge table with itself are merge joins whatever its size is taken for: a plan over reads
    reckons with the size of the reads, and would send a graph of any size to the driver to broadcast it.
    """
    leaving = edges.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("outdegree")).hint("merge")
    arriving = edges.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("indegree")).hint("merge")
    found = edges.join(leaving, "dst", "left").join(arriving, "src", "left")
    return found.select("edge", "src", "dst", "mult", F.coalesce("indegree", F.lit(0)).alias("indegree"), F.coalesce("outdegree", F.lit(0)).alias("outdegree"))


def successors(edges: DataFrame, least_mult: int = 1) -> DataFrame:
    """(edge, next, next_mult) for each pair of following edges."""
    following = edges.select(F.col("edge").alias("next"), F.col("src").alias("dst"), F.col("mult").alias("next_mult")).filter(F.col("next_mult") >= least_mult)
    return edges.select("edge", "dst").join(following.hint("merge"), "dst").select("edge", "next", "next_mult")


def predecessors(edges: DataFrame, least_mult: int = 1) -> DataFrame:
    """(edge, previous, previous_mult) for each pair of following edges."""
    before = edges.select(F.col("edge").alias("previous"), F.col("dst").alias("src"), F.col("mult").alias("previous_mult")).filter(F.col("previous_mult") >= least_mult)
    return edges.select("edge", "src").join(before.hint("merge"), "src").select("edge", "previous", "previous_mult")


def self_loops(edges: DataFrame) -> DataFrame:
    """Edges that follow themselves."""
    return edges.filter("src = dst")


def ratio_neighbours(edges: DataFrame, starts: DataFrame, max_ratio: int, visited: DataFrame | None = None) -> DataFrame:
    """(edge, next, next_mult) of start edges: successors other than itself, not visited, whose multiplicity is not too far below."""
    mine = starts.select("edge", "dst", F.col("mult").alias("start_mult"))
    following = edges.select(F.col("edge").alias("next"), F.col("src").alias("dst"), F.col("mult").alias("next_mult"))
    if visited is not None:
        following = following.join(visited.select(F.col("edge").alias("next")), "next", "left_anti")
    near = mine.join(following, "dst").filter((F.expr("start_mult div next_mult") <= max_ratio) & (F.col("edge") != F.col("next")))
    return near.select("edge", "next", "next_mult").distinct()


def ratio_predecessors(edges: DataFrame, starts: DataFrame, max_ratio: int, visited: DataFrame | None = None) -> DataFrame:
    """(edge, previous, previous_mult) of start edges: predecessors under the same conditions as ratio_neighbours."""
    mine = starts.select("edge", "src", F.col("mult").alias("start_mult"))
    before = edges.select(F.col("edge").alias("previous"), F.col("dst").alias("src"), F.col("mult").alias("previous_mult"))
    if visited is not None:
        before = before.join(visited.select(F.col("edge").alias("previous")), "previous", "left_anti")
    near = mine.join(before, "src").filter((F.expr("start_mult div previous_mult") <= max_ratio) & (F.col("edge") != F.col("previous")))
    return near.select("edge", "previous", "previous_mult").distinct()


def without_predecessor(edges: DataFrame) -> DataFrame:
    """Edges that follow no edge of the table."""
    return edges.join(edges.select(F.col("dst").alias("src")).distinct().hint("merge"), "src", "left_anti").select("edge", "src", "dst", "mult")


def goal_walks(edges: DataFrame, pairs: DataFrame, inside: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(start, goal, steps): the least number of steps from a start edge to its goal over edges of `inside`.

    pairs: (start, goal), both in `inside` (edge) or the pair has no row; a start is 0 steps from itself. Each round
    writes the edges that are reached first then, and those of a pair whose goal was reached go on no more.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    valid = edges.join(inside.select("edge").distinct(), "edge", "left_semi")
    links = scratch.keep(successors(valid).select("edge", "next"), "links")
    names = valid.select(F.col("edge").alias("at"))
    front = scratch.keep(pairs.select("start", "goal").distinct().withColumn("at", F.col("start")).join(names, "at", "left_semi").withColumn("steps", F.lit(0)), "front")
    seen, found = front, []
    while front.limit(1).count():
        found.append(front.filter("at = goal").select("start", "goal", "steps"))
        moved = front.filter("at <> goal").join(links, F.col("at") == F.col("edge")).select("start", "goal", F.col("next").alias("at"), (F.col("steps") + 1).alias("steps")).distinct()
        front = scratch.keep(moved.join(seen, ["start", "goal", "at"], "left_anti").select("start", "goal", "at", "steps"), "front")
        seen = seen.unionByName(front)
    out = front.select("start", "goal", "steps")
    for rows in found:
        out = out.unionByName(rows)
    return out


def tips(edges: DataFrame) -> DataFrame:
    """Edges without a successor."""
    return edges.join(edges.select(F.col("src").alias("dst")).distinct().hint("merge"), "dst", "left_anti").select("edge", "src", "dst", "mult")


def _run_ends(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(src, at): for each node with one way out, the node where its unbranched run ends; itself if the run is closed.

    Pointers double. A node is settled when it points to the end of its run, and is written once; only the others jump on.
    Of a run that is not closed, some node settles in each round, so what is left when none does is closed.
    """
    ways = links.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("at")).filter("n = 1 and src <> at")
    going, settled, before = scratch.keep(ways.select("src", "at"), "runs"), None, -1
    while (n := going.count()) and n != before:
        before = n
        known = going.select(F.col("src").alias("at"), F.col("at").alias("to"), F.lit(False).alias("ends"))
        if settled is not None:
            known = known.unionByName(settled.select(F.col("src").alias("at"), F.col("at").alias("to"), F.lit(True).alias("ends")))
        moved = scratch.keep(going.join(known, "at", "left").select("src", F.coalesce("to", "at").alias("at"), F.coalesce("ends", F.lit(True)).alias("done")), "jumped")
        new = moved.filter("done").select("src", "at")
        settled = new if settled is None else settled.unionByName(new)
        going = moved.filter("not done").select("src", "at")
    closed = going.select("src", F.col("src").alias("at"))
    return closed if settled is None else settled.unionByName(closed)


def endless(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node): nodes from which a walk over links(src, dst) can go on without end.

    Round by round unbranched runs are contracted to their ends by pointer jumping and ways into nodes without a way out
    are taken away, until there is none; rounds grow with the branchings on a dead end, not with its length.
    """
    links = scratch.keep(links.distinct(), "links")
    contracted = []
    while True:
        ends = scratch.keep(_run_ends(links, scratch), "ends")
        contracted.append(ends)
        to = ends.select(F.col("src").alias("dst"), "at")
        kept = links.join(ends.select("src"), "src", "left_anti").join(to, "dst", "left").select("src", F.coalesce("at", "dst").alias("dst"))
        shorter = scratch.keep(kept.unionByName(ends.filter("src = at").select("src", F.col("at").alias("dst"))).distinct(), "links")
        fewer = scratch.keep(shorter.join(shorter.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "links")
        done = fewer.count() == shorter.count()
        for table in (links, shorter):
            scratch.drop(table)
        links = fewer
        if done:
            break
    alive = links.select(F.col("src").alias("node")).distinct()
    for ends in reversed(contracted):
        more = ends.join(alive.withColumnRenamed("node", "at"), "at", "left_semi").select(F.col("src").alias("node"))
        alive = alive.unionByName(more).distinct()
    return scratch.keep(alive, "endless")


def reduce_tips(edges: DataFrame, k: int, scratch: Scratch | None = None) -> DataFrame:
    """Edges that are left when edges without a successor are taken away again and again, until there are none.

    Nodes have `k` letters; the work is on their numbers, so a shuffled row is two of them.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    left = scratch.keep(edges.withColumn("_dst", code(F.col("dst"), k)), "edges")
    alive = endless(left.select(code(F.col("src"), k).alias("src"), F.col("_dst").alias("dst")), scratch)
    return left.join(alive.withColumnRenamed("node", "_dst"), "_dst", "left_semi").select("edge", "src", "dst", "mult")


def invalidate(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges but those of `gone`."""
    return edges.join(gone.select("edge").distinct(), "edge", "left_anti").select("edge", "src", "dst", "mult")


def graph_size(edges: DataFrame) -> DataFrame:
    """(n_edges, n_nodes, total): distinct edges, distinct ends, windows counted."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).agg(F.countDistinct("node").alias("n_nodes"))
    return edges.agg(F.count("*").alias("n_edges"), F.coalesce(F.sum("mult"), F.lit(0)).alias("total")).crossJoin(F.broadcast(ends)).select("n_edges", "n_nodes", "total")
