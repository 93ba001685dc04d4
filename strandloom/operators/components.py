"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.scratch import Scratch


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star step. The least neighbour comes from a map-side combined min and a join, so that a hub's
    neighbours are never gathered in one place and a hub's join partition can be split at run time."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = seen.join(least, "u")
    if both_ways:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, left: str, right: str, scratch: Scratch, most_rounds: int = 64) -> DataFrame:
    """Rows (vertex, component) for every vertex with an edge to another one; component is the smallest vertex reachable.

    Null ends and self-links are ignored, repeated links count once, no links give no rows. Each round is written to
    the shared folder; rounds grow with the logarithm of a component's diameter.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b")
    now = scratch.keep(
        pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    for _ in range(most_rounds):
        state = _signature(now)
        if state == before or not state[0]:
            break
        before = state
        after = scratch.keep(_stars(_stars(now, True), False), "stars")
        scratch.drop(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("vertex")).distinct()
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        roots.select("vertex", F.col("vertex").alias("component"))
    )
