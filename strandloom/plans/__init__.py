"""Whole runs: reads in, arrays out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import arrays, cycles, kmers
from strandloom.params import Params
from strandloom.scratch import Scratch


@dataclass(frozen=True)
class Run:
    """What a run leaves: the searched edges, start edges, kept cycles, arrays, and starts that were given up."""

    edges: DataFrame
    starts: DataFrame
    cycles: DataFrame
    arrays: DataFrame
    truncated: DataFrame

    def metrics(self) -> DataFrame:
        """(name, value) counts of each step."""
        count = lambda name, frame, value: frame.agg(value.cast("long").alias("value")).select(F.lit(name).alias("name"), "value")
        out = count("spacers", self.arrays, F.coalesce(F.sum("n_spacers"), F.lit(0)))
        for name, frame in (("edges", self.edges), ("starts", self.starts), ("cycles", self.cycles), ("arrays", self.arrays), ("truncated", self.truncated)):
            out = out.unionByName(count(name, frame, F.count("*")))
        return out


def search_graph(reads: DataFrame, params: Params, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The edges that are searched and the start edges, both written once, and in numbers where k allows."""
    edges = kmers.keep_graph(reads, params, scratch, params.drop_mult)
    return edges, scratch.keep(cycles.candidates(edges, params), "starts")


def find_arrays(reads: DataFrame, params: Params = Params()) -> Run:
    """reads(seq, ...) to arrays."""
    scratch = Scratch(reads.sparkSession)
    edges, starts = search_graph(reads, params, scratch)
    kept, truncated = cycles.kept_walks(edges, starts, params, scratch)
    kept = cycles.with_nodes(kept, params.k)
    if kmers.is_coded(edges):
        edges, starts = kmers.spelled(edges, params.k), kmers.spelled(starts, params.k, "indegree", "bucket")
    return Run(edges, starts, kept, arrays.call_arrays(kept, params), truncated)
