"""Edge counts over a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators.kmers import count_edges, edge_windows, strands
from strandloom.params import Params


def stream_edges(reads: DataFrame, params: Params = Params()) -> DataFrame:
    """The running edge table of a stream of reads; the state is one count for each edge, partitioned by edge."""
    return count_edges(edge_windows(strands(reads, params.both_strands), params.k), params.k, params.min_edge_count)


def keep_counting(reads: DataFrame, table: str, checkpoint: str, params: Params = Params()) -> StreamingQuery:
    """Writes the running edge table to an in-memory table after each batch that is there."""
    out = stream_edges(reads, params).writeStream.outputMode("complete").format("memory").queryName(table)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
