"""From the cycles of a start to a repeat and its spacers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import settled, spell, split_on, windows
from strandloom.params import Params


def cycle_groups(cycles: DataFrame, params: Params = Params()) -> DataFrame:
    """groups(start, cycles, n_cycles): a start's cycles without their last nodes, in order; starts with too few are out."""
    if "seq" in cycles.columns:
        # the walks of one start begin alike, so they are in the order of their nodes, and far shorter to gather
        walked = cycles.select("start", F.expr("left(seq, length(seq) - 1)").alias("walk")).groupBy("start")
        groups = walked.agg(F.array_sort(F.collect_list("walk")).alias("walks"), F.count("*").cast("int").alias("n_cycles")).filter(F.col("n_cycles") >= params.min_cycles)
        return settled(groups.select("start", F.transform("walks", lambda w: windows(w, params.k + 1)).alias("cycles"), "n_cycles"), "cycles")
    cut = cycles.select("start", F.slice("nodes", F.lit(1), F.size("nodes") - 1).alias("nodes"))
    groups = cut.groupBy("start").agg(F.array_sort(F.collect_list("nodes")).alias("cycles"), F.count("*").cast("int").alias("n_cycles"))
    return settled(groups.filter(F.col("n_cycles") >= params.min_cycles), "cycles")


def node_support(cycles: DataFrame) -> DataFrame:
    """(start, node, support): in how many cycles of its start a node is."""
    return cycles.select("start", F.explode(F.array_distinct("nodes")).alias("node")).groupBy("start", "node").agg(F.count("*").alias("support"))


def repeat_nodes(groups: DataFrame, params: Params = Params()) -> DataFrame:
    """groups with n_repeat, the nodes that enough cycles share, 1 to params.max_repeat_nodes of them."""
    if params.support == 1.0:
        shared = F.size(F.aggregate("cycles", F.array_distinct(F.col("cycles")[0]), lambda acc, c: F.array_intersect(acc, c)))
        out = settled(groups.withColumn("n_repeat", shared), "n_repeat")
    else:
        nodes = groups.select("start", "n_cycles", F.explode("cycles").alias("nodes")).select("start", "n_cycles", F.explode(F.array_distinct("nodes")).alias("node"))
        counts = nodes.groupBy("start", "n_cycles", "node").agg(F.count("*").alias("n")).filter(F.col("n") >= F.ceil(F.col("n_cycles") * params.support))
        out = groups.join(counts.groupBy("start").agg(F.count("*").cast("int").alias("n_repeat")), "start")
    return out.filter(F.col("n_repeat").between(1, params.max_repeat_nodes))


def repeat_path(groups: DataFrame) -> DataFrame:
    """groups with repeat_nodes: the first n_repeat nodes of the longest cycle, the first in order of those."""
    sizes = F.transform("cycles", lambda c: F.size(c))
    first = F.element_at("cycles", F.array_position(sizes, F.array_max(sizes)).cast("int"))
    return settled(groups.withColumn("repeat_nodes", F.slice(first, F.lit(1), F.col("n_repeat"))), "repeat_nodes")


def spacer_nodes(groups: DataFrame, params: Params = Params()) -> DataFrame:
    """groups with spacer_nodes: what follows the repeat in each cycle that is long enough; groups with too few are out."""
    long = F.filter("cycles", lambda c: F.size(c) - F.col("n_repeat") >= params.min_spacer_nodes)
    cut = F.transform(long, lambda c: F.slice(c, F.col("n_repeat") + 1, F.size(c)))
    return settled(groups.withColumn("spacer_nodes", cut), "spacer_nodes").filter(F.size("spacer_nodes") >= params.min_spacers)


def periods(groups: DataFrame, params: Params = Params()) -> DataFrame:
    """groups with repeat (spelled), periods (one string a cycle, in order) and array_seq (all of them in a row)."""
    spelled = F.transform("cycles", lambda c: spell(c, params.k))
    trimmed = F.array_sort(F.transform(spelled, lambda s: F.substr(s, F.lit(1), F.length(s) - params.trim)))
    out = groups.withColumn("repeat", spell(F.col("repeat_nodes"), params.k)).withColumn("periods", trimmed)
    return settled(settled(out, "repeat", "periods").withColumn("array_seq", F.array_join("periods", "")), "array_seq")


def split_spacers(groups: DataFrame) -> DataFrame:
    """groups with parts: array_seq split on the repeat."""
    return settled(groups.withColumn("parts", split_on(F.col("array_seq"), F.col("repeat"))), "parts")


def filter_spacers(groups: DataFrame, params: Params = Params()) -> DataFrame:
    """groups with spacers, the parts of a fitting length, and n_spacers; groups with too few are out."""
    kept = F.filter("parts", lambda s: F.length(s).between(params.min_spacer_letters, params.max_spacer_letters))
    return settled(groups.withColumn("spacers", kept), "spacers").withColumn("n_spacers", F.size("spacers")).filter(F.col("n_spacers") >= params.min_spacers)


def distinct_repeats(groups: DataFrame) -> DataFrame:
    """One row for each repeat: that with the most spacers, then the least sequence."""
    best = Window.partitionBy("repeat").orderBy(F.desc("n_spacers"), "array_seq", "start")
    return groups.withColumn("_nth", F.row_number().over(best)).filter("_nth = 1").drop("_nth")


def call_arrays(cycles: DataFrame, params: Params = Params()) -> DataFrame:
    """arrays(repeat, array_seq, spacers, n_spacers, start), one row for each distinct repeat."""
    groups = spacer_nodes(repeat_path(repeat_nodes(cycle_groups(cycles, params), params)), params)
    called = filter_spacers(split_spacers(periods(groups, params)), params)
    return distinct_repeats(called).select("repeat", "array_seq", "spacers", "n_spacers", "start")


def spaced_substrings(texts: DataFrame, shortest: int, longest: int, least_gap: int, most_gap: int) -> DataFrame:
    """(id, substring, frequency) of substrings that occur more than once, all gaps between neighbours inside the bounds. texts: (id, text)."""
    cuts = None
    for size in range(shortest, longest + 1):
        # one pass over a text, and no row carries it
        every = F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))
        here = texts.select("id", F.posexplode(every).alias("at", "substring"))
        cuts = here if cuts is None else cuts.unionByName(here)
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("id", "substring").orderBy("at"))
    ok = F.coalesce(gap.between(least_gap, most_gap), F.lit(True))
    return cuts.withColumn("ok", ok).groupBy("id", "substring").agg(F.count("*").alias("frequency"), F.every("ok").alias("ok")).filter("ok and frequency > 1").drop("ok")


def top_spaced_substring(texts: DataFrame, shortest: int, longest: int, least_gap: int, most_gap: int) -> DataFrame:
    """The most frequent of each text's spaced substrings, then the least; texts without any are out."""
    best = Window.partitionBy("id").orderBy(F.desc("frequency"), "substring")
    return spaced_substrings(texts, shortest, longest, least_gap, most_gap).withColumn("_nth", F.row_number().over(best)).filter("_nth = 1").drop("_nth")
