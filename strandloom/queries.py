"""Registered queries of the library's own operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import functions as S
from strandloom.operators import arrays, cycles, graph, kmers, tips
from strandloom.params import Params
from strandloom.plans import find_arrays, search_graph
from strandloom.plans.fixtures import lettered_documents, planted_arrays, planted_reads
from strandloom.scratch import Scratch
from strandloom.settings import settings_report as report_settings
from strandloom.sources import read_fastq, read_graph, read_starts, search_text, sinks

#: Planted reads are searched on the strand they are planted on.
ONE_STRAND = Params(both_strands=False)
K = ONE_STRAND.k
Query = Callable[[SparkSession, str], DataFrame]


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.build_graph(planted_reads(spark, sf_dir), ONE_STRAND)


def _document_edges(spark: SparkSession, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """The edges of the documents; written and in numbers, if there is a place to write to."""
    docs = lettered_documents(spark, sf_dir)
    return kmers.keep_graph(docs, ONE_STRAND, scratch) if scratch else kmers.build_graph(docs, ONE_STRAND)


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of _edges in numbers, written."""
    return kmers.keep_graph(planted_reads(spark, sf_dir), ONE_STRAND, Scratch(spark))


def _named(rows: DataFrame, *edges: str) -> DataFrame:
    """Rows with their numbered edges as letters."""
    return rows.withColumns({name: S.letters(F.col(name), K + 1) for name in edges})


def q_edge_degrees(spark, sf_dir):
    found = _named(graph.degrees(_coded(spark, sf_dir)), "edge")
    return found.withColumns({"src": F.substring("edge", 1, K), "dst": F.substring("edge", 2, K)})


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Scratch]:
    scratch = Scratch(spark)
    return *search_graph(planted_reads(spark, sf_dir), ONE_STRAND, scratch), scratch


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, starts, scratch = _searched(spark, sf_dir)
    return cycles.bounded_cycles(edges, starts, ONE_STRAND, scratch)[0]


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_arrays(planted_reads(spark, sf_dir), ONE_STRAND).cycles


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.repeat_path(arrays.repeat_nodes(arrays.cycle_groups(_kept(spark, sf_dir), ONE_STRAND), ONE_STRAND))


def _walked(found: DataFrame) -> DataFrame:
    """Cycles as the letters that they walk over."""
    return found.select("start", "mult", F.size("mults").cast("long").alias("size"), "seq")


def q_revcomp(spark, sf_dir):
    return planted_arrays(spark, sf_dir).select("nk", "block", S.reverse_complement(F.col("seq")).alias("seq"))


def q_kmer_windows(spark, sf_dir):
    cut = lettered_documents(spark, sf_dir).select("doc_id", S.windows(F.col("seq"), K + 1).alias("w"))
    return cut.select("doc_id", F.size("w").cast("long").alias("n_windows"), F.get("w", F.lit(0)).alias("first_edge"), F.get("w", F.size("w") - 1).alias("last_edge"))


def q_kmer_count_solid(spark, sf_dir):
    rows = kmers.edge_windows(lettered_documents(spark, sf_dir), K)
    return kmers.count_edges(rows, K, 20)


def q_kmer_count_both(spark, sf_dir):
    return kmers.build_graph(planted_reads(spark, sf_dir), Params())


def q_ratio_neighbours(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.ratio_neighbours(edges, cycles.candidates(edges, ONE_STRAND), 30)


def q_invalidate(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.invalidate(edges, cycles.candidates(edges, ONE_STRAND))


def q_tip_reduction(spark, sf_dir):
    """To the last tip, which SQL cannot express: a recursive query deletes nothing."""
    return tips.reduce_tips(_document_edges(spark, sf_dir), K, Scratch(spark))


def q_reachability(spark, sf_dir):
    edges, starts, scratch = _searched(spark, sf_dir)
    found = _named(cycles.reachability(edges, starts, ONE_STRAND.max_cycle, K, scratch), "edge")
    return found.select("edge", F.col("closed_walk").cast("long").alias("closed_walk"))


def q_start_buckets(spark, sf_dir):
    starts = cycles.candidates(_edges(spark, sf_dir), ONE_STRAND)
    return cycles.bucket_sizes(starts)


def q_cycle_cap(spark, sf_dir):
    return _walked(cycles.under_cap(_cycles(spark, sf_dir), 50))


def q_node_support(spark, sf_dir):
    groups = arrays.cycle_groups(_kept(spark, sf_dir), ONE_STRAND)
    return arrays.node_support(groups.select("start", F.explode("cycles").alias("nodes")))


def q_repeat_path(spark, sf_dir):
    groups = _groups(spark, sf_dir)
    return groups.select("start", F.col("n_cycles").cast("long").alias("n_cycles"), F.col("n_repeat").cast("long").alias("n_repeat"), S.spell(F.col("repeat_nodes"), K).alias("repeat"))


def q_spacer_nodes(spark, sf_dir):
    groups = arrays.spacer_nodes(_groups(spark, sf_dir), ONE_STRAND)
    spelled = F.array_sort(F.transform("spacer_nodes", lambda n: S.spell(n, K)))
    return groups.select("start", F.array_join(spelled, ",").alias("spacers"))


def q_period_strings(spark, sf_dir):
    return arrays.periods(_groups(spark, sf_dir), ONE_STRAND).select("start", "repeat", "array_seq")


def q_split_spacers(spark, sf_dir):
    split = arrays.split_spacers(arrays.periods(_groups(spark, sf_dir), ONE_STRAND))
    return split.select("repeat", F.explode("parts").alias("part"))


def q_arrays(spark, sf_dir):
    found = find_arrays(planted_reads(spark, sf_dir), ONE_STRAND).arrays
    return found.select("repeat", "array_seq", F.array_join("spacers", ",").alias("spacers"), F.col("n_spacers").cast("long").alias("n_spacers"))


def q_run_metrics(spark, sf_dir):
    return find_arrays(planted_reads(spark, sf_dir), ONE_STRAND).metrics()


def q_path_report(spark, sf_dir):
    run = find_arrays(planted_reads(spark, sf_dir), ONE_STRAND)
    return sinks.path_report(run.cycles, run.edges, K)


def q_rotate_left(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.split("p_type", " ").alias("words"), "p_size")
    return parts.select("p_partkey", F.array_join(S.rotate_left(F.col("words"), F.col("p_size")), " ").alias("rotated"))


def q_spaced_substrings(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")
    return arrays.spaced_substrings(texts, 5, 7, 8, 60)


def q_top_spaced_substring(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")
    return arrays.top_spaced_substring(texts, 5, 7, 8, 60)


def q_settings_report(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("run_id"), F.col("p_retailprice").alias("ram"), F.lit(1200.0).alias("total_ram"), (F.col("p_size") - 5).alias("threads"), F.lit(32).alias("cores")
    )
    return report_settings(runs)


def q_ratio_predecessors(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    starts = cycles.candidates(edges, ONE_STRAND)
    return graph.ratio_predecessors(edges, starts, 30, visited=starts)


def q_without_predecessor(spark, sf_dir):
    return graph.without_predecessor(_document_edges(spark, sf_dir))


def q_goal_walks(spark, sf_dir):
    """From each start edge to the other start edges that follow within well covered edges."""
    edges = _edges(spark, sf_dir)
    starts = cycles.candidates(edges, ONE_STRAND)
    ends = starts.select(F.col("src").alias("home"), F.col("edge").alias("goal"))
    pairs = graph.successors(edges, 20).join(starts.select("edge"), "edge", "left_semi").select(F.col("edge").alias("start"), F.col("next").alias("goal"))
    pairs = pairs.unionByName(ends.select(F.col("goal").alias("start"), "goal"))
    return graph.goal_walks(edges, pairs, edges.filter("mult >= 20"))


def q_repeat_nodes(spark, sf_dir):
    groups = arrays.repeat_nodes(arrays.cycle_groups(_kept(spark, sf_dir), ONE_STRAND), ONE_STRAND)
    return groups.select("start", F.col("n_repeat").cast("long").alias("n_repeat"))


def q_spell_paths(spark, sf_dir):
    return _kept(spark, sf_dir).select("start", S.spell(F.col("nodes"), K).alias("spelled"))


def q_spacer_filter(spark, sf_dir):
    kept = arrays.filter_spacers(arrays.split_spacers(arrays.periods(_groups(spark, sf_dir), ONE_STRAND)), ONE_STRAND)
    return kept.select("repeat", F.explode("spacers").alias("spacer"))


def _folder(spark: SparkSession) -> str:
    return f"{Scratch(spark).root}/files"


def q_fastq_scan(spark, sf_dir):
    """The planted reads, written as FASTQ and read again."""
    path = _folder(spark)
    rows = planted_reads(spark, sf_dir)
    record = F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")))
    rows.select(record.alias("value")).write.text(path)
    return read_fastq(spark, path, "planted").select("sample_id", F.col("name").cast("long").alias("read_id"), F.col("mate").cast("long").alias("mate"), "seq")


def q_graph_round_trip(spark, sf_dir):
    path = _folder(spark)
    sinks.write_graph(_edges(spark, sf_dir), path)
    return read_graph(spark, path)


def q_graph_delete(spark, sf_dir):
    """Edges that are left of a graph when it is deleted and a smaller one written in its place."""
    path = _folder(spark)
    edges = _edges(spark, sf_dir)
    sinks.write_graph(edges, path)
    sinks.delete_graph(edges, path)
    sinks.write_graph(edges.filter("mult >= 20"), path)
    return read_graph(spark, path)


def q_starts_round_trip(spark, sf_dir):
    path = _folder(spark)
    sinks.write_starts(cycles.candidates(_edges(spark, sf_dir), ONE_STRAND), path)
    return read_starts(spark, path)


def q_array_lines(spark, sf_dir):
    path = _folder(spark)
    sinks.write_arrays(find_arrays(planted_reads(spark, sf_dir), ONE_STRAND).arrays, path)
    return spark.read.text(path).withColumnRenamed("value", "array_seq")


def q_text_search(spark, sf_dir):
    """Lines of the documents, written as text, that hold a string."""
    path = _folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.select(F.explode(F.split("text", "\n", -1)).alias("value")).filter(~F.col("value").contains("\r")).write.text(path)
    found = search_text(spark, path, "tion")
    return found.groupBy("value").agg(F.count("*").alias("n_lines"), F.min("at").cast("long").alias("at"))


QUERIES: dict[str, Query] = {
    "planted_reads": planted_arrays,
    "revcomp": q_revcomp,
    "kmer_windows": q_kmer_windows,
    "kmer_count": _edges,
    "kmer_count_both": q_kmer_count_both,
    "kmer_count_solid": q_kmer_count_solid,
    "kmer_spectrum": lambda s, d: kmers.spectrum(_document_edges(s, d)),
    "drop_singletons": lambda s, d: kmers.drop_rare(_document_edges(s, d)),
    "graph_size": lambda s, d: graph.graph_size(_edges(s, d)),
    "edge_degrees": q_edge_degrees,
    "successors": lambda s, d: _named(graph.successors(_coded(s, d)), "edge", "next"),
    "successors_covered": lambda s, d: _named(graph.successors(_coded(s, d), 20), "edge", "next"),
    "predecessors": lambda s, d: _named(graph.predecessors(_coded(s, d)), "edge", "previous"),
    "predecessors_covered": lambda s, d: _named(graph.predecessors(_coded(s, d), 20), "edge", "previous"),
    "ratio_predecessors": q_ratio_predecessors,
    "without_predecessor": q_without_predecessor,
    "goal_walks": q_goal_walks,
    "fastq_scan": q_fastq_scan,
    "graph_round_trip": q_graph_round_trip,
    "graph_delete": q_graph_delete,
    "starts_round_trip": q_starts_round_trip,
    "array_lines": q_array_lines,
    "text_search": q_text_search,
    "repeat_nodes": q_repeat_nodes,
    "spell_paths": q_spell_paths,
    "spacer_filter": q_spacer_filter,
    "self_loops": lambda s, d: graph.self_loops(_document_edges(s, d)),
    "ratio_neighbours": q_ratio_neighbours,
    "invalidate": q_invalidate,
    "tips": lambda s, d: graph.tips(_document_edges(s, d)),
    "tip_reduction": q_tip_reduction,
    "start_candidates": lambda s, d: cycles.candidates(_edges(s, d), ONE_STRAND),
    "start_buckets": q_start_buckets,
    "reachability": q_reachability,
    "bounded_cycles": lambda s, d: _walked(_cycles(s, d)),
    "cycle_cap": q_cycle_cap,
    "greedy_cycles": lambda s, d: _walked(_kept(s, d)),
    "node_support": q_node_support,
    "repeat_path": q_repeat_path,
    "spacer_nodes": q_spacer_nodes,
    "period_strings": q_period_strings,
    "split_spacers": q_split_spacers,
    "arrays": q_arrays,
    "run_metrics": q_run_metrics,
    "cycle_dump": lambda s, d: sinks.cycle_dump(_kept(s, d), K),
    "path_report": q_path_report,
    "rotate_left": q_rotate_left,
    "spaced_substrings": q_spaced_substrings,
    "top_spaced_substring": q_top_spaced_substring,
    "settings_report": q_settings_report,
}

_TO_DNA = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
_PLANTED = f"""c AS (SELECT c_nationkey AS nk, c_custkey AS ck, (c_custkey - 1) // 1500 AS block FROM customer),
p AS (SELECT nk, block, ck, translate(md5('repeat:' || nk::VARCHAR || ':' || block::VARCHAR), {_TO_DNA}) AS r, translate(md5('spacer:' || ck::VARCHAR), {_TO_DNA}) AS s FROM c),
a AS (SELECT nk, block, any_value(r) || string_agg(s || r, '' ORDER BY ck) AS seq, count(*) AS n FROM p GROUP BY nk, block)"""
_RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"
_CUT = "SELECT substr(seq, i, 24) AS edge FROM (SELECT seq, unnest(range(1, length(seq) - 22)) AS i FROM {reads})"
_COUNT = "SELECT edge, substr(edge, 1, 23) AS src, substr(edge, 2, 23) AS dst, count(*) AS mult FROM w GROUP BY edge"
_EDGES = f"{_PLANTED}, reads AS (SELECT seq FROM a, range(8)), w AS ({_CUT.format(reads='reads')}), e AS ({_COUNT})"
_DOCS = """d AS (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)"""
_DOC_EDGES = f"{_DOCS}, w AS ({_CUT.format(reads='d')}), e AS ({_COUNT})"
_DEGREES = """g AS (SELECT e.edge, e.src, e.dst, e.mult, coalesce(i.n, 0) AS indegree, coalesce(o.n, 0) AS outdegree FROM e
LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) i ON e.src = i.dst LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) o ON e.dst = o.src)"""
_STARTS = f"{_DEGREES}, st AS (SELECT edge, src, dst, mult, indegree, ceil(log2(mult))::INTEGER AS bucket FROM g WHERE indegree >= 2 AND mult >= 20 AND src <> dst)"
# a path is the string it walks over; it holds an edge if that is a part of it
_WALK = f"""WITH RECURSIVE {_EDGES}, {_STARTS}, walk AS (SELECT edge AS start, src AS home, mult, edge AS path, dst, 1 AS size FROM st
UNION ALL SELECT w.start, w.home, w.mult, w.path || substr(e.edge, 24), e.dst, w.size + 1 FROM walk w JOIN e ON e.src = w.dst
WHERE e.edge <> w.start AND w.size < 77 AND NOT contains(w.path, e.edge) AND w.mult // e.mult <= 500),
cy AS (SELECT start, mult, size::BIGINT AS size, path AS seq FROM walk WHERE dst = home AND size BETWEEN 28 AND 77)"""
# one cycle for each planted spacer, from the first letter of the repeat
_TRUTH = f"{_EDGES}, t AS (SELECT nk, r, s, substr(r, 1, 24) AS start, substr(r || s || r, 1, 87) AS seq FROM p), tm AS (SELECT t.*, e.mult FROM t JOIN e ON e.edge = t.start)"
_NODES = "SELECT DISTINCT start, seq, i, substr(seq, i, 24) AS node FROM (SELECT start, seq, unnest(range(1, 65)) AS i FROM tm)"

ORACLES: dict[str, str] = {
    "planted_reads": f"WITH {_PLANTED} SELECT nk, block, seq, n FROM a",
    "revcomp": f"WITH {_PLANTED} SELECT nk, block, {_RC} AS seq FROM a",
    "kmer_windows": f"WITH {_DOCS} SELECT doc_id, greatest(length(seq) - 23, 0)::BIGINT AS n_windows, CASE WHEN length(seq) >= 24 THEN substr(seq, 1, 24) END AS first_edge, CASE WHEN length(seq) >= 24 THEN right(seq, 24) END AS last_edge FROM d",
    "kmer_count": f"WITH {_EDGES} SELECT * FROM e",
    "kmer_count_both": f"WITH {_PLANTED}, reads AS (SELECT seq FROM a, range(8) UNION ALL SELECT {_RC} FROM a, range(8)), w AS ({_CUT.format(reads='reads')}) {_COUNT}",
    "kmer_count_solid": f"WITH {_DOC_EDGES} SELECT * FROM e WHERE mult >= 20",
    "kmer_spectrum": f"WITH {_DOC_EDGES} SELECT ceil(log2(mult))::INTEGER AS bucket, count(*) AS n_edges, sum(mult)::BIGINT AS total FROM e GROUP BY 1",
    "drop_singletons": f"WITH {_DOC_EDGES} SELECT * FROM e WHERE mult > 1",
    "graph_size": f"WITH {_EDGES} SELECT count(*) AS n_edges, (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS n_nodes, sum(mult)::BIGINT AS total FROM e",
    "edge_degrees": f"WITH {_EDGES}, {_DEGREES} SELECT * FROM g",
    "successors": f"WITH {_EDGES} SELECT x.edge, y.edge AS next, y.mult AS next_mult FROM e x JOIN e y ON x.dst = y.src",
    "successors_covered": f"WITH {_EDGES} SELECT x.edge, y.edge AS next, y.mult AS next_mult FROM e x JOIN e y ON x.dst = y.src WHERE y.mult >= 20",
    "predecessors": f"WITH {_EDGES} SELECT x.edge, y.edge AS previous, y.mult AS previous_mult FROM e x JOIN e y ON x.src = y.dst",
    "predecessors_covered": f"WITH {_EDGES} SELECT x.edge, y.edge AS previous, y.mult AS previous_mult FROM e x JOIN e y ON x.src = y.dst WHERE y.mult >= 20",
    "self_loops": f"WITH {_DOC_EDGES} SELECT * FROM e WHERE src = dst",
    "ratio_neighbours": f"WITH {_EDGES}, {_STARTS} SELECT st.edge, e.edge AS next, e.mult AS next_mult FROM st JOIN e ON st.dst = e.src WHERE st.mult // e.mult <= 30 AND st.edge <> e.edge",
    "ratio_predecessors": f"WITH {_EDGES}, {_STARTS} SELECT DISTINCT st.edge, e.edge AS previous, e.mult AS previous_mult FROM st JOIN e ON st.src = e.dst WHERE st.mult // e.mult <= 30 AND st.edge <> e.edge AND e.edge NOT IN (SELECT edge FROM st)",
    "without_predecessor": f"WITH {_DOC_EDGES} SELECT * FROM e WHERE src NOT IN (SELECT dst FROM e)",
    "goal_walks": f"WITH {_EDGES}, {_STARTS} SELECT edge AS start, edge AS goal, 0 AS steps FROM st UNION ALL SELECT st.edge, e.edge, 1 FROM st JOIN e ON st.dst = e.src WHERE e.mult >= 20 AND st.edge <> e.edge",
    "fastq_scan": f"WITH {_PLANTED} SELECT 'planted' AS sample_id, (block * 1000 + nk) * 8 + copy AS read_id, 1::BIGINT AS mate, seq FROM a, range(8) t(copy)",
    "graph_round_trip": f"WITH {_EDGES} SELECT * FROM e",
    "graph_delete": f"WITH {_EDGES} SELECT * FROM e WHERE mult >= 20",
    "starts_round_trip": f"WITH {_EDGES}, {_STARTS} SELECT edge, mult, bucket FROM st",
    "array_lines": f"WITH {_TRUTH} SELECT string_agg(r || s, '' ORDER BY s) AS array_seq FROM tm GROUP BY r",
    "text_search": "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents) SELECT value, count(*) AS n_lines, any_value(instr(value, 'tion'))::BIGINT AS at FROM l WHERE contains(value, 'tion') AND NOT contains(value, chr(13)) GROUP BY value",
    "repeat_nodes": f"WITH {_TRUTH} SELECT start, 9::BIGINT AS n_repeat FROM tm GROUP BY start",
    "spell_paths": f"WITH {_TRUTH} SELECT start, substr(seq, 1, 86) AS spelled FROM tm",
    "spacer_filter": f"WITH {_TRUTH} SELECT substr(r, 1, 31) AS repeat, substr(r, 32, 1) || s AS spacer FROM tm",
    "invalidate": f"WITH {_EDGES}, {_STARTS} SELECT * FROM e WHERE edge NOT IN (SELECT edge FROM st)",
    "tips": f"WITH {_DOC_EDGES} SELECT * FROM e WHERE dst NOT IN (SELECT src FROM e)",
    "start_candidates": f"WITH {_EDGES}, {_STARTS} SELECT * FROM st",
    "start_buckets": f"WITH {_EDGES}, {_STARTS} SELECT bucket, count(*) AS n_starts FROM st GROUP BY bucket",
    "reachability": f"""WITH RECURSIVE {_EDGES}, {_STARTS}, reach AS (SELECT edge AS start, src AS home, dst, 1 AS steps FROM st
UNION SELECT r.start, r.home, e.dst, r.steps + 1 FROM reach r JOIN e ON e.src = r.dst WHERE r.steps < 77 AND r.dst <> r.home)
SELECT start AS edge, min(steps)::BIGINT AS closed_walk FROM reach WHERE dst = home AND steps >= 2 GROUP BY start""",
    "bounded_cycles": f"{_WALK} SELECT * FROM cy",
    "cycle_cap": f"{_WALK} SELECT * FROM cy WHERE start IN (SELECT start FROM cy GROUP BY start HAVING count(*) < 50)",
    "greedy_cycles": f"WITH {_TRUTH} SELECT start, mult, 64::BIGINT AS size, seq FROM tm",
    "node_support": f"WITH {_TRUTH} SELECT start, node, count(*) AS support FROM ({_NODES}) WHERE i < 64 GROUP BY start, node",
    "repeat_path": f"WITH {_TRUTH} SELECT start, count(*) AS n_cycles, 9::BIGINT AS n_repeat, any_value(substr(r, 1, 31)) AS repeat FROM tm GROUP BY start",
    "spacer_nodes": f"WITH {_TRUTH} SELECT start, string_agg(substr(seq, 10, 76), ',' ORDER BY seq) AS spacers FROM tm GROUP BY start",
    "period_strings": f"WITH {_TRUTH} SELECT start, any_value(substr(r, 1, 31)) AS repeat, string_agg(r || s, '' ORDER BY s) AS array_seq FROM tm GROUP BY start",
    "split_spacers": f"WITH {_TRUTH} SELECT substr(r, 1, 31) AS repeat, substr(r, 32, 1) || s AS part FROM tm",
    "arrays": f"WITH {_TRUTH} SELECT substr(r, 1, 31) AS repeat, string_agg(r || s, '' ORDER BY s) AS array_seq, string_agg(substr(r, 32, 1) || s, ',' ORDER BY s) AS spacers, count(*) AS n_spacers FROM tm GROUP BY r",
    "run_metrics": f"""WITH {_TRUTH}, {_STARTS} SELECT 'edges' AS name, count(*) AS value FROM e UNION ALL SELECT 'starts', count(*) FROM st UNION ALL SELECT 'cycles', count(*) FROM tm
UNION ALL SELECT 'arrays', count(DISTINCT r) FROM tm UNION ALL SELECT 'spacers', count(*) FROM tm UNION ALL SELECT 'truncated', 0""",
    "cycle_dump": f"""WITH {_TRUTH}, n AS ({_NODES}), c1 AS (SELECT start, seq, '[' || string_agg(node, ',' ORDER BY i) || ']' AS shown FROM n GROUP BY start, seq)
SELECT start, start || ':' || string_agg(shown, ';' ORDER BY shown) AS line FROM c1 GROUP BY start""",
    "path_report": f"""WITH {_TRUTH}, n AS ({_NODES}), m AS (SELECT n.start, n.seq, n.i, n.node, e.mult FROM n JOIN e ON e.edge = n.node),
z AS (SELECT * FROM m UNION ALL SELECT start, seq, 65 AS i, node, mult FROM m WHERE i = 1)
SELECT start, string_agg(substr(node, 1, 23), ' ' ORDER BY i) AS labels, string_agg(node, ' ' ORDER BY i) AS ids, string_agg(mult::VARCHAR, ' ' ORDER BY i) AS mults FROM z GROUP BY start, seq""",
    "rotate_left": """WITH x AS (SELECT p_partkey, string_split(p_type, ' ') AS w, p_size FROM part), y AS (SELECT p_partkey, w, (p_size % len(w))::BIGINT AS k FROM x)
SELECT p_partkey, array_to_string(list_concat(w[k + 1:], w[:k]), ' ') AS rotated FROM y""",
    "settings_report": """SELECT p_partkey AS run_id, 'ram' AS name, (p_retailprice > 1 AND p_retailprice <= 1200) AS ok, CASE WHEN p_retailprice > 1 AND p_retailprice <= 1200 THEN 'ok' ELSE 'must be above 1 byte and at most the total' END AS message FROM part
UNION ALL SELECT p_partkey, 'threads', (p_size - 5 > 0 AND p_size - 5 <= 32), CASE WHEN p_size - 5 > 0 AND p_size - 5 <= 32 THEN 'ok' ELSE 'must be 1 to the number of cores' END FROM part""",
}
_SPACED = """WITH sz AS (SELECT unnest([5, 6, 7]) AS size), cut AS (SELECT item_id AS id, i AS place, substr(text, i, size) AS substring
FROM (SELECT item_id, text, size, unnest(range(1, length(text) - size + 2)) AS i FROM benchmark, sz)),
gap AS (SELECT id, substring, place - lag(place) OVER (PARTITION BY id, substring ORDER BY place) AS g FROM cut),
ok AS (SELECT id, substring, count(*) AS frequency FROM gap GROUP BY id, substring HAVING count(*) > 1 AND bool_and(coalesce(g BETWEEN 8 AND 60, true)))"""
ORACLES["spaced_substrings"] = f"{_SPACED} SELECT id, substring, frequency FROM ok"
ORACLES["top_spaced_substring"] = f"{_SPACED} SELECT id, substring, frequency FROM ok QUALIFY row_number() OVER (PARTITION BY id ORDER BY frequency DESC, substring) = 1"
