import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandloom import functions as S
from strandloom.operators import kmers
from strandloom.params import Params
from strandloom.sources import read_fastq, read_graph, read_starts, search_text, sinks
from strandloom.streaming import keep_counting
from tests import brute


def reads(spark, seqs):
    return spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "read_id long, seq string")


def random_reads(seed, n=40, length=60):
    rng = random.Random(seed)
    return ["".join(rng.choice("ACGT") for _ in range(rng.randrange(length))) for _ in range(n)] + ["ACGTNACGTTACGA", "", "A" * 30]


@pytest.mark.parametrize("both", [False, True])
def test_edges_equal_a_count_by_hand(spark, both):
    seqs = random_reads(1)
    got = {r.edge: r.mult for r in kmers.build_graph(reads(spark, [*seqs, None]), Params(k=5, both_strands=both)).collect()}
    assert got == brute.edges(seqs, 5, both)


def test_order_and_coverage(spark):
    seqs = random_reads(2)
    p = Params(k=4, both_strands=False)
    once = {r.edge: r.mult for r in kmers.build_graph(reads(spark, seqs), p).collect()}
    thrice = {r.edge: r.mult for r in kmers.build_graph(reads(spark, seqs[::-1] * 3), p).collect()}
    assert thrice == {e: 3 * m for e, m in once.items()}


def test_reverse_complemented_reads_give_the_reverse_complemented_graph(spark):
    seqs = random_reads(3)
    p = Params(k=4, both_strands=False)
    turned = reads(spark, seqs).withColumn("seq", S.reverse_complement(F.col("seq")))
    flip = lambda e: e[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert {flip(r.edge): r.mult for r in kmers.build_graph(turned, p).collect()} == brute.edges(seqs, 4)


def test_short_and_foreign_letters(spark):
    p = Params(both_strands=False)
    assert kmers.build_graph(reads(spark, ["A" * 23]), p).count() == 0
    assert kmers.build_graph(reads(spark, ["ACGT" * 5 + "N" + "ACGT" * 5]), p).count() == 0
    assert kmers.build_graph(reads(spark, ["A" * 30]), p).first().mult == 7


def test_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    items = F.array(*[F.lit(x) for x in "abcd"])
    assert [value(S.rotate_left(items, n)) for n in (0, 1, 5, -1)] == [list("abcd"), list("bcda"), list("bcda"), list("dabc")]
    assert value(S.rotate_left(F.array().cast("array<string>"), 3)) == []
    assert value(S.spell(F.array(F.lit("ACGT"), F.lit("CGTA")), 3)) == "ACGT"[:3] + "T"
    assert value(S.split_on(F.lit("xxAAyAAAz"), F.lit("AA"))) == ["xx", "y", "Az"]
    assert [value(S.log2_bucket(F.lit(n))) for n in (1, 2, 3, 20, 32, 33)] == [0, 1, 2, 5, 5, 6]


def fastq(seqs, newline="\n"):
    quality = lambda k, s: ["+", "@", "I"][k % 3] + "I" * (len(s) - 1)
    return "".join(newline.join([f"@read{k} x", s, "+" if k % 2 else f"+read{k} x", quality(k, s)]) + newline for k, s in enumerate(seqs))


def test_fastq_plain_gzip_pairs_and_odd_qualities(spark, tmp_path):
    seqs = [s or "A" for s in random_reads(4, 300)]
    (tmp_path / "a.fastq").write_text(fastq(seqs))
    (tmp_path / "b.fastq").write_bytes(fastq(seqs, "\r\n").encode())
    with gzip.open(tmp_path / "c.fastq.gz", "wt") as out:
        out.write(fastq(seqs))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for name in ("a.fastq", "b.fastq", "c.fastq.gz"):
            got = read_fastq(spark, f"{tmp_path}/{name}").collect()
            assert sorted((r.name, r.seq) for r in got) == sorted((f"read{k} x", s) for k, s in enumerate(seqs)), name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    both = read_fastq(spark, [f"{tmp_path}/a.fastq", f"{tmp_path}/c.fastq.gz"])
    assert {r.mate: r["count"] for r in both.groupBy("mate").count().collect()} == {1: len(seqs), 2: len(seqs)}
    with pytest.raises(ValueError):
        read_fastq(spark, [])


def test_graph_and_starts_are_read_as_written(spark, tmp_path):
    edges = kmers.build_graph(reads(spark, random_reads(5)), Params(k=4))
    sinks.write_graph(edges, f"{tmp_path}/graph")
    assert sorted(read_graph(spark, f"{tmp_path}/graph").collect()) == sorted(edges.collect())
    starts = edges.limit(9).withColumn("bucket", S.log2_bucket(F.col("mult")))
    sinks.write_starts(starts, f"{tmp_path}/starts")
    assert read_starts(spark, f"{tmp_path}/starts").count() == 9
    sinks.delete_graph(edges, f"{tmp_path}/graph")
    assert not (tmp_path / "graph").exists()
    (tmp_path / "t.txt").write_text("abc\nxaby\nzz\n")
    assert [(r.value, r["at"]) for r in search_text(spark, f"{tmp_path}/t.txt", "ab").collect()] == [("abc", 1), ("xaby", 2)]


def test_stream_counts_equal_a_batch(spark, tmp_path):
    seqs = random_reads(6)
    for k in range(3):
        reads(spark, seqs[k::3]).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("read_id long, seq string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = keep_counting(stream, "edge_counts", f"{tmp_path}/checkpoint", Params(k=5))
    query.awaitTermination(120)
    assert {r.edge: r.mult for r in spark.table("edge_counts").collect()} == brute.edges(seqs, 5, True)


def test_params_are_checked():
    for bad in ({"k": 1}, {"support": 0.0}, {"min_cycle": 90}, {"min_spacers": 0}, {"min_spacer_letters": 60}):
        with pytest.raises(ValueError):
            Params(**bad)
