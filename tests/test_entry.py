import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from strandloom import __main__ as command
from strandloom.queries import ORACLES, QUERIES
from strandloom.settings import check_inputs, check_settings, failing, settings_report
from strandloom.sources.sinks import write_path_report

SF = "/root/testdata/sf0.001"
CHEAP = ["planted_reads", "revcomp", "kmer_count", "kmer_count_both", "edge_degrees", "successors_covered", "ratio_predecessors", "goal_walks", "fastq_scan", "graph_delete", "starts_round_trip", "text_search", "ratio_neighbours", "start_candidates", "arrays", "cycle_dump", "rotate_left", "top_spaced_substring", "settings_report"]


@pytest.mark.parametrize("name", CHEAP)
def test_queries_equal_their_sql(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("customer", "documents", "part", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, found.fetchall()))


def test_entry_finds_every_planted_array_on_both_strands(spark):
    found = entry.entry(spark)
    assert found.count() == 50
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_settings(spark):
    rows = [(1, 1.0, 8.0, 1, 4), (2, 8.0, 8.0, 4, 4), (3, 9.0, 8.0, 0, 4), (4, None, 8.0, None, 4), (5, 2.0, 8.0, 5, 4)]
    report = settings_report(spark.createDataFrame(rows, "run_id int, ram double, total_ram double, threads int, cores int"))
    assert {r.run_id: r.names for r in failing(report).collect()} == {1: ["ram"], 3: ["ram", "threads"], 4: ["ram", "threads"], 5: ["threads"]}
    assert report.count() == 10


def test_inputs_and_command(spark, tmp_path, capsys):
    rng = random.Random(1)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    repeat = dna(32)
    seq = repeat + "".join(f + dna(30) + f + repeat for f in "ACGT")
    reads = tmp_path / "reads.fastq"
    reads.write_text("".join(f"@r{k}\n{seq}\n+\n{'I' * len(seq)}\n" for k in range(8)))
    assert check_inputs([str(reads)]) == [str(reads)]
    for bad in ([], [str(reads)] * 3, [f"{tmp_path}/x.fasta"], [f"{tmp_path}/none.fastq"]):
        with pytest.raises((ValueError, FileNotFoundError)):
            check_inputs(bad)
    assert command.main([str(reads), "--output", f"{tmp_path}/out", "--one-strand"]) == 0
    assert "4 spacers" in capsys.readouterr().out
    assert spark.read.text(f"{tmp_path}/out/arrays.txt").count() == 1
    assert command.main([f"{tmp_path}/none.fastq", "--output", "x"]) == 1
    for wrong in (["--threads", "0"], ["--threads", "100000"], ["--ram", "1"], ["--ram", str(1 << 60)]):
        assert command.main([str(reads), "--output", "x", *wrong]) == 1
        assert wrong[0][2:] in capsys.readouterr().err


def test_settings_of_the_command_are_those_of_the_report(spark):
    rows = [(k, ram, 8.0, threads, 4) for k, (ram, threads) in enumerate([(1.0, 1), (8.0, 4), (9.0, 0), (None, None), (2.0, 5), (7.9, 2)])]
    frame = spark.createDataFrame(rows, "run_id int, ram double, total_ram double, threads int, cores int")
    want = {r.run_id: r.names for r in failing(settings_report(frame)).collect()}
    assert want == {r[0]: names for r in rows if (names := [n for n, _ in check_settings(*r[1:])])}


def test_only_a_missing_subpackage_is_passed_over(tmp_path):
    """Without the subpackage the rest is there; with a fault inside it nothing is."""
    root = Path(entry.__file__).parent
    shutil.copytree(root / "strandloom", tmp_path / "strandloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert run().stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert run().returncode != 0


def test_path_report_is_written(spark, tmp_path):
    report = spark.createDataFrame([("s", "AC CG", "ACG CGT", "1 2")], "start string, labels string, ids string, mults string")
    for _ in range(2):
        write_path_report(report, f"{tmp_path}/paths")
    assert [sorted(r.value for r in spark.read.text(f"{tmp_path}/paths/{n}").collect()) for n in ("labels", "ids", "mults")] == [["AC CG"] * 2, ["ACG CGT"] * 2, ["1 2"] * 2]
