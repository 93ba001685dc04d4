"""Checks of a run's settings, as rows."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


RAM_WRONG, THREADS_WRONG = "must be above 1 byte and at most the total", "must be 1 to the number of cores"


def cores() -> int:
    return os.cpu_count() or 1


def total_ram() -> int:
    """Bytes of this machine's memory."""
    return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")


def check_settings(ram: float | None, total: float, threads: int | None, n_cores: int) -> list[tuple[str, str]]:
    """(name, message) of each setting that settings_report would find wrong, for the command, before there is a session."""
    wrong = []
    if ram is None or not 1 < ram <= total:
        wrong.append(("ram", RAM_WRONG))
    if threads is None or not 0 < threads <= n_cores:
        wrong.append(("threads", THREADS_WRONG))
    return wrong


def settings_report(runs: DataFrame) -> DataFrame:
    """(run_id, name, ok, message) for each check. runs: (run_id, ram, total_ram, threads, cores)."""
    ram = F.col("ram").isNotNull() & (F.col("ram") > 1) & (F.col("ram") <= F.col("total_ram"))
    threads = F.col("threads").isNotNull() & (F.col("threads") > 0) & (F.col("threads") <= F.col("cores"))
    row = lambda name, ok, bad: F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok, "ok").otherwise(bad).alias("message"))
    checks = F.array(row("ram", ram, RAM_WRONG), row("threads", threads, THREADS_WRONG))
    return runs.select("run_id", F.explode(checks).alias("c")).select("run_id", "c.name", "c.ok", "c.message")


def failing(report: DataFrame) -> DataFrame:
    """(run_id, names): the failing checks of each run that has any."""
    return report.filter("not ok").groupBy("run_id").agg(F.array_sort(F.collect_list("name")).alias("names"))


def check_inputs(paths: list[str]) -> list[str]:
    """Absolute paths of one or two FASTQ files; raises for any other number, name or a local file that is missing."""
    if not 1 <= len(paths) <= 2:
        raise ValueError("one or two FASTQ files are needed")
    out = []
    for path in paths:
        if not path.removesuffix(".gz").endswith((".fastq", ".fq")):
            raise ValueError(f"not a FASTQ file name: {path}")
        if "://" not in path:
            if not Path(path).exists():
                raise FileNotFoundError(path)
            path = str(Path(path).resolve())
        out.append(path)
    return out
