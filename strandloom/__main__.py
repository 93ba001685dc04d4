"""python -m strandloom reads_1.fastq [reads_2.fastq] --output DIR: finds arrays and writes them as text and Parquet."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from strandloom.params import Params
from strandloom.plans import find_arrays
from strandloom.settings import check_inputs, check_settings, cores, total_ram
from strandloom.sources import read_fastq
from strandloom.sources.sinks import write_arrays


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="strandloom", description="Finds arrays of repeats and spacers in sequencing reads.")
    args.add_argument("reads", nargs="+", help="one FASTQ file, or two of a pair; plain or gzip")
    args.add_argument("--output", required=True, help="folder to write to")
    args.add_argument("--k", type=int, default=Params.k)
    args.add_argument("--threads", type=int, default=max(1, cores() - 2), help="local threads; by default two fewer than there are cores")
    args.add_argument("--ram", type=int, default=int(0.9 * total_ram()), help="bytes of memory; by default nine tenths of what there is")
    args.add_argument("--one-strand", action="store_true")
    given = args.parse_args(argv)
    try:
        paths = check_inputs(given.reads)
        params = Params(k=given.k, both_strands=not given.one_strand)
    except (ValueError, FileNotFoundError) as error:
        print(error, file=sys.stderr)
        return 1
    wrong = check_settings(given.ram, total_ram(), given.threads, cores())
    if wrong:
        print("\n".join(f"{name}: {message}" for name, message in wrong), file=sys.stderr)
        return 1
    memory = f"{max(1, given.ram >> 20)}m"
    spark = SparkSession.builder.master(f"local[{given.threads}]").config("spark.driver.memory", memory).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run = find_arrays(read_fastq(spark, paths), params)
    run.arrays.write.mode("overwrite").parquet(f"{given.output}/arrays")
    print(f"{write_arrays(spark.read.parquet(f'{given.output}/arrays'), f'{given.output}/arrays.txt')} spacers")
    for row in run.metrics().collect():
        print(f"{row['name']}: {row['value']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
