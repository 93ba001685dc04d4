"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (tests, one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.sparkContext.setCheckpointDir(folder)
        atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone; the folder is then the cluster's to clear
        pass


class Scratch:
    """Written tables of one operator run. `keep` writes and rereads a frame; `drop` deletes what is no longer read.

    A table is Parquet in the shared folder, so a lost executor costs the running tasks only.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/strandloom-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(_delete, spark, self.root)

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        frame.write.parquet(path)
        table = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(table)] = path
        return table

    def drop(self, table: DataFrame) -> None:
        _delete(self.spark, self.paths.pop(id(table)))


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that nothing refers to any more, such as those of a table just written.

    Spark's cleaner acts when the driver's collectors find the plans; left alone that may be after the job.
    """
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.5)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
