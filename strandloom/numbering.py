"""Gapless numbering inside groups without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gapless(frame: DataFrame, group: list[str], salt: Column, order: list[str], name: str) -> DataFrame:
    """Adds `name`: 0, 1, 2 ... inside each group, ordered by salt and then `order`.

    Rows are numbered within (group, salt); a small table of counts by (group, salt) gives the offsets. A group that
    holds a third of all rows is thus spread over as many tasks as there are salts.
    """
    salted = frame.withColumn("_salt", salt)
    keys = [*group, "_salt"]
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_place", F.row_number().over(inside) - 1)
        .join(starts, keys)
        .withColumn(name, (F.col("_start") + F.col("_place")).cast("long"))
        .drop("_salt", "_start", "_place")
    )
