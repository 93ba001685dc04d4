"""Array columns that are computed once."""

import random

from pyspark.sql import functions as F

from strandloom import functions as S
from strandloom.operators import arrays


def test_array_columns_are_computed_once(spark):
    """Expressions copied into lambda functions take the square of a start's cycles in windows, and more."""
    rng = random.Random(9)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    head, spacers = dna(32), [dna(32) for _ in range(4)]
    walks = spark.createDataFrame([(head[:24], (head + s + head)[:87]) for s in spacers], "start string, seq string")
    found = walks.select("start", S.windows(F.col("seq"), 24).alias("nodes"), "seq")
    called = arrays.call_arrays(found)
    shown = called._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("array_intersect") == 1 and shown.count("regexp_extract_all") == 1
    assert [r.n_spacers for r in called.collect()] == [4]
