"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 30


def by_hash(frame: DataFrame, key: str, seed: int, rows: int) -> DataFrame:
    """About 1.2 * `rows` rows (all, if there are fewer), chosen by a hash of the key; 2 * `rows` at most.

    Rows are counted first and then filtered in place, so no task sends more than its share to the driver, whatever the
    number of tasks. The upper bound matters only where very many rows have one key.
    """
    n = frame.count()
    share = min(1.0, 1.2 * rows / max(n, 1))
    return frame.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(_PARTS)) < int(share * _PARTS)).limit(2 * rows)
