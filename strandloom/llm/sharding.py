"""Shards as a minimax contiguous partition of groups of equal texts.

Groups are ordered by a 64-bit hash of the text. The smallest capacity for which a greedy left-to-right walk needs no
more than the wanted number of shards is found by binary search. The walk needs prefix sums of group sizes, but only
near its cuts: it works on a bounded table of cells (dyadic ranges of the hash with their sizes) that is refined round
by round where a cut may fall, until the capacity is exact. Only cells come to the driver, never groups.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.numbering import gapless
from strandloom.scratch import Scratch, shuffle_partitions

#: Bytes added for each row.
ROW_BYTES = 16
#: Cells of the first round as a power of two, and cells that a later round may add, at most.
FIRST_BITS, ADDED = 12, 1 << 16
_SIGN = 1 << 63


@dataclass(frozen=True)
class Cuts:
    """capacity: bytes of the largest shard allowed. keys: the least group key of shards 1, 2, ..."""

    capacity: int
    keys: tuple[int, ...]


@dataclass
class _Cell:
    start: int
    bits: int
    size: int
    groups: int

    @property
    def solid(self) -> bool:
        return self.groups == 1 or self.bits == 64


def _walk(sums: list[int], cells: list[_Cell], capacity: int, hopeful: bool) -> list[int] | None:
    """Cells at which the greedy walk cuts, or None where a whole cell is over capacity.

    sums[i]: bytes before cell i. The hopeful walk may cut inside a cell of several groups at any byte, so it needs no
    more shards than the true walk; the other one cuts between cells only and needs no fewer.
    """
    cuts, at = [], 0
    while sums[-1] - at > capacity:
        k = bisect.bisect_right(sums, at + capacity) - 1
        if hopeful and not cells[k].solid:
            at += capacity
        elif sums[k] > at:
            at = sums[k]
        else:
            return None
        cuts.append(k)
    return cuts


def _cells(groups: DataFrame, parents: list[_Cell] | None, bits: int) -> list[_Cell]:
    """Non-empty cells of `bits` bits, of the whole order or inside `parents`, all of the same length."""
    place = F.col("key").bitwiseXOR(F.lit(-_SIGN))
    of = F.shiftrightunsigned(place, 64 - bits)
    if parents is not None:
        own = parents[0].bits
        groups = groups.filter(F.shiftrightunsigned(place, 64 - own).isin([p.start >> (64 - own) for p in parents]))
    rows = groups.groupBy(of.alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("groups")).collect()
    return [_Cell((r["cell"] & (2 * _SIGN - 1)) << (64 - bits), bits, int(r["size"]), r["groups"]) for r in rows]


def plan_cuts(groups: DataFrame, shards: int) -> Cuts:
    """groups: (key long, size long), one row per group. No groups: one empty capacity and no cuts."""
    total, largest = groups.agg(F.sum("size"), F.max("size")).first()
    if not total:
        return Cuts(0, ())
    low, high = max(largest, -(-total // shards)), total
    cells = sorted(_cells(groups, None, FIRST_BITS), key=lambda c: c.start)
    while True:
        sums = [0]
        for c in cells:
            sums.append(sums[-1] + c.size)

        def least(hopeful: bool, a: int, b: int, sums=sums, cells=cells) -> int:
            while a < b:
                mid = (a + b) // 2
                cuts = _walk(sums, cells, mid, hopeful)
                a, b = (a, mid) if cuts is not None and len(cuts) < shards else (mid + 1, b)
            return a

        low = least(True, low, high)
        high = least(False, low, high)
        cuts = _walk(sums, cells, high, False)
        if low == high:
            break
        first, last = _walk(sums, cells, low, False) or [], _walk(sums, cells, high, True) or []
        wanted: set[int] = set()
        for j in range(shards - 1):
            a = first[j] if j < len(first) else 0 if not first else first[-1]
            b = last[j] if j < len(last) else len(cells) - 1
            wanted.update(k for k in range(a, b + 1) if not cells[k].solid)
        if not wanted:
            break
        bits = min(cells[k].bits for k in wanted)
        wanted = {k for k in wanted if cells[k].bits == bits}
        step = min(64 - bits, max(1, (ADDED // len(wanted)).bit_length() - 1))
        finer = _cells(groups, [cells[k] for k in sorted(wanted)], bits + step)
        cells = sorted([c for k, c in enumerate(cells) if k not in wanted] + finer, key=lambda c: c.start)
    return Cuts(high, tuple(cells[k].start - _SIGN for k in cuts))


def _shard(key: Column, cuts: Cuts) -> Column:
    out = F.lit(0)
    for k, first in enumerate(cuts.keys):
        out = F.when(key >= F.lit(first), F.lit(k + 1)).otherwise(out)
    return out


def assign_shards(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, size, text_crc32, law, shard, slot, grown_shard) per row of `docs`; other columns are not carried.

    size: UTF-8 bytes of the text plus 16; a null text has no bytes. Equal texts (null and empty count as equal) are
    one atomic group and share a shard. Law `bytes`: the largest shard is as small as contiguous cuts of the groups in
    hash order allow; a group of more than a fair share makes its shard that large. slot: 0, 1, ... inside the shard,
    by hashed id. grown_shard is null. Null and repeated ids are kept; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key")
    )
    groups = scratch.keep(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    cuts = plan_cuts(groups, shards)
    scratch.drop(groups)
    salts = max(1, 8 * shuffle_partitions(spark) // shards)
    placed = rows.withColumn("shard", _shard(F.col("key"), cuts)).drop("key")
    placed = gapless(placed, ["shard"], F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"), ["_id", "text_crc32"], "slot")
    return placed.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
