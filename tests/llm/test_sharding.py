import random
import zlib
from collections import defaultdict

import xxhash

from strandloom.llm import sharding as S
from tests.llm.cases import documents


def needed(sizes, capacity):
    n, room = 1, capacity
    for s in sizes:
        if s > capacity:
            return 10**9
        if s > room:
            n, room = n + 1, capacity
        room -= s
    return n


def best(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(sizes, mid) <= shards else (mid + 1, high)
    return low


def signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def check(rows, out, shards):
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in rows)
    by_id = {r.doc_id: r.text or "" for r in rows}
    totals, slots, homes, groups = defaultdict(int), defaultdict(list), defaultdict(set), defaultdict(int)
    for r in out:
        raw = by_id[r.doc_id].encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        assert 0 <= r.shard < shards
        totals[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        homes[by_id[r.doc_id]].add(r.shard)
        groups[signed(by_id[r.doc_id])] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in homes.values())
    assert max(totals.values()) <= best([groups[k] for k in sorted(groups)], shards)


def test_minimax_and_slots(spark):
    docs = documents(spark)
    rows = docs.collect()
    for shards in (1, 3, 7, 40):
        check(rows, S.assign_shards(docs, shards).collect(), shards)


def test_refinement_needs_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(S, "FIRST_BITS", 2)
    monkeypatch.setattr(S, "ADDED", 64)
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, "x" * rng.randrange(300) + str(rng.randrange(500))) for k in range(1500)], "doc_id long, text string")
    check(docs.collect(), S.assign_shards(docs, 9).collect(), 9)


def test_empty_and_hot(spark):
    docs = documents(spark)
    assert S.assign_shards(docs.limit(0), 4).count() == 0
    hot = spark.createDataFrame([(k, "same" if k % 2 else f"t{k}") for k in range(400)], "doc_id long, text string")
    check(hot.collect(), S.assign_shards(hot, 5).collect(), 5)
