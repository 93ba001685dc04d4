import random
import re

import numpy as np
import pytest
import xxhash

from strandloom.llm import simhash as S
from tests.llm.cases import documents


def fingerprint(text, shingle=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def components(points, radius):
    """{id: smallest reachable id} by comparing all pairs."""
    ids = sorted(points)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (points[i] ^ points[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    docs = documents(spark, n=120)
    rows = docs.collect()
    got = {r.doc_id: r for r in S.near_duplicates(docs).collect()}
    points = {r.doc_id: fingerprint(r.text) for r in rows}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{v:016x}" for k, v in points.items()}
    assert {k: r.component_id for k, r in got.items()} == components(points, 4)


def test_every_pair_within_four_bits_shares_a_key():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 4000, np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, np.uint64)
    other = base.copy()
    for k in range(len(other)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            other[k] ^= np.uint64(1) << np.uint64(b)
    keys = [[], []]
    for side, fps in enumerate((base, other)):
        keys[side] = [set() for _ in fps]
        for values, rows in S._keys(fps):
            for v, r in zip(values.tolist(), rows.tolist(), strict=True):
                keys[side][r].add(v)
    assert all(a & b for a, b in zip(*keys, strict=True))


def test_golay_indices_meet_within_two_bits():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 3000)
    a = S.golay_indices(v)
    for _ in range(4):
        u = v ^ (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))
        b = S.golay_indices(u)
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_clusters_and_chains(spark, monkeypatch, radius):
    """Fingerprints given directly: dense clusters, chains of small steps, and strangers."""
    rng = random.Random(radius)
    points = {}
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 60)):
            points[len(points)] = center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4)))
        for _ in range(rng.randrange(6)):
            center ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7)))
            points[len(points)] = center
    rows = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in points.items()], "_id long, fp long")
    monkeypatch.setattr(S, "_fingerprint_rows", lambda *a: rows)
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame([(0, "")], "doc_id long, text string"), radius=radius).collect()}
    assert got == components(points, radius)


def test_empty_long_and_clashing(spark):
    docs = documents(spark)
    assert S.near_duplicates(docs.limit(0)).count() == 0
    text = "w " * 70000 + "x y z"
    long = spark.createDataFrame([(1, text, "a"), (2, text + " q", "b"), (None, "", "c"), (None, None, "d")], "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in S.near_duplicates(long).collect()}
    assert got == {(1, f"{fingerprint(text):016x}"): 1, (2, f"{fingerprint(text + ' q'):016x}"): 1, (None, "0" * 16): None}
    assert {r.doc_id for r in S.drop_near_duplicates(long).collect()} == {1, None}
