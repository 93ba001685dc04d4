import random

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import shingles as H
from strandloom.llm import simhash as S


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors(texts):
    """Smallest ids of the components of all pairs at Jaccard 0.8 or more."""
    own, root = {k: sets(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if own[a] == own[b] or 10 * len(own[a] & own[b]) >= 8 * len(own[a] | own[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k for k in ids if find(k) == k}


def edited(rng, words, n):
    out = [*words]
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.getrandbits(30)}"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_at_similarity_08_link_and_others_do_not(spark, seed):
    rng = random.Random(seed)
    texts = {0: "", 1: None, 2: "one two", 3: "One  two", 4: "one two three"}
    for _ in range(150):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 100, 300]))]
        for _ in range(rng.randrange(1, 4)):
            texts[len(texts)] = " ".join(edited(rng, base, rng.randrange(1 + len(base) // 25)))
    # a template that hundreds fill in, so that runs are long and hold many components
    base = [f"t{k}" for k in range(120)]
    for _ in range(40):
        kind = [*base[:90], *(f"k{rng.getrandbits(30)}" for _ in range(40))]
        for _ in range(rng.randrange(1, 12)):
            texts[len(texts)] = " ".join(edited(rng, kind, rng.randrange(3)))
    rows = [*texts.items()]
    rng.shuffle(rows)
    got = {r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = survivors(texts)
    assert got == want, (len(got), len(want), len(texts))


def test_survivors_are_rows_not_ids(spark):
    rng = random.Random(4)
    one, two, three = ([f"w{rng.getrandbits(30)}" for _ in range(100)] for _ in range(3))
    near = lambda words: " ".join(edited(rng, words, 1))
    # id 5 has two clean texts; id 7 one that is the first of its component and one that is a near copy of id 5's
    rows = [(5, " ".join(one)), (5, " ".join(two)), (7, " ".join(three)), (7, near(one)), (8, near(three)), (9, near(two)), (9, "")]
    rows += [rows[2]]
    got = sorted((r.doc_id, r.text) for r in S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([rows[0], rows[1], rows[2], rows[6]])
    near_first = [(3, " ".join(one)), (3, near(one)), (4, near(one))]
    got = [tuple(r) for r in S.drop_near_duplicates(spark.createDataFrame(near_first, "doc_id long, text string")).collect()]
    assert got == [min(near_first[:2])]


def test_simhash_names_pairs_before_any_band_does(spark, monkeypatch):
    """Without the bands, pairs of near fingerprints still link; and their sets are asked."""
    rng = random.Random(12)
    base = [f"w{rng.getrandbits(30)}" for _ in range(2000)]
    rows = [(1, " ".join(base)), (2, " ".join(edited(rng, base, 2))), (3, " ".join(f"x{w}" for w in base))]
    monkeypatch.setattr(H, "_key_rows", lambda batches: iter(()))
    asked = []
    near = S.fingerprint_links
    monkeypatch.setattr(S, "fingerprint_links", lambda fps: asked.append(fps.count()) or near(fps))
    got = {r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1, 3} and asked == [3]
    data = np.frombuffer(" ".join(base).encode(), np.uint8)
    hashes, bounds = H.shingle_sets(data, np.array([0, len(data)]), 5)
    bits = sum((2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))
    assert H.K.majority_bits(hashes, bounds).tolist() == [bits]


def test_least_values_agree_at_the_similarity_sought():
    least, n = H.least_agreeing(0.8), H.BANDS * H.ROWS
    below = sum(H.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(least))
    assert below <= H.FAINT < below + H.comb(n, least) * 0.8**least * 0.2 ** (n - least)


@pytest.mark.parametrize("later", [False, True])
def test_rows_of_a_long_run(later):
    """One row stands for a component that the run's first has no pair with, once rounds go by components."""
    n = 40
    least = np.random.default_rng(3).integers(0, 256, (n, H.BANDS * H.ROWS), np.uint8)
    component = np.repeat([0, 100], n // 2)
    columns = {"key": np.ones(n, np.int64), "set": np.arange(n), "size": np.full(n, 50, np.int32), "component": component}
    arrays = [pa.array(x) for x in columns.values()] + [pa.array([x.tobytes() for x in least], pa.binary())]
    batch = pa.RecordBatch.from_arrays(arrays, names=[*columns, "least"])
    blobs = [r for out in H._candidates(0.8, later, 3)(iter([batch])) for r in out.to_pylist()]
    kept = sorted(v for r in blobs if r["kind"] == H._KEPT for v in H.P.unpack(r["blob"])[1].tolist())
    pairs = sorted(v for r in blobs if r["kind"] == H._PAIRS for v in zip(*(x.tolist() for x in H.P.unpack(r["blob"])), strict=True))
    assert kept == ([1, 20] if later else list(range(1, n)))
    assert pairs == ([] if later else [(0, k) for k in range(20, n)])


def test_a_pair_of_many_keys_is_made_once():
    """Two classes that share every key, in keys of two classes each."""
    n = 50
    columns = {"key": np.repeat(np.arange(n), 2), "set": np.tile([3, 5], n), "size": np.full(2 * n, 9, np.int32), "component": np.tile([3, 5], n)}
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=[*columns])
    rows = [r for out in H._candidates(0.8, False, 3)(iter([batch.slice(0, 31), batch.slice(31)])) for r in out.to_pylist()]
    assert [[x.tolist() for x in H.P.unpack(r["blob"])] for r in rows] == [[[3], [5]]]
