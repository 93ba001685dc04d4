import hashlib
import random

import numpy as np

from strandloom.llm import suffix_dedup as S
from tests.llm.cases import documents, prose


def brute(rows, length):
    """{place in rows: spans}"""
    first = {}
    for i, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1):
            g = raw[k : k + length]
            if i is not None and first.get(g, i) >= i:
                first[g] = i
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 2, bool)
        for k in range(len(raw) - length + 1):
            if i is not None and first[raw[k : k + length]] < i:
                gone[k + 1 : k + 1 + length] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        out.append((len(raw), [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])], hashlib.sha256(bytes(b for b, g in zip(raw, gone[1:]) if not g)).hexdigest()))
    return out


def check(spark, rows, length=50, **more):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.remove_repeats(frame, length=length, **more).collect()
    seen = sorted((str(r.doc_id), r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept_sha256) for r in got)
    assert seen == sorted((str(i), *b) for (i, _), b in zip(rows, brute(rows, length), strict=True))
    return got


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(r.doc_id * 3 - 50, r.text) for r in documents(spark, n=40).collect()]
    passages = [prose(rng, 30) for _ in range(6)]
    for k in range(40):
        words = passages[rng.randrange(6)].split(" ")
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "edit"
        rows.append((rng.randrange(-500, 500) * 7 + 5, f"{prose(rng, rng.randrange(30))} {' '.join(words[rng.randrange(5):])} {prose(rng, rng.randrange(30))}"))
    rng.shuffle(rows)
    check(spark, rows)
    check(spark, rows, 30)


def test_hot_tokens_are_spread(spark):
    """A passage of half of all documents, between words of their own; each of its tokens is hot."""
    rng = random.Random(18)
    hot = prose(rng, 20)
    rows = [(k * 5 - 300, f"{prose(rng, rng.randrange(9))} {hot if k % 2 else ''} {prose(rng, rng.randrange(9))}") for k in range(150)]
    rows += [(3, rows[1][1]), (None, hot), (7, hot[5:-5])]
    for least in (2, 40, 1000):
        check(spark, rows, hot_suffixes=least)


def test_small_alphabet_and_periods(spark):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.randrange(300)))) for k in range(30)]
    rows += [(100 + k, "ab" * rng.randrange(20, 120)) for k in range(12)] + [(200 + k, "a" * rng.randrange(45, 90)) for k in range(12)]
    check(spark, rows, 24)
    check(spark, rows)


def test_hot_passage_over_many_ranges(spark):
    rng = random.Random(6)
    hot = prose(rng, 60)
    rows = [(k, f"{prose(rng, 12)} {hot if k % 3 else prose(rng, 20)} {prose(rng, 8)}") for k in range(900)]
    check(spark, rows)


def test_repeated_and_missing_ids(spark):
    text = "passage " * 20
    check(spark, [(None, text), (None, text), (3, text), (3, text), (3, text + "x" * 60), (4, "x" * 70), (4, text), (5, None), (6, "")])


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "_LONG", 256)
    rng = random.Random(1)
    a = prose(rng, 500)
    data = np.frombuffer(a.encode(), np.uint8)
    windows = set()
    for _, base, part, at in S._cut(data, np.array([0, len(data)]), 50):
        _, place, first, last, _ = S.anchors(part, at, 50)
        windows.update(base + w for x, y in zip(first, last, strict=True) for w in range(x, y + 1))
    assert windows == set(range(len(data) - 49))
    check(spark, [(1, a), (2, a[300:900] + prose(rng, 80)), (3, a)])


def test_empty_table_and_clashing_names(spark):
    docs = documents(spark).withColumnRenamed("lang", "blob").withColumnRenamed("source", "_id")
    assert S.remove_repeats(docs.limit(0)).count() == 0
    out = S.remove_repeats(docs, with_bytes=True)
    assert out.count() == docs.count() and out.filter("n_bytes < length(kept)").count() == 0
