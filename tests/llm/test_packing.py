import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strandloom.llm import packing as P
from strandloom.llm import textkernels as K
from tests.llm.cases import documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "abc<|endoftext|>def <|endoftext|> <|STARTOFTEXT|>", "It's don't 12.5% É ÀÉ x×y a÷b 'tis éa …, “q”", "a,b c.d! e--f ,g (h) |x| || a|", "\x1cfoo bar\x85baz q",
    "ñandú! ß. ẞ ŸÿŸ Ǆ", "é É́! a.́", "ﬁ K İ ſ", "a\x00b \x7f \x01,", "...!!! ??", "漢字 テスト。 x", "​ a​, 😀😀!", "", None, " \n",
]


def brute_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers(spark):
    texts = ODD + [r.text for r in documents(spark).collect()]
    model = P.Ids(PATH)
    tokenizer = Tokenizer.from_file(PATH)
    data, offsets = K.column_bytes(pa.array(texts, pa.string()))
    for most in (1 << 20, 64):
        for i, j in K.blocks(offsets, most):
            ids, at = model.of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for k in range(j - i):
                assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(texts[i + k] or "", add_special_tokens=False).ids, texts[i + k]


def test_known_units_start_anew(monkeypatch):
    monkeypatch.setattr(P, "CACHED", 5)
    model = P.Ids(PATH)
    for _ in range(3):
        for text in ("one two three four.", "five six seven eight, nine"):
            ids, _ = model.of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
            assert ids.tolist() == brute_ids(text)


def thue_morse(bits):
    out = "a"
    for _ in range(bits):
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_units_of_one_hash_are_told_apart(monkeypatch):
    """Strings on which every polynomial hash modulo 2**64 agrees; and all strings, under a hash of two values."""
    swap = str.maketrans("ab", "ba")
    for bits in (10, 11):
        one = thue_morse(bits)
        for text in (one, one.translate(swap), f"{one} {one.translate(swap)} {one}"):
            ids, _ = (model := P.Ids(PATH) if text == one else model).of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
            assert ids.tolist() == brute_ids(text)
    monkeypatch.setattr(K, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(2))
    model = P.Ids(PATH)
    for text in ("one two three four.", "four three, two one é漢 It's", "one two three four."):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert model.of(raw, np.array([0, len(raw)]))[0].tolist() == brute_ids(text)


def test_text_of_more_units_than_a_table_holds(monkeypatch):
    monkeypatch.setattr(P, "MOST_UNITS", 20)
    model = P.Ids(PATH)
    for text in ("one two three", " ".join(f"w{k} x{k}" for k in range(300)), "three four"):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert model.of(raw, np.array([0, len(raw)]))[0].tolist() == brute_ids(text)


def test_rows_without_an_id_stay(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    out = P.pack(docs, PATH).collect()
    assert sorted((r.doc_id is None, r.length) for r in out) == [(False, 1), (True, 3), (True, 3)]


@pytest.mark.parametrize("capacity", [1, 7, 64, 4096])
def test_plan_uses_every_length_once_and_few_sequences(capacity):
    rng = random.Random(capacity)
    for _ in range(30):
        counts = Counter(min(capacity, int(rng.paretovariate(0.7)) if rng.random() < 0.7 else rng.randrange(1, capacity + 1)) for _ in range(rng.randrange(400)))
        patterns = P.plan(counts, capacity)
        used = Counter()
        for p in patterns:
            assert sum(p.lengths) <= capacity and p.times > 0
            for x in p.lengths:
                used[x] += p.times
        assert used == counts
        # first fit decreasing is not beaten by more than one in fifty
        bins = []
        for x in sorted(counts.elements(), reverse=True):
            k = next((k for k, b in enumerate(bins) if b + x <= capacity), None)
            if k is None:
                bins.append(x)
            else:
                bins[k] += x
        assert sum(p.times for p in patterns) <= len(bins) * 1.02 + 1


def test_exact_complements():
    assert [sorted(p.lengths) for p in P.plan({7: 1, 3: 1, 2: 1, 5: 2}, 10)] == [[3, 7], [5, 5], [2]]
    assert sorted(P.plan({6: 4, 3: 4, 1: 4}, 10)[0].lengths) == [1, 3, 6]


def test_round_trip(spark):
    docs = documents(spark)
    rows = {r.doc_id: r.text for r in docs.collect()}
    for capacity in (16, 4096):
        out = P.pack(docs, PATH, capacity=capacity, with_ids=True).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in out:
            assert r.length == len(r.ids) <= capacity and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids))
            pieces[r.doc_id].append(r)
            sequences[r.sequence_id].append(r)
        assert pieces.keys() == rows.keys()
        for k, parts in pieces.items():
            parts.sort(key=lambda r: r.piece)
            assert [r.piece for r in parts] == list(range(len(parts)))
            assert sum((r.ids for r in parts), []) == [*brute_ids(rows[k]), 1]
            assert [r.start for r in parts] == [k * capacity for k in range(len(parts))]
        for parts in sequences.values():
            at = 0
            for r in sorted(parts, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= capacity


def test_empty_table_and_repeated_rows(spark):
    docs = documents(spark)
    assert P.pack(docs.limit(0), PATH).count() == 0
    twice = docs.union(docs).withColumnRenamed("lang", "length")
    out = P.pack(twice, PATH).select("sequence_id", "offset")
    assert out.count() == out.distinct().count()
