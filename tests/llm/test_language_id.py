import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import language_id as L
from strandloom.llm.queries import op8_language_id
from tests.llm.cases import documents

PARTS = {"en": ["th", "er", "on", "ing", "the", "of"], "de": ["sch", "ung", "ein", "ü", "der", "keit"], "fr": ["eau", "oi", "é", "ment", "le", "ç"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def table(spark, n=300):
    rng = random.Random(1)
    rows = []
    for k in range(n):
        lang = rng.choice(list(PARTS))
        rows.append((k, prose(rng, lang, rng.randrange(3, 200)).upper() if k % 9 == 0 else prose(rng, lang, rng.randrange(3, 200)), lang, "s"))
    rows += [(n, None, "en", "s"), (n + 1, "", "en", "s"), (n + 2, "12 -- …!", "de", "s"), (n + 3, "漢字", None, "s"), (None, "the of", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_posteriors_equal_all_paths():
    rng = np.random.default_rng(2)
    emit, start, moves = rng.normal(size=(9, 3)) * 2, rng.normal(size=3), rng.normal(size=(3, 3))
    first = np.array([0, 5, 5, 6, 9])
    for block in (1, 2, 3, 64):
        got = L.posteriors(emit, first, start, moves, block)
        for a, b in zip(first[:-1], first[1:], strict=True):
            want = np.zeros((b - a, 3))
            for path in product(range(3), repeat=int(b - a)):
                weight = np.exp(sum(emit[a + t, x] for t, x in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:], strict=False)) + (start[path[0]] if path else 0))
                for t, x in enumerate(path):
                    want[t, x] += weight
            assert got[a:b] == pytest.approx(want / want.sum(axis=1, keepdims=True) if b > a else want)


def test_gradient_equals_differences():
    rng = np.random.default_rng(5)
    m = L.Model(["a", "b"], rng.normal(size=(4, 2)), np.empty(0), rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=(2, 2)))
    grams, owner, lex, labels, first = rng.integers(0, 4, 12), np.repeat(np.arange(6), 2), np.array([0, 1, -1, 1, -1, 0]), rng.integers(0, 2, 6), np.array([0, 3, 6])

    def emit():
        out = np.stack([np.bincount(owner, m.grams[grams, k], 6) for k in range(2)], axis=1)
        out[lex >= 0] += m.words[lex[lex >= 0]]
        return out

    def loss():
        e, total = emit(), 0.0
        for a in (0, 3):
            weigh = lambda path, a=a, e=e: sum(e[a + t, x] for t, x in enumerate(path)) + m.start[path[0]] + sum(m.moves[x, y] for x, y in zip(path, path[1:], strict=False))
            total += np.log(sum(np.exp(weigh(path)) for path in product(range(2), repeat=3))) - weigh(labels[a : a + 3].tolist())
        return total / 6

    for w, g in zip((m.grams, m.words, m.start, m.moves), L._gradient(m, grams, owner, lex, emit(), labels, first), strict=True):
        for at in np.ndindex(w.shape):
            w[at] += 1e-5
            up = loss()
            w[at] -= 2e-5
            assert g[at] == pytest.approx((up - loss()) / 2e-5, abs=1e-6)
            w[at] += 1e-5


def test_held_out_accuracy_and_odd_texts(spark, tmp_path):
    rows = table(spark)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_language_id(spark, str(tmp_path)).collect()}
    lang = {r.doc_id: r.lang for r in rows.collect()}
    assert got.keys() == lang.keys()
    held = [k for k in range(300) if got[k].held_out]
    assert 30 < len(held) < 90 and sum(got[k].lang_pred == lang[k] for k in held) >= 0.97 * len(held)
    assert [(got[k].lang_pred, got[k].score) for k in (300, 301, 302)] == [("und", 0.0)] * 3
    assert got[303].lang_pred in PARTS and all(0 <= r.score <= 1 for r in got.values())


def test_code_switched_text_is_split(spark):
    rng = random.Random(3)
    a, b = prose(rng, "de", 40), prose(rng, "fr", 40)
    docs = table(spark).unionByName(spark.createDataFrame([(999, f"{a} {b}", None, "s")], "doc_id long, text string, lang string, source string"))
    words = L.identify(docs, learn=F.lit(True), with_words=True).filter("doc_id = 999").first().words
    assert {w.lang for w in words} >= {"de", "fr"}
    raw = f"{a} {b}".encode()
    right = sum(len(raw[w.start : w.end]) for w in words if (w.lang == "de" and w.end <= len(a.encode()) + 20) or (w.lang == "fr" and w.start >= len(a.encode()) - 20))
    assert right > 0.9 * len(raw)


def test_nothing_to_learn_empty_and_clashing(spark):
    docs = documents(spark).withColumnsRenamed({"source": "score", "n_chars": "_text"})
    assert L.identify(docs.limit(0), learn=F.lit(True)).count() == 0
    assert {r.lang_pred for r in L.identify(docs, learn=F.lit(False)).collect()} == {"und"}
    assert {r.lang_pred for r in L.identify(docs, learn=F.lit(True)).collect()} == {"und", "en"}
