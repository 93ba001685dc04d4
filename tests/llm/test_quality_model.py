import random

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import quality_model as M
from strandloom.llm.queries import op10_quality_model
from tests.llm.cases import documents


def junk(rng, k, words):
    return [" ".join(w + "###" for w in words), " ".join(words).upper(), " ".join(w for w in words for _ in range(6)), " | ".join(words)][k % 4]


def tables(spark, n=1200):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice(["the", "on", "ea", "in", "r"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 120))]
        good = rng.random() < 0.8
        docs.append((k, ". ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) if good else junk(rng, k, words), "en", "s"))
        labels.append((k, int(good), 0))
    docs += [(n, None, "en", "s"), (n + 1, "", "en", "s"), (None, "some text", "en", "s")]
    labels += [(n + 2, 1, 0), (5, None, 0), (None, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, tmp_path):
    docs, labels = tables(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in op10_quality_model(spark, str(tmp_path)).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id is not None}
    assert len(got) == 1203 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [k for k in range(1200) if got[k].held_out]
    assert len(held) > 200 and np.mean([got[k].predicted == truth[k] for k in held]) > 0.95


def test_compiled_equals_direct_evaluation(spark):
    docs, labels = tables(spark, 400)
    x, y = M._training_rows(docs, labels, "doc_id", "text", "quality", F.lit(True), M.EnsembleParams())
    assert len(y) == 400
    model = M.fit(x, y)
    assert 0 < len(model.rules) < 200
    z = sum((w * M._holds(x, r) for r, w in zip(model.rules, model.weights, strict=True)), np.full(len(x), model.intercept))
    frame = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], ["k", *M.FEATURES])
    got = {r.k: r.s for r in frame.select("k", M.compiled(model).alias("s")).collect()}
    assert np.allclose([got[k] for k in range(len(x))], M._sigmoid(z))


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(1)
    z = (rng.random((500, 12)) < 0.4).astype(float)
    y = (rng.random(500) < M._sigmoid(2 * z[:, 0] - 3 * z[:, 1] + 0.3)).astype(float)
    p = M.EnsembleParams(penalty=0.01, steps=5000)
    w, b = M._lasso(z, y, p)
    slope = z.T @ (M._sigmoid(z @ w + b) - y) / len(y)
    assert np.all(np.abs(slope) <= p.penalty + 1e-4)
    assert np.allclose(slope[w != 0], -p.penalty * np.sign(w[w != 0]), atol=1e-4) and 2 <= (w != 0).sum() < 12


def test_no_labels_one_label_empty_and_clashing(spark):
    docs, labels = tables(spark, 60)
    odd = documents(spark).withColumnsRenamed({"lang": "words", "source": "_words", "n_chars": "score"})
    assert {r.score for r in M.score_quality(odd, labels.limit(0), learn=F.lit(True)).collect()} == {0.5}
    assert min(r.score for r in M.score_quality(docs, labels.filter("quality = 1"), learn=F.lit(True)).collect()) > 0.9
    assert M.score_quality(docs.limit(0), labels, learn=F.lit(True)).count() == 0
    assert M.score_quality(odd, labels, learn=F.lit(True)).count() == odd.count()
