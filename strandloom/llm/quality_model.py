"""Quality scores by a sparse ensemble of rules over text statistics.

Shallow trees are boosted on statistics of labelled documents; every path from a root to a node is a conjunctive rule;
a logistic regression with an L1 penalty keeps few of them. What is kept is compiled into Spark column expressions, so
scoring runs inside the query plan over statistics that are column expressions too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm import quality_rules
from strandloom.llm.sampling import by_hash


@dataclass(frozen=True)
class EnsembleParams:
    #: Labelled rows to learn from at most; scoring covers all rows.
    train_rows: int = 8000
    trees: int = 40
    depth: int = 3
    #: Thresholds tried for each statistic, least rows in a leaf, learning rate of the boosting.
    thresholds: int = 24
    least_leaf: int = 20
    rate: float = 0.3
    #: Weight of the L1 penalty and steps of the proximal gradient.
    penalty: float = 2e-4
    steps: int = 800
    cut: float = 0.7


#: Statistics of a text, by name. All are finite for every text.
FEATURES = [
    "words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "stutter_share", "distinct_share", "punct_share", "words_per_line",
]


def features(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` with the columns FEATURES; a null text counts as empty, for which all are 0."""
    stats = quality_rules.statistics(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda others: F.length(F.regexp_replace(text, others, ""))
    share = lambda a, b: (F.coalesce(a, F.lit(0)).cast("double") / F.greatest(b, F.lit(1)).cast("double"))
    n, chars = F.col("n_words"), F.col("word_chars")
    return stats.withColumns(
        {
            "words": n.cast("double"),
            "mean_word": share(chars, n),
            "symbols_per_word": share(F.col("n_symbols"), n),
            "dup_line_share": share(F.col("n_dup_lines"), F.col("_n_lines")),
            "repeat_share": share(F.col("n_repeat_words"), n),
            "upper_share": share(count(r"[^\p{Lu}]+"), chars),
            "digit_share": share(count(r"[^0-9]+"), chars),
            "stutter_share": share(quality_rules.stutter(F.col("_words")), n),
            "distinct_share": share(F.size(F.array_distinct("_words")), n),
            "punct_share": share(count(r"[^.,;:!?'\"()-]+"), n),
            "words_per_line": share(n, F.col("_n_lines")),
        }
    )


#: A condition: (statistic, above, threshold); a rule: conditions that all hold.
Condition = tuple[int, bool, float]
Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) == above
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, rule: Rule, p: EnsembleParams, out: np.ndarray, rules: set[Rule]) -> None:
    """Newton steps g / h in the leaves; splits by gain. Adds each path to `rules` and the leaves' values to `out`."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, None)
    if len(rule) < p.depth and len(rows) >= 2 * p.least_leaf:
        for k, tried in enumerate(cuts):
            if not len(tried):
                continue
            side = np.searchsorted(tried, x[rows, k], "left")
            gs, hs, ns = (np.cumsum(np.bincount(side, w, len(tried) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            gain[(ns < p.least_leaf) | (len(rows) - ns < p.least_leaf)] = 0
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), (k, float(tried[at])))
    if best[1] is None:
        out[rows] += p.rate * total_g / (total_h + 1)
        return
    k, cut = best[1]
    for above in (False, True):
        own = (*rule, (k, above, cut))
        rules.add(tuple(sorted(own)))
        _tree(x, g, h, cuts, rows[(x[rows, k] > cut) == above], own, p, out, rules)


def _lasso(z: np.ndarray, y: np.ndarray, p: EnsembleParams) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalized logistic regression by accelerated proximal gradient."""
    base = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    w, b = np.zeros(z.shape[1]), base
    v, c, momentum = w.copy(), b, 1.0
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    for _ in range(p.steps):
        error = _sigmoid(z @ v + c) - y
        new_w = v - step * (z.T @ error) / len(y)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * p.penalty, 0)
        new_b = c - step * error.mean()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, c = new_w + (momentum - 1) / following * (new_w - w), new_b + (momentum - 1) / following * (new_b - b)
        w, b, momentum = new_w, new_b, following
    return w, float(b)


def fit(x: np.ndarray, y: np.ndarray, p: EnsembleParams = EnsembleParams()) -> Ensemble:
    """x: (rows, statistics); y: 0 or 1. Without rows every score is one half; with one label only, near that label."""
    if not len(y):
        return Ensemble((), (), 0.0)
    mean = (y.sum() + 0.5) / (len(y) + 1)
    if y.min() == y.max():
        return Ensemble((), (), float(np.log(mean / (1 - mean))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, p.thresholds + 2)[1:-1], method="lower")) for c in x.T]
    # rare junk lies outside the quantiles of all rows: those of the smaller class count as well
    small = x[y == (y.mean() < 0.5)]
    cuts = [np.unique(np.concatenate([a, np.quantile(c, np.linspace(0, 1, p.thresholds + 2)[1:-1], method="lower")])) for a, c in zip(cuts, small.T, strict=True)]
    score = np.full(len(y), np.log(mean / (1 - mean)))
    rules: set[Rule] = set()
    for _ in range(p.trees):
        q = _sigmoid(score)
        _tree(x, y - q, q * (1 - q), cuts, np.arange(len(y)), (), p, score, rules)
    columns, kept = {}, []
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        held = _holds(x, rule)
        if held.tobytes() not in columns:
            columns[held.tobytes()] = held
            kept.append(rule)
    z = np.stack(list(columns.values()), axis=1).astype(float) if kept else np.zeros((len(y), 0))
    w, b = _lasso(z, y.astype(float), p) if kept else (np.zeros(0), float(np.log(mean / (1 - mean))))
    some = np.flatnonzero(w)
    return Ensemble(tuple(kept[k] for k in some), tuple(float(w[k]) for k in some), b)


def compiled(model: Ensemble) -> Column:
    """The score as a column over FEATURES."""
    total = F.lit(model.intercept)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        held = F.lit(True)
        for k, above, cut in rule:
            own = F.col(FEATURES[k])
            held = held & (own > F.lit(cut) if above else own <= F.lit(cut))
        total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(total, F.lit(40.0)), F.lit(-40.0))))


def _training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column, p: EnsembleParams) -> tuple[np.ndarray, np.ndarray]:
    """Labelled rows, p.train_rows at most, chosen by a hash of the id; only the statistics of those rows come here."""
    known = labels.filter(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("_y"))
    chosen = by_hash(known, "_label_id", 5, p.train_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_label_id"))
    told = features(rows, "_text").select(F.xxhash64("_id", "_text").alias("_h"), "_y", *FEATURES)
    found = told.orderBy("_h", "_y").limit(p.train_rows).drop("_h").collect()
    found.sort()
    return np.array([[r[c] for c in FEATURES] for r in found], float).reshape(-1, len(FEATURES)), np.array([r["_y"] for r in found], int)


def score_quality(
    docs: DataFrame, labels: DataFrame, *, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", params: EnsembleParams = EnsembleParams()
) -> DataFrame:
    """One row (id, score, predicted) per row of `docs`; other columns are not carried.

    Learns from the rows of `labels` (id, 0 or 1) for which `learn` (over the labels' columns) is true, params.train_rows
    at most; scores from the text alone. predicted is 1 where score >= params.cut. Null and empty texts are scored by
    their statistics, all 0; labels that are null or for no document are passed over; without any, all scores are one
    half. Null ids and repeated rows are kept; no rows give none.
    """
    x, y = _training_rows(docs, labels, id_col, text_col, label_col, learn, params)
    model = fit(x, y, params)
    rows = features(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text")
    scored = rows.select(F.col("_id").alias(id_col), compiled(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= params.cut).cast("int"))
