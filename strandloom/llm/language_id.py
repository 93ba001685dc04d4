"""Language identification by a linear-chain conditional random field over words.

A word's score for a language is a sum of learned weights: of its byte n-grams (two to four, word ends marked, so that
those at an end are its affixes) and, if it is in the learned lexicon, of the word itself. Learned transitions link
neighbouring words. Forward-backward gives each word's distribution over languages, also in text that switches between
languages; a text's language is the one with the largest mean over its words.

Texts of any length are worked off exactly by blocks of words: the product of each block's transition matrices links
the blocks of a text, and all blocks are then swept side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm import packed as P
from strandloom.llm import textkernels as K
from strandloom.llm.sampling import by_hash

LETTERS = K.byte_table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", high=True)
_START, _END = 1, 2
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    #: Labelled rows to learn from at most, and the longest text among them in bytes. Prediction has no such bounds.
    train_rows: int = 1500
    train_bytes: int = 20_000
    #: Words of a training sequence and sequences; half of them are put together from texts of different languages.
    sequence: int = 32
    sequences: int = 3000
    buckets_bits: int = 16
    lexicon: int = 4000
    steps: int = 30
    rate: float = 0.5
    decay: float = 1e-4


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    words: np.ndarray
    start: np.ndarray
    moves: np.ndarray


def _marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in a row, each between two marks, lower-cased (A-Z and U+00C0 to U+00DE), and their offsets."""
    sizes = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], np.uint8)
    out[at[:-1]], out[at[1:] - 1] = _START, _END
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    body = K.LOWER[data[P.ragged(starts, ends - starts)]]
    upper = np.flatnonzero((body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97) & (body[:-1] == 0xC3)) + 1
    body[upper] += 0x20
    out[inner] = body
    return out, at


def _grams(text: np.ndarray, at: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word) of all n-grams of two, three and four bytes inside a word."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    value = text.astype(np.uint64)
    for n in (2, 3, 4):
        if len(text) < n:
            return
        value = value[:-1] * np.uint64(257) + text[n - 1 :]
        same = owner[: len(value)] == owner[n - 1 :]
        h = K.mixed(value[same] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
        yield (h >> np.uint64(64 - bits)).astype(np.int64), owner[: len(value)][same]


def _word_scores(model: Model, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    bits = len(model.grams).bit_length() - 1
    n = len(at) - 1
    out = np.zeros((n, len(model.languages)))
    for bucket, owner in _grams(text, at, bits):
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(owner, model.grams[bucket, k], n)
    known = K.span_hashes(text, at[:-1], at[1:])
    where = np.minimum(np.searchsorted(model.lexicon, known), max(len(model.lexicon) - 1, 0))
    if len(model.lexicon):
        hit = model.lexicon[where] == known
        out[hit] += model.words[where[hit]]
    return out


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all words of a block of texts (each different word is scored once), and each text's first word."""
    starts, ends, first = K.words(data, offsets, LETTERS)
    if not len(starts):
        return np.empty((0, len(model.languages))), first
    _, index, inverse = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    text, at = _marked(data, starts[index], ends[index])
    return _word_scores(model, text, at)[inverse], first


def posteriors(emit: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray, block: int = 64) -> np.ndarray:
    """P(label of word | text) by forward-backward, for texts that are rows first[i] to first[i + 1] of `emit`."""
    labels = emit.shape[1]
    n_words = np.diff(first)
    n_blocks = -(-n_words // block)
    of = np.repeat(np.arange(len(n_words)), n_blocks)
    begin = np.cumsum(n_blocks) - n_blocks
    nth = np.arange(len(of)) - begin[of]
    head = first[of] + nth * block
    size = np.minimum(block, first[of + 1] - head)
    if not len(of):
        return np.empty((0, labels))
    grid = np.ones((len(of), block, labels))
    inside = np.arange(block) < size[:, None]
    grid[inside] = np.exp(emit - emit.max(axis=1, keepdims=True))
    move = np.exp(moves)
    scaled = lambda x: x / x.sum(axis=-1, keepdims=True)
    # each block's matrix: from the label before the block to that of its last word
    matrix = np.broadcast_to(np.eye(labels), (len(of), labels, labels)).copy()
    for t in range(block):
        on = inside[:, t]
        if not on.any():
            break
        new = (matrix[on] @ move) * grid[on, t][:, None, :]
        matrix[on] = new / new.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.empty((len(of), labels)), np.ones((len(of), labels))
    # before a text's first word: the vector that one move turns into exp(start) is not needed; its first word is set apart
    longest = int(n_blocks.max())
    texts = np.flatnonzero(n_blocks)
    first_block = begin[texts]
    opening = scaled(np.exp(start)[None, :] * grid[first_block, 0])
    state = np.empty((len(texts), labels))
    state[:] = opening
    for t in range(1, block):
        on = inside[first_block, t]
        state[on] = scaled((state[on] @ move) * grid[first_block[on], t])
    live, at = np.arange(len(texts)), first_block
    for k in range(1, longest):
        more = n_blocks[texts[live]] > k
        live = live[more]
        at = begin[texts[live]] + k
        enter[at] = state[live]
        state[live] = scaled((state[live][:, None, :] @ matrix[at])[:, 0, :])
    for k in range(longest - 1, 0, -1):
        live = texts[n_blocks[texts] > k]
        at = begin[live] + k
        leave[at - 1] = scaled((matrix[at] @ leave[at][:, :, None])[:, :, 0])
    forward = np.empty_like(grid)
    now = np.empty((len(of), labels))
    for t in range(block):
        new = scaled((enter @ move if t == 0 else now @ move) * grid[:, t])
        if t == 0:
            new[first_block] = opening
        now = np.where(inside[:, t][:, None], new, now)
        forward[:, t] = now
    backward = leave
    out = np.empty_like(grid)
    for t in range(block - 1, -1, -1):
        out[:, t] = forward[:, t] * backward
        step = scaled((grid[:, t] * backward) @ move.T)
        backward = np.where(inside[:, t][:, None], step, backward)
    return scaled(out[inside])


def _gradient(model: Model, grams, owner, lex, emit, labels, first):
    """Gradients of the mean log-likelihood: expected minus observed counts, over sequences of equal length."""
    n, size = len(first) - 1, int(first[1] - first[0])
    count = len(model.languages)
    grid = np.exp(emit - emit.max(axis=1, keepdims=True)).reshape(n, size, count)
    move, begin = np.exp(model.moves), np.exp(model.start)
    alpha, beta = np.empty_like(grid), np.empty_like(grid)
    alpha[:, 0] = begin * grid[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, size):
        x = (alpha[:, t - 1] @ move) * grid[:, t]
        alpha[:, t] = x / x.sum(axis=1, keepdims=True)
    beta[:, -1] = 1
    for t in range(size - 2, -1, -1):
        x = (grid[:, t + 1] * beta[:, t + 1]) @ move.T
        beta[:, t] = x / x.sum(axis=1, keepdims=True)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    truth = np.eye(count)[labels].reshape(n, size, count)
    pair = alpha[:, :-1, :, None] * move * (grid[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    seen = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
    error = (post - truth).reshape(-1, count)
    g_grams = np.stack([np.bincount(grams, error[owner, k], len(model.grams)) for k in range(count)], axis=1)
    known = lex >= 0
    g_words = np.stack([np.bincount(lex[known], error[known, k], len(model.words)) for k in range(count)], axis=1)
    return [g / len(labels) for g in (g_grams, g_words, (post - truth)[:, 0].sum(axis=0), pair.sum(axis=(0, 1)) - seen)]


def train(rows: list[tuple[str, str]], p: LanguageParams = LanguageParams()) -> Model | None:
    """A model from (text, language) rows, by AdaGrad on the likelihood of word sequences; None without a labelled word."""
    rng = np.random.default_rng(17)
    languages = sorted({lang for _, lang in rows})
    data, offsets = K.column_bytes(pa.array([t for t, _ in rows], pa.string()))
    starts, ends, first = K.words(data, offsets, LETTERS) if len(data) else (np.empty(0, np.int64),) * 3
    if not len(starts):
        return None
    label = np.repeat([languages.index(x) for _, x in rows], np.diff(first))
    by_label = [np.flatnonzero(label == k) for k in range(len(languages))]
    some = [k for k, x in enumerate(by_label) if len(x)]
    picked = []
    for k in range(p.sequences):
        parts = 1 if k % 2 else int(rng.integers(2, 4))
        cuts = np.linspace(0, p.sequence, parts + 1).astype(int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            pool = by_label[some[int(rng.integers(len(some)))]]
            at = int(rng.integers(max(1, len(pool) - (b - a) + 1)))
            picked.append(pool[(at + np.arange(b - a)) % len(pool)])
    picked = np.concatenate(picked)
    text, at = _marked(data, starts, ends)
    whole = K.span_hashes(text, at[:-1], at[1:])
    distinct, counts = np.unique(whole, return_counts=True)
    lexicon = np.sort(distinct[np.argsort(-counts, kind="stable")[: p.lexicon]])
    where = np.minimum(np.searchsorted(lexicon, whole[picked]), len(lexicon) - 1)
    lex = np.where(lexicon[where] == whole[picked], where, -1)
    count = len(languages)
    model = Model(languages, np.zeros((1 << p.buckets_bits, count)), lexicon, np.zeros((len(lexicon), count)), np.zeros(count), np.zeros((count, count)))
    text, at = _marked(data, starts[picked], ends[picked])
    found = list(_grams(text, at, p.buckets_bits))
    grams, owner = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    known = lex >= 0
    weights = [model.grams, model.words, model.start, model.moves]
    sums = [np.full_like(w, 1e-8) for w in weights]
    bounds = np.arange(0, len(picked) + 1, p.sequence)
    for _ in range(p.steps):
        emit = np.stack([np.bincount(owner, model.grams[grams, k], len(picked)) for k in range(count)], axis=1)
        emit[known] += model.words[lex[known]]
        for w, total, g in zip(weights, sums, _gradient(model, grams, owner, lex, emit, label[picked], bounds), strict=True):
            g += p.decay / len(picked) * w
            total += g * g
            w -= p.rate * g / np.sqrt(total)
    return model


def _sample(docs: DataFrame, p: LanguageParams, id_col: str, text_col: str, lang_col: str, learn: Column) -> list[tuple[str, str]]:
    """Labelled rows, p.train_rows at most: the first by a hash of the id among a sample by another hash."""
    labelled = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = by_hash(labelled, id_col, 3, p.train_rows).filter(F.octet_length(text_col) <= p.train_bytes)
    found = chosen.select(F.xxhash64(id_col, F.lit(4)).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).collect()
    return [(r["text"], r["lang"]) for r in sorted(found)[: p.train_rows]]


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode())


def identify(
    docs: DataFrame, *, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", params: LanguageParams = LanguageParams(), with_words: bool = False
) -> DataFrame:
    """One row (id, lang_pred, score[, words]) per row of `docs`; other columns are not carried.

    Learns from the rows for which `learn` is true and that have a text and a language, params.train_rows of them at
    most; predicts from the text alone. score: mean over the text's words of the probability of lang_pred. A null text
    or one without a letter is `und` with score 0, as is every text if nothing can be learned. words: (start, end,
    lang) byte spans of runs of words of one most likely language. Null ids and repeated rows are kept; no rows give none.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(_sample(docs, params, id_col, text_col, lang_col, learn), params))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            data, offsets = K.column_bytes(batch.column("_text"))
            for i, j in K.blocks(offsets):
                at, block = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
                if m is None:
                    emit, first = np.empty((0, 1)), np.zeros(j - i + 1, np.int64)
                else:
                    emit, first = scores(m, block, at)
                found = posteriors(emit, first, m.start, m.moves) if len(emit) else emit
                has = np.flatnonzero(np.diff(first) > 0)
                mean = np.add.reduceat(found, first[:-1][has], axis=0) / np.diff(first)[has, None] if len(has) else found
                plain = np.add.reduceat(LETTERS[:128][np.minimum(block, 127)] & (block < 128), at[:-1][has]) > 0 if len(has) else has
                lang, score = [UNKNOWN] * (j - i), np.zeros(j - i)
                for row, k in enumerate(has.tolist()):
                    if plain[row] or _has_letter(block[at[k] : at[k + 1]].tobytes()):
                        best = int(np.argmax(mean[row]))
                        lang[k], score[k] = m.languages[best], min(1.0, float(mean[row, best]))
                columns = [batch.column("_id").slice(i, j - i), pa.array(lang, pa.string()), pa.array(score)]
                if with_words:
                    starts, ends, _ = K.words(block, at, LETTERS)
                    best = found.argmax(axis=1) if len(found) else np.empty(0, int)
                    runs = []
                    for k in range(j - i):
                        own, w = best[first[k] : first[k + 1]], slice(first[k], first[k + 1])
                        cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
                        stop = np.concatenate([cuts[1:], [len(own)]]) if len(own) else own
                        runs.append([{"start": int(starts[w][a] - at[k]), "end": int(ends[w][b - 1] - at[k]), "lang": m.languages[own[a]]} for a, b in zip(cuts, stop, strict=True)])
                    columns.append(pa.array(runs, spans))
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "lang_pred", "score", *["words"] * with_words])

    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, lang_pred string, score double" + ", words array<struct<start:long,end:long,lang:string>>" * with_words
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
