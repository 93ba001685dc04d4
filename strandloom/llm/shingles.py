"""Documents whose sets of word shingles are alike: SimHash and MinHash bands name candidates, the sets themselves decide.

1. A text is the set of its shingles' 64-bit hashes; texts of one set are one class, so copies cost nothing. The SimHash of
   a class has the bits that over half of its hashes have. Classes of near fingerprints are the first candidates; what their
   sets link is one component from here on, and no pair within a component is tried again.
2. A class has BANDS keys, each of the least values of ROWS hash functions. At Jaccard similarity s a pair shares no key with
   probability (1 - s^ROWS)^BANDS: 3 in a million at 0.8, less above.
3. Classes of one key are a run. In a short run all pairs are candidates. In a long one each class meets the run's first. If
   that leaves a long run in several components, its classes are dealt anew by pairs of bands, of which a pair at 0.8 shares
   one or more but for 6 in 100,000; and what is long and in several components even then goes through further rounds, one
   class for each component, until a round links none. From the pairs of bands on, a pair whose BANDS * ROWS least values
   (a byte of each) agree too seldom is no candidate: at the similarity sought that happens to FAINT of the pairs.
4. Every candidate is verified by the two sets, read again from the texts of classes that are in a candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import packed as P
from strandloom.llm import textkernels as K
from strandloom.llm.passages import text_hashes
from strandloom.operators.components import connected_components
from strandloom.scratch import Scratch, release, shuffle_partitions

BANDS, ROWS = 24, 4
#: Runs of up to so many classes are compared pair by pair.
SHORT = 6
#: In rounds after the first, classes of a longer run also meet so many that follow.
STEPS = 3
#: Share of the pairs at the similarity sought whose least values may agree too seldom.
FAINT = 3e-6
_random = np.random.default_rng(42)
_FLIPS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MORE = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, and their n + 1 offsets. A text of fewer words is one shingle."""
    _, _, words, first = text_hashes(data, offsets)
    n_words = np.diff(first)
    whole = np.where(n_words >= shingle, n_words - shingle + 1, 0)
    windows = K.window_hashes(words, shingle)
    hashes = [windows[P.ragged(first[:-1], whole)] if len(windows) else np.empty(0, np.uint64)]
    owner = [np.repeat(np.arange(len(n_words)), whole)]
    for k in np.flatnonzero((n_words > 0) & (n_words < shingle)):
        hashes.append(K.window_hashes(words[first[k] : first[k + 1]], int(n_words[k])))
        owner.append(np.array([k]))
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(n_words) + 1))


def set_names(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for an empty one."""
    some = np.flatnonzero(np.diff(bounds))
    names = np.zeros(len(bounds) - 1, np.uint64)
    if len(some):
        names[some] = K.mixed(np.add.reduceat(K.mixed(hashes), bounds[:-1][some]))
    return names


def least_values(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(n, BANDS * ROWS) least values of the sets, one for each hash function; 0 for an empty one."""
    some = np.flatnonzero(np.diff(bounds))
    least = np.zeros((len(bounds) - 1, BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS if len(some) else 0):
        least[some, k] = np.minimum.reduceat((hashes ^ _FLIPS[k]) * _FACTORS[k], bounds[:-1][some])
    return least


def band_keys(hashes: np.ndarray, bounds: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """(n, BANDS) keys of the sets; 0 for an empty one."""
    least = least_values(hashes, bounds) if least is None else least
    keys = np.zeros((len(bounds) - 1, BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(keys), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = K.mixed(key * _MORE + least[:, k])
        keys[:, band] = key
    keys[np.diff(bounds) == 0] = 0
    return keys


def least_agreeing(similarity: float, n: int = BANDS * ROWS) -> int:
    """How many of n least values agree, but for a share of FAINT at most, at a Jaccard similarity or above."""
    below, k = 0.0, 0
    while below + (here := comb(n, k) * similarity**k * (1 - similarity) ** (n - k)) <= FAINT and k < n:
        below, k = below + here, k + 1
    return k


def _set_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(_id, text_hash, set, size, fp, keys, least) of each row; set 0 is that of a text without words."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column("_text"))
            names, sizes, fps, keys, least = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [], []
            for i, j in K.blocks(offsets):
                hashes, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                names.append(set_names(hashes, bounds))
                sizes.append(np.diff(bounds))
                fps.append(K.majority_bits(hashes, bounds))
                values = least_values(hashes, bounds)
                keys += [k.tobytes() for k in band_keys(hashes, bounds, values)]
                least += [k.tobytes() for k in K.mixed(values).astype(np.uint8)]
            columns = [pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(fps).view(np.int64))]
            columns += [pa.array(keys, pa.binary()), pa.array(least, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("text_hash"), *columns], names=["_id", "text_hash", "set", "size", "fp", "keys", "least"])

    return rows.mapInArrow(K.trimmed(run), f"_id {rows.schema['_id'].dataType.simpleString()}, text_hash long, set long, size int, fp long, keys binary, least binary")


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
            columns = [pa.array(np.repeat(batch.column(c).to_numpy(), BANDS)) for c in ("set", "size", "component")]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *columns], names=["key", "set", "size", "component"])


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of two bands together, where one of them is in `open`."""
    left, right = np.triu_indices(BANDS, 1)
    for batch in batches:
        for keys, open_, name, size, component, least in zip(*(batch.column(c).to_pylist() for c in ("keys", "open", "set", "size", "component", "least")), strict=True):
            keys = np.frombuffer(keys, np.uint64)
            some = np.isin(keys.view(np.int64), open_)
            ok = some[left] | some[right]
            both = K.mixed(keys[left[ok]] * _MORE + keys[right[ok]]).view(np.int64)
            columns = [pa.array(np.full(len(both), x, t)) for x, t in ((name, np.int64), (size, np.int32), (component, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(both), *columns, pa.array([least] * len(both), pa.binary())], names=["key", "set", "size", "component", "least"])


_PAIRS, _KEPT = range(2)
#: Pairs and kept rows that a task brings together before it passes them on.
GATHERED = 1 << 20


def _distinct(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return [a[new], b[new]]


def _candidates(similarity: float, later: bool, bins: int):
    """Blobs of pairs (a, b) to verify, a < b, of classes that are not known to be of one component, by bin of a; and of
    (key, set, size) of the classes of a long run but its first, which are not done with.

    A pair shares many keys, so pairs are made distinct by bin. In later rounds rows have `least` too, classes of a long run also meet
    the STEPS that follow, and of the classes of one component that have no pair with the run's first the least alone is kept,
    as one is to stand for all."""
    columns = ["key", "set", "size", "component", *(["least"] if later else [])]
    steps, agreeing = (STEPS, least_agreeing(similarity)) if later else (0, 0)

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        out = [batch.column(c).to_numpy() for c in columns[:4]]
        return [*out, np.frombuffer(b"".join(batch.column("least").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)] if later else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, so equal keys are runs; the last run waits for the next batch."""
        found, n = ([], []), 0
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), *([np.empty((0, BANDS * ROWS), np.uint8)] if later else [])]

        def work(key: np.ndarray, name: np.ndarray, size: np.ndarray, component: np.ndarray, least: np.ndarray | None = None) -> int:
            def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                ok = (component[x] != component[y]) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]))
                if least is not None:
                    some = np.flatnonzero(ok)
                    ok[some] = (least[x[some]] == least[y[some]]).sum(axis=1) >= agreeing
                return ok

            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            length = np.diff(cuts)
            run_length = np.repeat(length, length)
            head = np.repeat(cuts[:-1], length)
            long_ = run_length > SHORT
            rest = head != np.arange(len(key))
            pairs = []
            for step in range(1, SHORT):
                # the first of a long run meets all of it below
                at = np.flatnonzero((key[step:] == key[:-step]) & (~long_ | (rest & (step <= steps)))[:-step])
                pairs.append((at, at + step))
            x, y = (np.concatenate([p[k] for p in pairs]) for k in range(2))
            ok = near(x, y)
            pairs = [(x[ok], y[ok])]
            y = np.flatnonzero(long_ & rest)
            if len(y):
                no = ~near(head[y], y)
                if later:
                    order = np.lexsort((y, component[y], head[y]))
                    first = np.ones(len(y), bool)
                    first[order[1:]] = (np.diff(component[y][order]) != 0) | (np.diff(head[y][order]) != 0)
                    y, no = y[first | ~no], no[first | ~no]
                pairs.append((head[y[~no]], y[~no]))
                found[_KEPT].append((key[y], name[y], size[y]))
            x, z = (name[np.concatenate([p[k] for p in pairs])] for k in range(2))
            found[_PAIRS].append(_distinct(np.minimum(x, z), np.maximum(x, z)))
            return len(found[_PAIRS][-1][0]) + len(y)

        def out() -> pa.RecordBatch:
            rows = []
            for kind, parts in enumerate(found):
                if parts:
                    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    columns = _distinct(*columns) if kind == _PAIRS else columns
                    to = (K.mixed(columns[0].view(np.uint64)) % np.uint64(bins)).astype(np.int64)
                    rows += [(kind, b, P.pack(*x)) for b, x in P.dealt(to, *columns)]
                    parts.clear()
            return P.blob_rows(rows)

        for batch in batches:
            held = [np.concatenate(x) for x in zip(held, arrays(batch), strict=True)]
            if not len(held[0]):
                continue
            done = int(np.searchsorted(held[0], held[0][-1]))
            if done:
                n += work(*(h[:done] for h in held))
                if n >= GATHERED:
                    yield out()
                    n = 0
            held = [h[done:] for h in held]
        if len(held[0]):
            work(*held)
        yield out()

    return run


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, blobs in P.groups(batches):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _distinct(*P.joined(blobs))], names=["a", "b"])


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in P.unpack(blob)], names=["key", "set", "size"])


def _read_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column("_text"))
            for i, j in K.blocks(offsets):
                hashes, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                names = set_names(hashes, bounds)
                sets = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(sets, pa.binary())], names=["set", "hashes"])

    return run


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_hashes"), batch.column("b_hashes"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                same = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(same >= similarity * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def alike(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, scratch: Scratch, near: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """rows(_id, text_hash, set, size) of the rows with an id, and components(set, component) of the sets that are linked to another.

    near: from distinct fingerprints (fp) to links (a, b) between those of few different bits.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    # pairs are few beside keys
    bins = parts // 8 + 1
    named = docs.filter(F.col(id_col).isNotNull())
    rows = scratch.keep(_set_rows(named, id_col, text_col, shingle), "sets")
    classes = rows.filter("size > 0").groupBy("set").agg(F.min("_id").alias("_id"), *(F.first(c).alias(c) for c in ("size", "fp", "keys", "least")))
    firsts = classes.select("set", "_id")
    texts = named.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of sets that are alike."""
        ends = [pairs.select(F.col(end).alias("set")).distinct() for end in "ab"]
        wanted = ends[0].union(ends[1]).distinct().join(firsts, "set")
        read = texts.join(wanted, "_id").select("_text").mapInArrow(K.trimmed(_read_sets(shingle)), "set long, hashes binary")
        # rows of one id may have other texts too
        sets = scratch.keep(read.join(wanted.select("set"), "set", "left_semi").dropDuplicates(["set"]), "hashes")
        left, right = (sets.select(F.col("set").alias(end), F.col("hashes").alias(f"{end}_hashes")) for end in "ab")
        new = scratch.keep(pairs.join(left, "a").join(right, "b").mapInArrow(_alike(similarity), "a long, b long"), "alike")
        scratch.drop(sets)
        release(spark)
        return new

    # one class stands for a fingerprint; others that have it are linked to that one
    of = scratch.keep(classes.groupBy("fp").agg(F.min("set").alias("set")), "fingerprints")
    left, right = (of.select(F.col("fp").alias(end), F.col("set").alias(f"{end}_set")) for end in "ab")
    same = classes.select("fp", F.col("set").alias("other")).join(of, "fp").filter("set <> other").select(F.col("set").alias("a"), F.col("other").alias("b"))
    found = near(of.select("fp")).join(left, "a").join(right, "b").select(F.least("a_set", "b_set").alias("a"), F.greatest("a_set", "b_set").alias("b"))
    tested = scratch.keep(found.unionByName(same).distinct(), "pairs")
    links = verified(tested)
    found = connected_components(links, "a", "b", scratch).withColumnRenamed("vertex", "set")
    known = classes.select("set", "size", "keys").join(found, "set", "left").withColumn("component", F.coalesce("component", "set"))
    runs = known.mapInArrow(_key_rows, "key long, set long, size int, component long")
    for step in count():
        by_key = runs.repartition(parts, "key").sortWithinPartitions("key", "set")
        out = scratch.keep(by_key.mapInArrow(K.trimmed(_candidates(similarity, step > 0, bins)), P.BLOB), "candidates")
        pairs = out.filter(F.col("kind") == _PAIRS).repartition(bins, "bin").sortWithinPartitions("bin").mapInArrow(_pair_rows, "a long, b long")
        pairs = scratch.keep(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        new = verified(pairs)
        tested = tested.unionByName(pairs)
        none = not new.limit(1).count()
        if not none:
            links = links.unionByName(new)
            found = connected_components(links, "a", "b", scratch).withColumnRenamed("vertex", "set")
        if step > 1 and none:
            return rows, found
        left = out.filter(F.col("kind") == _KEPT).mapInArrow(_kept_rows, "key long, set long, size int")
        left = left.join(found, "set", "left").withColumn("component", F.coalesce("component", "set"))
        # one class stands for each component of a run; of a run of one component nothing is left
        ones = scratch.keep(left.groupBy("key", "component").agg(F.min(F.struct("set", "size")).alias("one")), "ones")
        split = ones.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        if not split.limit(1).count():
            return rows, found
        if step:
            runs = ones.join(split, "key", "left_semi").select("key", "one.set", "one.size", "component").join(classes.select("set", "least"), "set")
            runs = runs.select("key", "set", "size", "component", "least")
        else:
            open_ = left.join(split, "key", "left_semi").groupBy("set").agg(F.collect_set("key").alias("open"), F.first("component").alias("component"))
            runs = open_.join(classes, "set").select("set", "size", "keys", "open", "component", "least").mapInArrow(_pair_keys, "key long, set long, size int, component long, least binary")
