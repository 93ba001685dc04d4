"""SimHash near-duplicates, found by fuzzy hashing with the perfect binary Golay code.

A 64-bit fingerprint is three segments of 22, 21 and 21 bits. A segment, padded to 23 bits, decodes to the 12-bit
indices of the Golay codewords within distance 4: one index if the nearest codeword is at distance 2 or less, else six.
Two segments that differ in at most two bits share an index (of the five 4-sets that complete a weight-3 coset leader
to a codeword, which partition the other 20 places, some meet both differing bits or the leader).

Pigeonhole for at most four differing bits over three segments:

* some segment has none: of the other two at least one has two or less. Key: the segment without errors, exact, and an
  index of another one (6 ordered pairs).
* each has one at least: then they have (2, 1, 1) in some order, or fewer. Key: an index of the first, and of each
  other segment the half that its single error spares (3 choices of the first, 2 x 2 halves).

So links are found by an equal key of 31 to 34 bits, and every candidate is verified by counting bits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import shingles
from strandloom.llm import textkernels as K
from strandloom.operators.components import connected_components
from strandloom.scratch import Scratch, shuffle_partitions

SEED = 42
#: Differing bits that the keys cover.
RADIUS = 4
_FIRST_BITS, _WIDTHS = (0, 22, 43), (22, 21, 21)
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
_GENERATOR = 0b101011100011
#: Runs of equal keys up to this long are compared pair by pair; longer ones by a search that leaves each linked one out of later steps.
_SHORT = 6


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """The fingerprint of each text: bit b is 1 if set in over half of its shingles' hashes; 0 for a text without words."""
    starts, ends, first = K.words(data, offsets, K.SPACED)
    n_words = np.diff(first)
    keep = K.SPACED[data]
    last = np.zeros(len(starts), bool)
    last[first[1:][n_words > 0] - 1] = True
    keep[ends[~last]] = True
    joined = np.where(K.SPACED[data], K.LOWER[data], np.uint8(32))[keep].tobytes()
    place = np.cumsum(keep)
    begin, stop = place[starts] - 1, place[ends - 1]
    count = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    of = np.concatenate([[0], np.cumsum(count)])
    head = np.arange(of[-1]) + np.repeat(first[:-1] - of[:-1], count)
    tail = np.minimum(head + shingle, np.repeat(first[1:], count)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[head].tolist(), stop[tail].tolist(), strict=True)], np.uint64)
    return K.majority_bits(hashes, of)


def _syndrome(vector: int) -> int:
    for bit in range(22, 10, -1):
        if vector >> bit & 1:
            vector ^= _GENERATOR << (bit - 11)
    return vector


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and for each syndrome up to six errors of weight 4 or less (-1: none)."""
    singles = [_syndrome(1 << b) for b in range(23)]
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for table, base in ((low, 0), (high, 12)):
        for v in range(1, len(table)):
            bit = v.bit_length() - 1
            table[v] = table[v ^ (1 << bit)] ^ singles[base + bit]
    errors = defaultdict(list)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= singles[b]
            errors[s].append(sum(1 << b for b in bits))
    table = np.full((1 << 11, 6), -1, np.int32)
    for s, found in errors.items():
        table[s, : len(found)] = found
    return low, high, table


_LOW, _HIGH, _ERRORS = _golay()


def golay_indices(segment: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within distance 4 of 23-bit vectors; -1 where there are fewer."""
    errors = _ERRORS[_LOW[segment & 0xFFF] ^ _HIGH[segment >> 12]]
    return np.where(errors >= 0, (segment[:, None] ^ errors) >> 11, -1)


def _keys(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, places in fp), family by family. A key starts with its family's number."""
    segments = [((fp >> np.uint64(b)) & np.uint64((1 << w) - 1)).astype(np.int64) for b, w in zip(_FIRST_BITS, _WIDTHS, strict=True)]
    indices = [golay_indices(s) for s in segments]
    tag = 0

    def made(other: np.ndarray, g: int):
        rows, cols = np.nonzero(indices[g] >= 0)
        return (np.int64(tag) << 40) | (other[rows] << 12) | indices[g][rows, cols], rows

    for exact in range(3):
        for g in range(3):
            if g != exact:
                yield made(segments[exact], g)
                tag += 1
    for g in range(3):
        a, b = (s for k, s in enumerate(segments) if k != g)
        for x, y in product((a & 0x7FF, a >> 11), (b & 0x7FF, b >> 11)):
            yield made((x << 11) | y, g)
            tag += 1


def _fingerprint_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column("_text"))
            parts = [fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle) for i, j in K.blocks(offsets, K.BLOCK // 4)]
            fp = np.concatenate([*parts, np.empty(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(fp.view(np.int64))], names=["_id", "fp"])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, fp long")


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            fp = batch.column("fp")[i : i + 4096].to_numpy()
            for keys, rows in _keys(fp.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], names=["key", "fp"])


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def _forest(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is linked: from each point reached to those that it reaches first."""
    left = fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _near(left, at, radius)
            if near.any():
                found, left = left[near], left[~near]
                yield np.full(len(found), at), found
                queue.extend(found)


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, so equal keys are runs; the last run waits for the next batch."""
        held_key, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def work(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            size = np.diff(cuts)
            run_size = np.repeat(size, size)
            for step in range(1, _SHORT):
                near = (key[step:] == key[:-step]) & (run_size[step:] <= _SHORT) & _near(fp[step:], fp[:-step], radius)
                at = np.flatnonzero(near)
                if len(at):
                    yield fp[at], fp[at + step]
            for k in np.flatnonzero(size > _SHORT):
                yield from _forest(fp[cuts[k] : cuts[k + 1]], radius)

        def out(found) -> Iterator[pa.RecordBatch]:
            pairs = list(found)
            if pairs:
                a, b = (np.concatenate([p[k] for p in pairs]).view(np.int64) for k in range(2))
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([held_key, batch.column("key").to_numpy()])
            fp = np.concatenate([held_fp, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(key):
                continue
            done = int(np.searchsorted(key, key[-1]))
            yield from out(work(key[:done], fp[:done]) if done else ())
            held_key, held_fp = key[done:], fp[done:]
        yield from out(work(held_key, held_fp) if len(held_key) else ())

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """links(a, b) that connect what differs in at most `radius` bits; fps: (fp), distinct.

    A key shared by many fingerprints gives a forest of links, not all pairs.
    """
    # each fingerprint becomes some ninety keys, so the small table of fingerprints is kept in as many parts as the keys need
    parts = shuffle_partitions(fps.sparkSession)
    keyed = fps.repartition(parts, "fp").mapInArrow(_key_rows, "key long, fp long")
    runs = keyed.repartition(parts, "key").sortWithinPartitions("key", "fp")
    return runs.mapInArrow(_links(radius), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = RADIUS
) -> DataFrame:
    """One row (id, fingerprint, component_id) per row of `docs`; other columns are not carried.

    Fingerprints (16 hex digits) link at `radius` or fewer differing bits, 4 at most. component_id is the smallest id
    reachable over links, the row's own included; equal fingerprints are always linked. A text of fewer words than a
    shingle is one shingle; null, empty and blank texts have fingerprint zero, linked like any other. Repeated rows
    and ids are kept; null ids stay, and do not become a component's id unless it has no other; no rows give none.

    Search runs on distinct fingerprints, so copies cost nothing; a key shared by many of them gives a forest of
    links, not all pairs.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must be 0 to {RADIUS}")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(_fingerprint_rows(docs, id_col, text_col, shingle), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("_id").alias("first"))
    links = fingerprint_links(classes.select("fp"), radius)
    found = connected_components(links, "a", "b", scratch)
    placed = classes.join(found.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    known = placed.join(least, "component").select("fp", "component_id")
    return rows.join(known, "fp").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one row of each component: that of the smallest id, and of those the least text.

    Fingerprints of the texts' sets of word shingles are searched for pairs within RADIUS bits, as in near_duplicates, and
    these pairs' sets are compared: texts link at a Jaccard similarity of `similarity` or more. Four bits find few pairs
    below 0.95, so MinHash bands name more between what SimHash has left apart (see shingles.py). Texts without words are
    alike. Rows without an id cannot be told from each other: all stay, and they link no others.
    """
    rows, found = shingles.alike(docs, id_col, text_col, shingle, similarity, Scratch(docs.sparkSession), fingerprint_links)
    placed = rows.groupBy("set").agg(F.min("_id").alias("_id")).join(found, "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = placed.groupBy("component").agg(F.min("_id").alias("_id"))
    # rows of one id may have unlike texts, so a row is known by its id and its text's hash
    firsts = placed.join(least, ["component", "_id"]).join(rows, ["set", "_id"])
    firsts = firsts.groupBy("_id").agg(F.collect_set(F.struct("text_hash", "component")).alias("_components"))
    place = Window.partitionBy(id_col, "_component").orderBy(text_col)
    kept = docs.join(firsts.withColumnRenamed("_id", "_first"), F.col(id_col) == F.col("_first"))
    kept = kept.withColumn("_component", F.try_element_at(F.map_from_entries("_components"), F.xxhash64(text_col))).filter("_component is not null")
    kept = kept.withColumn("_place", F.row_number().over(place)).filter("_place = 1")
    return kept.select(docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
