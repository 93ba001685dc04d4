"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over documents.

Words are hashed by array operations over the bytes of many texts; hashes of ten words in a row are looked up in a
bitmap and a sorted array, and each hit is verified word by word against the window itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm import textkernels as K
from strandloom.scratch import Scratch

WINDOW = 10
#: Bytes of one broadcast index, and its bytes for each byte of text at most: a word takes two with what parts it from the
#: next, and has 40 bytes of hash and places. More is worked off in blocks of this size, each over all documents.
BROADCAST_BYTES = 128 << 20
INDEX_BYTES = 22
_BITMAP_BITS = 22


@dataclass
class Windows:
    """Windows in order of their hashes (equal ones may be unequal windows), as places of words in one byte string.

    Window k is the words first[k] to first[k] + size[k] of the items, and stands for the items[at[k] : at[k + 1]].
    """

    hashes: np.ndarray
    first: np.ndarray
    size: np.ndarray
    at: np.ndarray
    items: list[str]
    owner: np.ndarray
    body: bytes
    ends: np.ndarray
    bitmap: np.ndarray

    @property
    def lengths(self) -> list[int]:
        return np.unique(self.size).tolist()

    @property
    def n_bytes(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.first, self.size, self.at, self.owner, self.ends, self.bitmap)) + len(self.body)

    def text(self, k: int) -> bytes:
        """The words of a window, with a space after each."""
        return self.body[int(self.ends[self.first[k]]) : int(self.ends[self.first[k] + self.size[k]])]

    def find(self, h: np.uint64, text: bytes) -> int:
        """The window of these words, or -1."""
        k = int(np.searchsorted(self.hashes, h))
        while k < len(self.hashes) and self.hashes[k] == h:
            if self.text(k) == text:
                return k
            k += 1
        return -1

    def items_of(self, k: int) -> list[str]:
        return [self.items[i] for i in self.owner[self.at[k] : self.at[k + 1]]]


def _scan(texts: list[bytes] | None, data: np.ndarray, offsets: np.ndarray):
    starts, ends, first = K.words(data, offsets, K.ALNUM)
    lowered = K.LOWER[data]
    return lowered, starts, ends, first, K.span_hashes(lowered, starts, ends)


def build_windows(items: list[tuple[object, str | None]], window: int = WINDOW) -> Windows:
    names, parts, hashes, first, size, owner = [], [], [], [], [], []
    ends, n_words = [np.zeros(1, np.int64)], 0
    for item, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        lowered, starts, stops, _, words = _scan(None, data, np.array([0, len(data)]))
        n = min(window, len(starts))
        if not n:
            continue
        plain = [lowered[s:e].tobytes() + b" " for s, e in zip(starts, stops, strict=True)]
        parts += plain
        ends.append(ends[-1][-1] + np.cumsum([len(w) for w in plain]))
        found = K.window_hashes(words, n)
        hashes.append(found)
        first.append(n_words + np.arange(len(found)))
        size.append(np.full(len(found), n))
        owner.append(np.full(len(found), len(names)))
        names.append(str(item))
        n_words += len(plain)
    hashes = np.concatenate([*hashes, np.empty(0, np.uint64)])
    first, size, owner = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (first, size, owner))
    order = np.lexsort((owner, hashes))
    out = Windows(hashes[order], first[order], size[order].astype(np.int32), np.zeros(1, np.int64), names, owner[order].astype(np.int32), b"".join(parts), np.concatenate(ends), np.zeros(1 << _BITMAP_BITS, bool))
    # equal windows become one, with the items of all; windows of one hash are few
    keep, held, at = [], [], [0]
    cuts = np.flatnonzero(np.concatenate([[True], out.hashes[1:] != out.hashes[:-1], [True]])) if len(out.hashes) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own: dict[bytes, tuple[int, list[int]]] = {}
        for k in range(a, b):
            kept, ids = own.setdefault(out.text(k), (k, []))
            if not ids or ids[-1] != out.owner[k]:
                ids.append(int(out.owner[k]))
        for k, ids in own.values():
            keep.append(k)
            held += ids
            at.append(len(held))
    keep = np.array(keep, np.int64)
    out.hashes, out.first, out.size = out.hashes[keep], out.first[keep], out.size[keep]
    out.at, out.owner = np.array(at, np.int64), np.array(held, np.int32)
    out.bitmap[out.hashes >> np.uint64(64 - _BITMAP_BITS)] = True
    return out


def scan_block(data: np.ndarray, offsets: np.ndarray, windows: Windows, covered: list[list] | None = None):
    """Per text of the block: number of words, hit words' runs [(first, last + 1)], items; and the words' byte spans."""
    lowered, starts, ends, first, hashes = _scan(None, data, offsets)
    n = len(first) - 1
    hit = np.zeros(len(starts) + 1, np.int32)
    items: list[set[str]] = [set() for _ in range(n)]
    doc = np.repeat(np.arange(n), np.diff(first))
    for size in windows.lengths:
        sums = K.window_hashes(hashes, size)
        at = np.flatnonzero(windows.bitmap[sums >> np.uint64(64 - _BITMAP_BITS)])
        at = at[at + size <= first[doc[at] + 1]]
        where = np.searchsorted(windows.hashes, sums[at])
        at = at[windows.hashes[np.minimum(where, len(windows.hashes) - 1)] == sums[at]]
        for k in at.tolist():
            own = windows.find(sums[k], b"".join(lowered[starts[j] : ends[j]].tobytes() + b" " for j in range(k, k + size)))
            if own >= 0:
                hit[k] += 1
                hit[k + size] -= 1
                items[doc[k]].update(windows.items_of(own))
    flags = np.cumsum(hit[:-1]) > 0
    for i, spans in enumerate(covered or ()):
        for a, b in spans:
            flags[first[i] + a : first[i] + b] = True
    run_starts, run_ends = K.runs(flags, first[1:-1])
    of = np.searchsorted(first, run_starts, "right") - 1
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i, a, b in zip(of.tolist(), run_starts.tolist(), run_ends.tolist(), strict=True):
        found[i].append((a - int(first[i]), b - int(first[i])))
    return np.diff(first), found, items, starts, ends, first


_SCHEMA = "n_words long, hits array<struct<first:int,end:int>>, items array<string>"
_HITS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _marked(rows: DataFrame, windows, again: bool, clean: bool) -> DataFrame:
    """rows: (_row, _text, ...); adds _SCHEMA. again: rows already have it and it is added to. clean: the text without its hit words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = windows.value
        for batch in batches:
            data, offsets = K.column_bytes(batch.column("_text"))
            old = [batch.column(c).to_pylist() for c in ("hits", "items")] if again else None
            for i, j in K.blocks(offsets):
                at = offsets[i : j + 1] - offsets[i]
                block = data[offsets[i] : offsets[j]]
                before = [[(s["first"], s["end"]) for s in spans] for spans in old[0][i:j]] if old else None
                counts, found, items, starts, ends, first = scan_block(block, at, held, before)
                part = batch.slice(i, j - i)
                if old:
                    items = [x | set(y) for x, y in zip(items, old[1][i:j], strict=True)]
                    part = part.drop_columns(["n_words", "hits", "items"])
                if clean:
                    texts = part.column("_text").to_pylist()
                    for k, spans in enumerate(found):
                        if spans:
                            base, out, cut = int(at[k]), [], 0
                            raw = block[at[k] : at[k + 1]].tobytes()
                            for a, b in spans:
                                out.append(raw[cut : int(starts[first[k] + a]) - base])
                                cut = int(ends[first[k] + b - 1]) - base
                            texts[k] = b"".join([*out, raw[cut:]]).decode()
                    part = part.set_column(part.schema.get_field_index("_text"), "_text", pa.array(texts, pa.string()))
                part = part.append_column("n_words", pa.array(counts, pa.int64()))
                part = part.append_column("hits", pa.array([[{"first": a, "end": b} for a, b in spans] for spans in found], _HITS))
                yield part.append_column("items", pa.array([sorted(x) for x in items], pa.list_(pa.string())))

    kept = [f for f in rows.schema if f.name not in ("n_words", "hits", "items")]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.select(*[f"`{c}`" for c in names], *(["n_words", "hits", "items"] if again else [])).mapInArrow(scan, f"{schema}, {_SCHEMA}")


def _parts(text: str, most: int, window: int) -> Column:
    """A text in parts of about `most` bytes of words; each but the last ends with the window - 1 words that the next begins with."""
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    step = F.greatest(F.floor(F.size(words) * most / (2 * F.octet_length(text))).cast("int"), F.lit(1))
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - window + 1, F.lit(1)), step)
    return F.transform(starts, lambda a: F.array_join(F.slice(words, a, step + window - 1), " "))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, remove_spans: bool = False, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """`docs` with n_words, hits (runs of hit words), items (ids as strings, sorted) and contaminated.

    Words are runs of ASCII letters and digits, lower-cased, and of all other characters from U+0080 on. A window is
    `window` words in a row of an item; an item of fewer words is one window, an item of none (or null) has none. A
    document word is hit if it lies in any occurrence of a window. remove_spans also cuts the hit words out of the
    text, from the first to the last of each run.

    Null and empty documents have no words; repeated rows and equal items are each reported; an empty benchmark leaves
    all clean. Columns of `docs` with one of the four names are replaced; the others stay. A benchmark of more than
    BROADCAST_BYTES of index goes through in blocks, one pass over the documents for each; of a longer item a part that
    shares window - 1 words with the next is an item.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    held = docs.drop(*[c for c in ("n_words", "hits", "items", "contaminated") if c != text_col and c in docs.columns])
    names = [f"c{k}" for k in range(len(held.columns))]
    at = held.columns.index(text_col)
    names[at] = "_text"
    rows = held.toDF(*names)

    source = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    # items that are longer than a block are cut into parts that share window - 1 words, so no window is lost
    most = max(1, broadcast_bytes // INDEX_BYTES)
    source = source.withColumn("text", F.explode_outer(F.when(F.octet_length("text") > most, _parts("text", most, window)).otherwise(F.array("text"))))
    size = source.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    n_blocks = max(1, -(-2 * size // most) if size > most else 1)
    before = None
    for k in range(n_blocks):
        part = source if n_blocks == 1 else source.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        items = [(r["item"], r["text"]) for r in part.collect()]
        windows = spark.sparkContext.broadcast(build_windows(sorted(items, key=str), window))
        rows = _marked(rows, windows, k > 0, remove_spans and k == n_blocks - 1)
        if k < n_blocks - 1:
            rows = scratch.keep(rows, "scanned")
            if before is not None:
                scratch.drop(before)
            before = rows
    out = rows.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, held.columns, strict=True)], "n_words", "hits", "items")
    return out.withColumn("contaminated", F.size("hits") > 0)


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
