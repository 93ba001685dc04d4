"""Rows of one range or bin packed into a binary value, so that a shuffle moves few, dense rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), np.dtype(a.dtype).num)]], np.int64)
    return zstandard.ZstdCompressor(level=level).compress(b"".join([head.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]]))


_KINDS = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.int32, np.int64, np.uint32, np.uint64)}


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * count, 8)
    at, out = 8 * (1 + 2 * count), []
    for n, kind in head.reshape(-1, 2):
        out.append(np.frombuffer(raw, _KINDS[int(kind)], int(n), at))
        at += int(n) * _KINDS[int(kind)].itemsize
    return out


def joined(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(parts) for parts in zip(*map(unpack, blobs), strict=True)]


def dealt(bins: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bin, its rows of each array)."""
    order = np.argsort(bins, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(bins[order]) != 0, [True]])) if len(bins) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[a:b]
        yield int(bins[rows[0]]), [x[rows] for x in arrays]


def doc_bin(ids: np.ndarray, bins: int) -> np.ndarray:
    return (ids ^ (ids >> 17)) % bins


def range_of(token: np.ndarray, ids: np.ndarray, splits: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The range of (token, id) among sorted splitters."""
    tokens, docs = splits
    low, high = np.searchsorted(tokens, token, "left"), np.searchsorted(tokens, token, "right")
    for k in np.flatnonzero(high > low):
        low[k] += np.searchsorted(docs[low[k] : high[k]], ids[k], "right")
    return low


BLOB = "kind int, bin int, blob binary"


def blob_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, bin_, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bin_, pa.int32()), pa.array(blob, pa.binary())], names=["kind", "bin", "blob"])


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(bin, blobs) of rows that come sorted by bin."""
    now, held = None, []
    for batch in batches:
        for bin_, blob in zip(batch.column("bin").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if bin_ != now and held:
                yield now, held
                held = []
            now = bin_
            held.append(blob)
    if held:
        yield now, held


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def gathered(found: Iterator[tuple[np.ndarray, ...]], kind: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Blob rows of (bins, *arrays), put together over many small finds so that a task sends each bin few rows."""
    held, n = [], 0

    def rows() -> pa.RecordBatch:
        bins, *arrays = (np.concatenate(parts) for parts in zip(*held, strict=True))
        return blob_rows([(kind, b, pack(*x)) for b, x in dealt(bins, *arrays)])

    for arrays in found:
        held.append(arrays)
        n += len(arrays[0])
        if n >= most:
            yield rows()
            held, n = [], 0
    if n:
        yield rows()
