"""Vectorised work on a batch of texts held as one byte array: words, their hashes, blocks of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MASK = (1 << 64) - 1
#: Odd, so that its powers have inverses modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
#: Bytes hashed with one table of powers.
_SPAN = 1 << 17
#: Longest span that is hashed by a polynomial.
_PLAIN = 256
#: Texts are worked on in blocks of about so many bytes; a longer text is a block of its own.
BLOCK = 1 << 20

_powers = np.empty(0, np.uint64)
_inverses = np.empty(0, np.uint64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if not len(_powers):
        for value, out in ((_BASE, "_powers"), (pow(_BASE, -1, 1 << 64), "_inverses")):
            steps = np.full(_SPAN + 1, value, np.uint64)
            steps[0] = 1
            globals()[out] = np.cumprod(steps, dtype=np.uint64)
    return _powers, _inverses


def byte_table(inside: bytes = b"", outside: bytes | None = None, high: bool = False) -> np.ndarray:
    """A 256-entry truth table: true for `inside`, or for all but `outside`; `high` adds every byte from 0x80 on."""
    table = np.zeros(256, bool)
    if outside is not None:
        table[:] = True
        table[list(outside)] = False
    table[list(inside)] = True
    if high:
        table[128:] = True
    return table


#: Words of [^\x20\x09-\x0D]+ and, after lower-casing A-Z, of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SPACED = byte_table(outside=b"\x20\x09\x0a\x0b\x0c\x0d")
ALNUM = byte_table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", high=True)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes together, or of one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 entries)."""
    inside = table[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after[offsets[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def trimmed(run: Callable) -> Callable:
    """A function of batches that ends by giving its free memory back to the system: a worker lives on for other tasks."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; starts ascend. Equal bytes give equal hashes."""
    powers, inverses = _tables()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = int(np.searchsorted(starts, low + _SPAN, "right"))
        j = i + int(np.searchsorted(np.maximum.accumulate(ends[i:j]), low + _SPAN, "right"))
        if j == i:  # one span longer than the table
            out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
            i += 1
            continue
        high = int(ends[i:j].max())
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * powers[: high - low], out=sums[1:])
        s = starts[i:j] - low
        out[i:j] = (sums[ends[i:j] - low] - sums[s]) * inverses[s]
        # a polynomial modulo 2**64 cannot tell some strings of 2**10 letters apart, whatever its base
        for k in i + np.flatnonzero(ends[i:j] - starts[i:j] > _PLAIN):
            out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes())
        i = j
    return mixed(out)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k : k + n]
    return mixed(out)


_SPREAD = np.array([[sum(((b >> (4 * half + k)) & 1) << (16 * k) for k in range(4)) for b in range(256)] for half in range(2)], np.uint64)


def majority_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each range of hashes (`bounds`: n + 1 offsets) the bits that are set in over half of them; 0 for an empty one."""
    count = np.diff(bounds)
    out = np.zeros(len(count), np.uint64)
    if not len(hashes):
        return out
    # sums of at most 2^16 - 1 hashes fit the 16-bit lanes
    cuts = [np.arange(a, b, 65535) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
    owner = np.repeat(np.flatnonzero(count), [len(c) for c in cuts])
    cuts = np.concatenate(cuts)
    for byte in range(8):
        value = (hashes >> np.uint64(8 * byte)).astype(np.uint8)
        for half in range(2):
            lanes = np.add.reduceat(_SPREAD[half][value], cuts)
            for k in range(4):
                ones = np.zeros(len(out), np.int64)
                np.add.at(ones, owner, ((lanes >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64))
                out |= (2 * ones > count).astype(np.uint64) << np.uint64(8 * byte + 4 * half + k)
    return out


def runs(flags: np.ndarray, firsts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the true runs; `firsts` are places where a run is cut."""
    if not len(flags):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = np.concatenate([[False], flags[:-1]])
    after = np.concatenate([flags[1:], [False]])
    if firsts is not None:
        at = firsts[(firsts > 0) & (firsts < len(flags))]
        before[at] = False
        after[at - 1] = False
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1
