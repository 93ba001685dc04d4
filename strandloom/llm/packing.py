"""Token sequences packed by exact-complement hashing with a best-fit finish.

Texts are tokenized and cut into pieces, and only the histogram of piece lengths goes to the driver: at most `capacity`
numbers, whatever the input. There the plan is made: patterns of lengths that fill a sequence, each with the number of
sequences that use it. Back in Spark the n-th piece of a length is looked up in the plan, which gives its sequence and
place; pieces of a length are numbered without gathering them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import packed as P
from strandloom.llm import textkernels as K
from strandloom.numbering import gapless
from strandloom.scratch import Scratch, shuffle_partitions

CAPACITY = 4096
#: Id written after each document.
END_ID = 1
#: Distinct units whose ids a worker keeps, and slots of its table as a power of two.
CACHED, SLOT_BITS = 3_000_000, 23
#: Units that a table may hold at most, all of its slots being searched one after another.
MOST_UNITS = 6_000_000

#: Classes of bytes: white space, ASCII letter, ASCII punctuation, everything else (digits, apostrophe, controls, high bytes).
_SPACE, _LETTER, _PUNCT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[~K.SPACED] = _SPACE
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = _LETTER
_CLASS[list(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')] = _PUNCT


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of byte runs whose ids do not depend on their neighbours; which of them are plain letters; the bytes to hash.

    A run is a string between white space. One of letters (ASCII or U+00C0 to U+00FF) and then ASCII punctuation is
    two runs, as the vocabulary's pattern separates them; its A-Z are lower-cased, as the normalizer would. All other
    strings stay whole and as they are, for the tokenizer to judge.
    """
    kind = _CLASS[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[lead] = kind[lead + 1] = _LETTER
    starts, ends, _ = K.words(data, offsets, K.SPACED)
    odd = kind == _OTHER
    odd[1:] |= (kind[1:] == _LETTER) & (kind[:-1] == _PUNCT)
    sums = np.concatenate([[0], np.cumsum(odd)])
    plain = (sums[ends] - sums[starts + 1] == 0) & (kind[starts] != _OTHER)
    turns = np.flatnonzero((kind[1:] == _PUNCT) & (kind[:-1] == _LETTER)) + 1
    of = np.searchsorted(starts, turns, "right") - 1
    turns = turns[plain[of] & (turns > starts[of])] if len(turns) else turns
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts[plain]] += 1
    edges[ends[plain]] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    bytes_ = np.where(inside, K.LOWER[data], data)
    starts, ends = np.sort(np.concatenate([starts, turns])), np.sort(np.concatenate([ends, turns]))
    return starts, ends, inside[starts] & (kind[starts] == _LETTER), bytes_


class Ids:
    """Token ids of whole texts, by the tokenizer of a vocabulary file that drops white space and lower-cases.

    Ids of units are kept in a hash table of arrays under a 64-bit hash, CACHED units at most; then it starts anew. Each
    unit's bytes are kept too and compared at every use; one that has another's hash goes to the tokenizer each time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bar = self.tokenizer.encode("|", add_special_tokens=False).ids
        self._clear()

    def _clear(self, slot_bits: int = SLOT_BITS) -> None:
        self.slot_bits = slot_bits
        self.slots = np.full(1 << slot_bits, -1, np.int32)
        self.keys = np.empty(1 << 12, np.uint64)
        self.at = np.zeros((1 << 12) + 1, np.int64)
        self.flat = np.empty(1 << 14, np.uint32)
        self.body_at = np.zeros((1 << 12) + 1, np.int64)
        self.body = np.empty(1 << 14, np.uint8)
        self.n = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        slot = (h >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            held = self.slots[slot[left]]
            left, held = left[held >= 0], held[held >= 0]
            same = self.keys[held] == h[left]
            out[left[same]] = held[same]
            left = left[~same]
            slot[left] = (slot[left] + 1) & ((1 << self.slot_bits) - 1)
        return out

    def _add(self, h: np.ndarray, ids: list[np.ndarray], strings: list[bytes]) -> None:
        m = self.n + len(h)
        while len(self.keys) < m:
            self.keys = np.concatenate([self.keys, np.empty_like(self.keys)])
            self.at, self.body_at = (np.concatenate([x, np.zeros(len(x) - 1, np.int64)]) for x in (self.at, self.body_at))
        self.keys[self.n : m] = h
        self.flat = self._put(self.at, self.flat, [len(x) for x in ids], np.concatenate(ids))
        self.body = self._put(self.body_at, self.body, [len(x) for x in strings], np.frombuffer(b"".join(strings), np.uint8))
        own = np.arange(self.n, m, dtype=np.int32)
        slot = (h >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            self.slots[slot[free]] = own[free]
            left = left[self.slots[slot[left]] != own[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.slot_bits) - 1)
        self.n = m

    def _put(self, at: np.ndarray, flat: np.ndarray, sizes: list[int], values: np.ndarray) -> np.ndarray:
        """`flat`, grown if need be, with the values of new units; `at` gets their ends."""
        end = int(at[self.n])
        while len(flat) < end + len(values):
            flat = np.concatenate([flat, np.empty_like(flat)])
        flat[end : end + len(values)] = values
        at[self.n + 1 : self.n + len(sizes) + 1] = end + np.cumsum(np.array(sizes, np.int64))
        return flat

    def _same(self, index: np.ndarray, bytes_: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of the spans are the bytes of the units that they were taken for."""
        own, sizes = self.body_at[index], ends - starts
        same = self.body_at[index + 1] - own == sizes
        at = np.flatnonzero(same)
        sizes = sizes[at]
        if len(at):
            differ = bytes_[P.ragged(starts[at], sizes)] != self.body[P.ragged(own[at], sizes)]
            same[at] = np.add.reduceat(differ, np.cumsum(sizes) - sizes, dtype=np.int64) == 0
        return same

    def _encode(self, strings: list[bytes], letters: np.ndarray) -> list[np.ndarray]:
        """Strings of letters go in long lines with a bar between; its one id tells their ids apart."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(strings)
        plain = np.flatnonzero(letters).tolist() if len(self.bar) == 1 else []
        for k in range(0, len(plain), 512):
            group = plain[k : k + 512]
            line = self.tokenizer.encode_batch_fast([" | ".join(strings[i].decode() for i in group)], add_special_tokens=False)[0]
            found = np.array(line.ids, np.uint32)
            cuts = np.flatnonzero(found == self.bar[0])
            for i, part in zip(group, np.split(found, cuts), strict=True):
                out[i] = part
            for i in group[1:]:
                out[i] = out[i][1:]
        rest = sorted(set(range(len(strings))).difference(plain))
        for i, x in zip(rest, self.tokenizer.encode_batch([strings[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(x.ids, np.uint32)
        return out

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and n + 1 offsets."""
        if self.n > CACHED:
            self._clear()
        starts, ends, letters, bytes_ = units(data, offsets) if len(data) else (np.empty(0, np.int64),) * 4
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        h = K.mixed(K.span_hashes(bytes_, starts, ends) + (ends - starts).astype(np.uint64))
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if self.n + len(distinct) > MOST_UNITS:
            # a text of very many units, on a table of its own size
            fresh = Ids.__new__(Ids)
            fresh.tokenizer, fresh.bar = self.tokenizer, self.bar
            fresh._clear(max(SLOT_BITS, (2 * len(distinct)).bit_length()))
            return fresh._of(starts, ends, letters, bytes_, distinct, first, inverse, offsets)
        return self._of(starts, ends, letters, bytes_, distinct, first, inverse, offsets)

    def _of(self, starts, ends, letters, bytes_, distinct, first, inverse, offsets) -> tuple[np.ndarray, np.ndarray]:
        index = self._find(distinct)
        new = np.flatnonzero(index < 0)
        if len(new):
            where = first[new]
            strings = [bytes_[s:e].tobytes() for s, e in zip(starts[where], ends[where], strict=True)]
            begun = self.n
            self._add(distinct[new], self._encode(strings, letters[where]), strings)
            index[new] = np.arange(begun, self.n)
        index = index[inverse]
        source, flat = self.at[index], self.flat
        sizes = self.at[index + 1] - source
        other = np.flatnonzero(~self._same(index, bytes_, starts, ends))
        if len(other):
            # another string of the same hash
            found = self._encode([bytes_[s:e].tobytes() for s, e in zip(starts[other], ends[other], strict=True)], letters[other])
            end = int(self.at[self.n])
            flat = np.concatenate([flat[:end], *found])
            sizes[other] = [len(x) for x in found]
            source[other] = end + np.cumsum(sizes[other]) - sizes[other]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.arange(before[-1]) + np.repeat(source - before[:-1], sizes)]
        return ids, before[np.searchsorted(starts, offsets)]


_loaded: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One per worker process, as its table of known units serves all tasks."""
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


_PIECES = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str, *, id_col: str, text_col: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) for each piece of each document. A null or empty text has one piece: the end id."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        end, step = np.array([END_ID], "<u4").tobytes(), capacity * 4
        for batch in batches:
            data, offsets = K.column_bytes(batch.column("_text"))
            for i, j in K.blocks(offsets):
                found, at_ = ids.of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own, piece, start, length, crc, parts = [], [], [], [], [], []
                for k in range(j - i):
                    raw = found[at_[k] : at_[k + 1]].astype("<u4").tobytes() + end
                    for n, at in enumerate(range(0, len(raw), step)):
                        part = raw[at : at + step]
                        own.append(i + k)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            parts.append(np.frombuffer(part, "<u4").astype(np.int32))
                columns = [batch.column("_id").take(pa.array(own, pa.int64())), *(pa.array(v, f.type) for v, f in zip((piece, start, length, crc), _PIECES, strict=True))]
                names = ["_id", *_PIECES.names]
                if with_ids:
                    columns, names = [*columns, pa.array(parts, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(K.trimmed(cut), f"_id {rows.schema['_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


@dataclass(frozen=True)
class Pattern:
    """`times` sequences, each holding `lengths`."""

    lengths: tuple[int, ...]
    times: int


class _Stock:
    """Counts of lengths still to place, with bit sets of the lengths that are there: bit L, and bit capacity - L."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = [0] * (capacity + 1)
        self.up = self.down = 0
        for length, n in counts.items():
            if n:
                self.left[length] = n
                self.up |= 1 << length
                self.down |= 1 << (capacity - length)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            self.up &= ~(1 << length)
            self.down &= ~(1 << (self.capacity - length))

    def largest(self, most: int) -> int:
        return (self.up & ((1 << (most + 1)) - 1)).bit_length() - 1

    def pair(self, gap: int, used: Counter) -> tuple[int, int] | None:
        """Two lengths of sum gap, the larger as large as it gets; used: pieces that the pattern takes already."""
        both = self.up & (self.down >> (self.capacity - gap) if gap <= self.capacity else 0) & ((1 << gap) - 1)
        while both:
            x = both.bit_length() - 1
            y = gap - x
            if y > x:
                return None
            need = used + Counter((x, y))
            if need[x] <= self.left[x] and need[y] <= self.left[y]:
                return x, y
            both &= ~(1 << x)
        return None


def _complement(stock: _Stock, gap: int, used: Counter) -> tuple[int, ...] | None:
    """One, two or three lengths that are there and add up to the gap."""
    if stock.left[gap] > used[gap]:
        return (gap,)
    if found := stock.pair(gap, used):
        return found
    first = stock.largest(gap - 2)
    while first * 3 >= gap and first > 0:
        if stock.left[first] > used[first] and (found := stock.pair(gap - first, used + Counter((first,)))) and found[0] <= first:
            return (first, *found)
        first = stock.largest(first - 1)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use each length exactly as often as `counts` says.

    From the longest length down: complete it exactly with one, two or three lengths if they are there; else add the
    longest that fits (the best fit of what is left) and try again on the smaller gap. A pattern is used as often as
    its counts allow, so each one exhausts a length and there are no more patterns than lengths, plus one a length.
    """
    stock, out = _Stock(counts, capacity), []
    while stock.up:
        first = stock.largest(capacity)
        chosen, gap = [first], capacity - first
        used = Counter(chosen)
        while gap:
            more = _complement(stock, gap, used)
            if more is None:
                best = stock.largest(gap)
                while best > 0 and stock.left[best] <= used[best]:
                    best = stock.largest(best - 1)
                if best <= 0:
                    break
                more = (best,)
            chosen += more
            used.update(more)
            gap -= sum(more)
        times = min(stock.left[x] // n for x, n in used.items())
        for x, n in used.items():
            stock.take(x, n * times)
        out.append(Pattern(tuple(chosen), times))
    return out


def _lookup(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank) with the sequence of that rank and the place in it."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for p in patterns:
        place = 0
        for length in p.lengths:
            rows.append((length, taken[length], sequence, place))
            taken[length] += p.times
            place += length
        sequence += p.times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 4


_RANKS = 48


def pack(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """One row (id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) per piece; other columns are not carried.

    A document is its token ids and then the id 1; only one of more than `capacity` ids is cut, every `capacity` ids. A
    null or empty text is that id alone. Repeated rows are packed each; null ids stay null; an empty table gives no
    rows. Sequences are numbered from 0 and hold at most `capacity` ids; pieces lie in them without gaps.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cut = scratch.keep(pieces(docs, path, id_col=id_col, text_col=text_col, capacity=capacity, with_ids=with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lookup = spark.sparkContext.broadcast(_lookup(plan(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, sequences, places = lookup.value
        keys = (lengths << _RANKS) + ranks
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, (length << _RANKS) + rank, "right") - 1
            out = batch.drop_columns(["_rank"]).append_column("sequence_id", pa.array(sequences[at] + rank - ranks[at]))
            yield out.append_column("offset", pa.array(places[at]))

    salts = shuffle_partitions(spark)
    ranked = gapless(cut, ["length"], F.pmod(F.xxhash64("_id", "piece"), F.lit(salts)).cast("int"), ["_id", "piece"], "_rank")
    kept = [f for f in cut.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    out = ranked.select(*[f.name for f in kept], "_rank").mapInArrow(K.trimmed(place), f"{schema}, sequence_id long, offset long")
    return out.withColumnRenamed("_id", id_col)
