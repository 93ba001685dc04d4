"""Removal of bytes covered by strings of a fixed length that start in an earlier document.

A sparse suffix array: of the suffixes that start in a document only those at anchors are kept. An anchor is the place
of the least 20-byte hash among the places of a window of `length` bytes, so equal windows have equal anchors at equal
offsets, and all windows of one anchor form one string, its segment.

1. Suffixes at anchors, led by the hash of their first 20 bytes as one token, are dealt to ranges by splitters sampled
   from (token, document); each range sorts its own. A token met in two documents keeps its suffixes; so does one that
   touches the edge of its range, as its run may go on in the next. All others, by far the most, are gone.
2. Segments of kept anchors meet by token. Equal segments need one comparison of documents. Where segments of a token
   differ, their windows are sorted byte word by byte word (multikey quicksort over 8-byte characters: each step sorts
   only what is still tied), and equal neighbours share the smallest document.
3. Runs of removed bytes go back to their documents.

A token of very many suffixes would fill one range with segments that differ only around a common passage. Such tokens are
listed in step 1, a bounded number from each range; in step 2 each window of theirs is a segment of its own, dealt by its
own hash. What lies inside the passage is then equal within a batch, and the rest is spread over all ranges.

Rows between the steps are arrays of one range packed into a binary value, so a shuffle moves few, dense rows. Segments
that are equal within a batch travel once: all but the smallest document's are decided on the spot, which keeps a
passage of very many documents from piling up in one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import packed as P
from strandloom.llm import textkernels as K
from strandloom.scratch import Scratch, release, shuffle_partitions

LENGTH, SEED = 50, 20
#: Ranges and document bins for each shuffle partition; documents and suffixes of each sampled for the splitters.
RANGES, SAMPLED_DOCS, SAMPLED_SUFFIXES = 2, 8, 16
#: A token is hot if it has so many suffixes of a range, and one of this many parts of them: a range has HOT_PARTS at most.
HOT_SUFFIXES, HOT_PARTS = 1000, 16
#: Compression of segments, which overlap each other.
SEGMENT_LEVEL = 6
_PLACE_BITS = 20
_LONG = 1 << 19
#: Bytes of text worked on before rows are passed on, and windows of one range sorted at a time (tokens stay whole).
_FLUSH, _SORTED = 6 << 20, 1 << 17


def _cut(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, byte before, bytes, offsets) of blocks; a text of more than a block comes in overlapping parts."""
    for i, j in K.blocks(offsets, _LONG):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= _LONG:
            yield i, 0, data[a:b], offsets[i : j + 1] - a
        else:
            for base in range(0, max(1, b - a - length + 1), _LONG):
                part = data[a + base : min(b, a + base + _LONG + length - 1)]
                yield i, base, part, np.array([0, len(part)])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(text, place, first window, last window, token) of each anchor; data has fewer than 2**20 bytes."""
    none = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    n = len(data)
    if n < length:
        return none
    at = np.arange(n - seed + 1)
    token = K.span_hashes(data, at, at + seed)
    low = (token >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | at.astype(np.uint64)
    width, have = length - seed + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    starts, ends = offsets[:-1], offsets[1:] - length + 1
    some = ends > starts
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts[some], 1)
    np.add.at(edge, ends[some], -1)
    window = np.flatnonzero(np.cumsum(edge[: len(low)]))
    if not len(window):
        return none
    place = (low[window] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)]))
    first, last = window[new], window[np.concatenate([new[1:], [len(window)]]) - 1]
    text = np.searchsorted(offsets, first, "right") - 1
    return text, place[new], first, last, token[place[new]]


def _suffixes(length: int, splits: Broadcast | None):
    """Suffixes at anchors. Without splitters: a sample of (token, id); else blobs (token, id, place) by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column("_text"))
            ids = batch.column("_id").to_numpy()
            for i, j in K.blocks(offsets, _FLUSH):
                yield from work(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ids[i:j])

    def work(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = []
        for i, base, part, at in _cut(data, offsets, length):
            text, place, _, _, token = anchors(part, at, length)
            found.append((token, ids[i + text], (place - at[text] + base).astype(np.int32)))
        if not found:
            return
        token, own, place = (np.concatenate([f[k] for f in found]) for k in range(3))
        if splits is None:
            step = max(1, len(token) // (SAMPLED_SUFFIXES * max(1, len(ids))))
            yield pa.RecordBatch.from_arrays([pa.array(token[::step].view(np.int64)), pa.array(own[::step])], names=["token", "id"])
        else:
            yield P.blob_rows([(0, b, P.pack(*x)) for b, x in P.dealt(P.range_of(token, own, splits.value), token, own, place)])

    return run


def _shared(bins: int, hot_suffixes: int):
    """Range by range: suffixes whose token is met in two documents, or touches an edge; as blobs (id, place) by document bin.
    And the range's hot tokens."""

    def found(batches: Iterator[pa.RecordBatch], hot: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        for _, blobs in P.groups(batches):
            token, ids, place = P.joined(blobs)
            order = np.lexsort((ids, token))
            token, ids, place = token[order], ids[order], place[order]
            cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.concatenate([cuts, [len(token)]]))
            hot.append(token[cuts[size >= max(hot_suffixes, len(token) // HOT_PARTS)]])
            keep = ids[cuts] != ids[cuts + size - 1]
            keep[0] = keep[-1] = True
            keep = np.repeat(keep, size)
            ids, place = ids[keep], place[keep]
            yield P.doc_bin(ids, bins), ids, place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: list[np.ndarray] = []
        yield from P.gathered(found(batches, hot), 0)
        if sum(map(len, hot)):
            yield P.blob_rows([(_HOT, 0, P.pack(np.concatenate(hot)))])

    return run


_SEGMENTS, _SPANS, _HOT = 1, 2, 3
_OUT = "_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary"
_OUT_ARROW = pa.schema(
    [("_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string()), ("kept", pa.binary())]
)


def _done(doc: int | None, raw: bytes, spans: list[list[int]], with_bytes: bool) -> dict:
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    kept = b"".join([*kept, raw[at:]])
    row = {"_id": doc, "n_bytes": len(raw), "spans": [{"start": a, "end": b} for a, b in spans], "kept_sha256": hashlib.sha256(kept).hexdigest()}
    return row | {"kept": kept if with_bytes else None}


def _segments(length: int, ranges: int, bins: int, hot: Broadcast):
    """Blobs of a document bin come first, then its texts: their segments at kept anchors, by range, and the spans that are decided here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, places = None, [], None, None
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            bin_col, texts = batch.column("bin").to_numpy(), batch.column("_text")
            blobs = batch.column("blob").to_pylist()
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(bin_col) != 0, [True]])) if batch.num_rows else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if bin_col[a] != now:
                    now, held, ids = int(bin_col[a]), [], None
                while a < b and blobs[a] is not None:
                    held.append(blobs[a])
                    a += 1
                if a == b:
                    continue
                if ids is None:
                    ids, places = P.joined(held) if held else (np.empty(0, np.int64), np.empty(0, np.int32))
                    order = np.lexsort((places, ids))
                    ids, places, held = ids[order], places[order], []
                data, offsets = K.column_bytes(texts.slice(a, b - a))
                own = batch.column("_id").slice(a, b - a).to_pylist()
                for i, j in K.blocks(offsets, _FLUSH):
                    parts += _found(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], own[i:j], ids, places)
                    if sum(len(p[-1]) for p in parts) >= 2 * _FLUSH:
                        yield _sent(parts)
                        parts = []
        if parts:
            yield _sent(parts)

    def _found(data, offsets, own, ids, places) -> list[tuple[np.ndarray, ...]]:
        """(token, id, mark, start, size, bytes) of the segments at kept places."""
        known = np.array([x is not None for x in own], bool)
        own = np.array([x or 0 for x in own], np.int64)
        low, high = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        wanted = np.flatnonzero(known & (high > low))
        own, low, high, sizes = own[wanted], low[wanted], high[wanted], np.diff(offsets)[wanted]
        marks = np.array([xxhash.xxh64_intdigest(data[offsets[k] : offsets[k + 1]].tobytes()) for k in wanted], np.uint64)
        # texts in a row, and the kept places as (text, place) numbers in order
        data, offsets = data[P.ragged(offsets[wanted], sizes)], np.concatenate([[0], np.cumsum(sizes)])
        kept = (np.repeat(np.arange(len(wanted)), high - low) << 40) | places[P.ragged(low, high - low)]
        parts = []
        for i, base, piece, at in _cut(data, offsets, length):
            text, place, first, last, token = anchors(piece, at, length)
            number = ((i + text) << 40) | (place - at[text] + base)
            ok = kept[np.minimum(np.searchsorted(kept, number), len(kept) - 1)] == number
            text, first, last, token = text[ok], first[ok], last[ok], token[ok]
            if len(hot.value) and (wide := np.isin(token, hot.value)).any():
                # each window of a hot token is a segment; windows of all others stay together
                counts = np.where(wide, last - first + 1, 1)
                one = np.repeat(wide, counts)
                first = P.ragged(first, counts)
                text, last, token = np.repeat(text, counts), np.where(one, first, np.repeat(last, counts)), np.repeat(token, counts)
                token[one] = K.mixed(K.span_hashes(piece, first[one], first[one] + length) ^ K.mixed(token[one]))
            sizes = last + length - first
            parts.append((token, own[i + text], marks[i + text], first - at[text] + base, sizes, piece[P.ragged(first, sizes)]))
        return parts

    def _sent(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        token, doc, mark, start, size, body = (np.concatenate([p[k] for p in parts]) for k in range(6))
        if not len(token):
            return P.blob_rows([])
        ends = np.cumsum(size)
        whole = K.span_hashes(body, ends - size, ends)
        order = np.lexsort((doc, whole, token))
        new = np.concatenate([[True], (token[order][1:] != token[order][:-1]) | (whole[order][1:] != whole[order][:-1])])
        least = doc[order][new][np.cumsum(new) - 1]
        go = np.zeros(len(token), bool)
        go[order] = doc[order] == least
        here = ~go
        blobs = [(_SPANS, b, P.pack(*x)) for b, x in P.dealt(P.doc_bin(doc[here], bins), doc[here], mark[here], start[here], start[here] + size[here])]
        edges = np.uint64(((1 << 64) - 1) // ranges + 1)
        for b, (rows_,) in P.dealt((K.mixed(token[go]) // edges).astype(np.int64), np.flatnonzero(go)):
            s = size[rows_]
            packed = body[P.ragged(ends[rows_] - s, s)]
            blobs.append((_SEGMENTS, b, P.pack(token[rows_], doc[rows_], mark[rows_], start[rows_], s, packed, level=SEGMENT_LEVEL)))
        return P.blob_rows(blobs)

    return run


def multikey_groups(words: np.ndarray) -> np.ndarray:
    """The group of each row among rows of equal 8-byte words: sorted by the first word, ties by the next, and so on."""
    group = np.zeros(len(words), np.int64)
    tied = np.arange(len(words))
    for column in range(words.shape[1]):
        if not len(tied):
            break
        key = words[tied, column]
        order = np.lexsort((key, group[tied]))
        tied, key = tied[order], key[order]
        before = group[tied]
        new = np.concatenate([[True], (before[1:] != before[:-1]) | (key[1:] != key[:-1])])
        fresh = np.cumsum(new) - 1
        size = np.bincount(fresh)
        group[tied] = group.max() + 1 + fresh
        tied = tied[size[fresh] > 1]
    return group


def _spans_of(length: int, bins: int):
    """Range by range: segments of a token against each other; spans as blobs (id, mark, start, end) by document bin.
    Spans that come along go on as they are."""

    def segments(batches: Iterator[pa.RecordBatch], mixed: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come segments first: ends with the first batch that has spans, whose spans are put aside."""
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            yield batch.filter(pa.array(kinds == _SEGMENTS))
            if (kinds == _SPANS).any():
                mixed.append(batch.filter(pa.array(kinds == _SPANS)))
                return

    def least_of_windows(body: np.ndarray, at: np.ndarray, counts: np.ndarray, token: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each window of the segments that start at `at`: the smallest document with an equal window."""
        window = P.ragged(at, counts)
        table = np.zeros((len(window), -(-length // 8) * 8), np.uint8)
        for k in range(length):
            table[:, k] = body[window + k]
        words = np.concatenate([np.repeat(token, counts).astype(np.uint64)[:, None], table.view(">u8").astype(np.uint64)], axis=1)
        _, group = np.unique(multikey_groups(words), return_inverse=True)
        first = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, group, np.repeat(least, counts))
        return first[group]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for _, blobs in P.groups(batches):
            token, doc, mark, start, size, body = P.joined(blobs)
            at = np.cumsum(size) - size
            whole = K.span_hashes(body, at, at + size)
            order = np.lexsort((doc, whole, token))
            token, doc, mark, start, size, whole, at = (x[order] for x in (token, doc, mark, start, size, whole, at))
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (whole[1:] != whole[:-1])])
            kind = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            least = doc[heads]
            same_token = np.concatenate([[True], token[heads][1:] != token[heads][:-1]])
            of_token = np.cumsum(same_token) - 1
            alone = (np.bincount(of_token) == 1)[of_token]
            whole_gone = alone[kind] & (least[kind] < doc)
            out = [(doc[whole_gone], mark[whole_gone], start[whole_gone], (start + size)[whole_gone])]
            # windows of the different segments of a token, some tokens at a time
            many = np.flatnonzero(~alone)
            n_windows = size[heads] - length + 1
            if len(many):
                before = np.cumsum(n_windows[many]) - n_windows[many]
                opening = np.flatnonzero(np.concatenate([[True], np.diff(of_token[many]) != 0]))
                cuts = opening[np.unique(before[opening] // _SORTED, return_index=True)[1]]
                last = np.concatenate([heads[1:], [len(doc)]])
                for x, y in zip(cuts, np.concatenate([cuts[1:], [len(many)]]), strict=True):
                    own = many[x:y]
                    gone = least_of_windows(body, at[heads[own]], n_windows[own], of_token[own], least[own])
                    rows = P.ragged(heads[own], last[own] - heads[own])
                    which = np.repeat(np.arange(len(own)), last[own] - heads[own])
                    counts = n_windows[own][which]
                    first = np.cumsum(n_windows[own]) - n_windows[own]
                    over = gone[P.ragged(first[which], counts)] < np.repeat(doc[rows], counts)
                    ends = np.cumsum(counts)
                    s, e = K.runs(over, ends)
                    row = np.searchsorted(ends, s, "right")
                    inside = s - (ends - counts)[row]
                    rows = rows[row]
                    out.append((doc[rows], mark[rows], start[rows] + inside, start[rows] + inside + (e - s) + length - 1))
            doc, mark, a, b = (np.concatenate([o[k] for o in out]) for k in range(4))
            yield P.doc_bin(doc, bins), doc, mark, a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixed: list[pa.RecordBatch] = []
        yield from P.gathered(found(segments(batches, mixed)), _SPANS)
        yield from mixed
        yield from batches

    return run


def _removed(with_bytes: bool):
    """Span blobs of a document bin come first, then its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, spans = None, [], None
        for batch in batches:
            rows = []
            for bin_, blob, own, text in zip(*(batch.column(c).to_pylist() for c in ("bin", "blob", "_id", "_text")), strict=True):
                if bin_ != now:
                    now, held, spans = bin_, [], None
                if blob is not None:
                    held.append(blob)
                    continue
                if spans is None:
                    spans = P.joined(held) if held else [np.empty(0, np.int64)] * 4
                    order = np.lexsort((spans[2], spans[0]))
                    spans, held = [x[order] for x in spans], []
                a, b = (0, 0) if own is None else np.searchsorted(spans[0], [own, own + 1], "left")
                mine = spans[1][a:b].astype(np.uint64) == np.uint64(xxhash.xxh64_intdigest(text)) if b > a else slice(0, 0)
                merged: list[list[int]] = []
                for s, e in zip(spans[2][a:b][mine].tolist(), spans[3][a:b][mine].tolist(), strict=True):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                rows.append(_done(own, text, merged, with_bytes))
            yield pa.RecordBatch.from_pylist(rows, schema=_OUT_ARROW)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_bytes: bool = False, hot_suffixes: int = HOT_SUFFIXES) -> DataFrame:
    """One row (id, n_bytes, spans, kept_sha256[, kept]) per row of `docs`; other columns are not carried.

    spans: maximal runs of removed bytes, (start, end) in the UTF-8 text; a byte is removed if some string of `length`
    bytes that covers it also starts in a document of a smaller id, as judged on the input. Matches never cross
    documents. A null text is empty. Rows without an id lose nothing and count for no other; rows of equal ids do not
    count as earlier than each other; no rows give none. Ids are integers. hot_suffixes only spreads work.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    parts = shuffle_partitions(spark)
    ranges = bins = RANGES * parts + 1
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    named = rows.filter(F.col("_id").isNotNull())

    share = min(1.0, SAMPLED_DOCS * parts / max(docs.count(), 1))
    sample = sorted((r[0] % (1 << 64), r[1]) for r in named.sample(share, 5).mapInArrow(_suffixes(length, None), "token long, id long").collect())
    picked = [sample[k * len(sample) // ranges] for k in range(1, ranges)] if sample else []
    splits = spark.sparkContext.broadcast((np.array([p[0] for p in picked], np.uint64), np.array([p[1] for p in picked], np.int64)))

    suffixes = named.mapInArrow(_suffixes(length, splits), P.BLOB).repartition(parts, "bin").sortWithinPartitions("bin")
    shared = scratch.keep(suffixes.mapInArrow(_shared(bins, hot_suffixes), P.BLOB), "shared")
    release(spark)

    place = F.coalesce(F.pmod(F.col("_id").bitwiseXOR(F.shiftright("_id", 17)), F.lit(bins)), F.pmod(F.xxhash64("_text"), F.lit(bins))).cast("int")
    texts = rows.select(place.alias("bin"), F.lit(None).cast("binary").alias("blob"), "_id", "_text")
    blobs = lambda frame: frame.select("bin", "blob", F.lit(None).cast("long").alias("_id"), F.lit(None).cast("binary").alias("_text"))
    listed = [P.unpack(bytes(r["blob"]))[0] for r in shared.filter(F.col("kind") == _HOT).collect()]
    hot = spark.sparkContext.broadcast(np.unique(np.concatenate(listed)) if listed else np.empty(0, np.uint64))
    met = blobs(shared.filter(F.col("kind") != _HOT)).unionByName(texts).repartition(parts, "bin").sortWithinPartitions("bin", F.col("blob").isNull())
    by_range = met.mapInArrow(_segments(length, parts + 1, bins, hot), P.BLOB).repartition(parts, "bin").sortWithinPartitions("kind", "bin")
    spans = scratch.keep(by_range.mapInArrow(_spans_of(length, bins), P.BLOB), "spans")
    scratch.drop(shared)
    release(spark)

    last = blobs(spans).unionByName(texts).repartition(parts, "bin").sortWithinPartitions("bin", F.col("blob").isNull())
    done = last.mapInArrow(_removed(with_bytes), _OUT)
    return done.select(F.col("_id").alias(id_col), "n_bytes", "spans", "kept_sha256", *(["kept"] if with_bytes else []))
