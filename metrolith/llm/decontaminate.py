"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping segments. A text that holds a segment
with at most ``e`` edits shares ``len + 1 - q * (e + 1)`` of its character
q-grams, all on diagonals (text position - segment position) that lie within
``e`` of each other. Shared q-grams are therefore counted in overlapping
diagonal bands, bands that reach the bound are kept, and what they mark is
aligned within the band. q is 8, so that a q-gram of bytes is one 64-bit word
and equality of q-grams is exact. Long items are also cut into short segments
at a stride no larger than their edit budget, so an excerpt may begin anywhere.
Items too short for the lemma are found as whole words without edits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _P, _P_INV, U64, _power, batched, concat_ranges, mix, pieces, runs, small, text_buffer

Q = 8
_BITS = 20
#: Pairs of a hit and a place in an item that are looked at together.
TILE = 100_000
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


def normalise(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case ASCII and Latin-1 letters, other ASCII to single spaces.

    Returns bytes, document offsets, and each byte's place in the input."""
    out = _TABLE[buf]
    upper = np.zeros(buf.size, bool)
    upper[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    out[upper] += 0x20
    space = out == 0x20
    keep = ~space
    keep[1:] |= ~space[:-1]
    place = np.flatnonzero(keep)
    return out[place], np.searchsorted(place, at), place


def grams(buf: np.ndarray) -> np.ndarray:
    n = buf.size - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data, out = buf.tobytes(), np.empty(n, np.uint64)
    for k in range(min(Q, n)):
        part = out[k::Q]
        part[:] = np.frombuffer(data, "<u8", part.size, k)
    return out


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)


@dataclass
class Segments(Sequence):
    """Parts of one buffer, cut out when asked for."""

    text: bytes
    start: np.ndarray
    end: np.ndarray

    def __len__(self) -> int:
        return self.start.size

    def __getitem__(self, k: int) -> bytes:
        return self.text[self.start[k] : self.end[k]]


@dataclass
class Index:
    segments: Segments
    item: np.ndarray  # item_id of each segment
    edits: np.ndarray
    least: np.ndarray  # shared q-grams that the lemma asks for
    values: np.ndarray  # distinct q-grams, sorted
    begin: np.ndarray  # of each q-gram's postings
    where: np.ndarray  # posting: position in the text of all items
    groups: list[tuple[int, int]]  # segments [lo, hi) whose starts and ends both rise
    slots: np.ndarray
    density: list[tuple[int, int]]  # (positions of a window, shared q-grams in it) by class of segment length
    short: dict[int, tuple[np.ndarray, dict[bytes, int]]]  # by length: sorted hashes, and items


def _hashes(buf: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """A hash of the bytes of each window, the same wherever it stands."""
    n = buf.size
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U64)
        np.cumsum((buf.astype(U64) + U64(1)) * _power("p", _P, n), out=total[1:])
        return mix((total[begin + length] - total[begin]) * _power("q", _P_INV, n)[begin])


def build_index(items: list[tuple[int, str]], error: float = 0.06, min_chars: int = 32, segment: int = 160, fine: int = 64) -> Index:
    """Items of equal normalised text count once, under the smallest item_id;
    null and empty ones take no part. Those under ``min_chars`` normalised bytes
    are matched whole; those over ``segment`` are cut into segments of that
    length and, closely, into ones of ``fine`` bytes."""
    texts: dict[bytes, int] = {}
    for item, text in items:
        if item is None or text is None:
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        t = normalise(raw, np.array([0, raw.size]))[0].tobytes().strip()
        if t:
            texts[t] = min(item, texts.get(t, item))
    short: dict[int, tuple[np.ndarray, dict[bytes, int]]] = {}
    for t in [t for t in texts if len(t) < max(min_chars, Q)]:
        short.setdefault(len(t), (np.zeros(0, U64), {}))[1][t] = texts.pop(t)
    for n, (_, of) in short.items():
        short[n] = (np.unique([_hashes(np.frombuffer(t, np.uint8), np.zeros(1, np.int64), n)[0] for t in of]), of)
    order = sorted(texts.items(), key=lambda x: x[1])
    buffer = b"".join(t for t, _ in order)
    wide, close = [], []
    at = 0
    step = max(1, int(fine * error))
    for t, item in order:
        n = len(t)
        cuts = [0] if n <= segment else [*range(0, n - segment, segment // 2), n - segment]
        wide += [(at + c, at + min(c + segment, n), item) for c in cuts]
        if n > segment > fine:
            close += [(at + c, at + c + fine, item) for c in [*range(0, n - fine, step), n - fine]]
        at += n
    start, end, owners = (np.array([x[k] for x in [*wide, *close]], np.int64) for k in range(3))
    length = end - start
    edits = (length * error).astype(np.int64)
    least = length + 1 - Q * (edits + 1)
    data = np.frombuffer(buffer, np.uint8)
    edge = np.cumsum([0, *(len(t) for t, _ in order)])
    where = concat_ranges(edge[:-1], np.diff(edge) - Q + 1)
    g = grams(data)[where] if where.size else np.zeros(0, np.uint64)
    by = np.argsort(g, kind="stable")
    g, where = g[by], where[by]
    at = runs(g)
    slots = np.zeros(1 << _BITS, bool)
    slots[_slot(g)] = True
    density = []
    if length.size:
        kind = np.floor(np.log(length / length.min()) / np.log(1.2) + 1e-9).astype(int)
        density = [(int((length - Q + 1 + edits)[kind == c].max()), int(least[kind == c].min())) for c in np.unique(kind)]
    groups = [(0, len(wide)), (len(wide), length.size)]
    return Index(Segments(buffer, start, end), owners, edits, least, g[at[:-1]], at, where, groups, slots, density, short)


def banded(segment: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Fewest edits between the segment and a part of the text that begins in
    the band ``len(text) - len(segment)`` wide; and where that part ends."""
    band = text.size - segment.size
    if band < 0:
        return segment.size, 0
    step = np.arange(band + 1)
    d = np.zeros(band + 1, np.int64)
    for i, c in enumerate(segment):
        v = d + (text[i : i + band + 1] != c)
        v[:-1] = np.minimum(v[:-1], d[1:] + 1)
        d = np.minimum.accumulate(v - step) + step
    k = int(np.argmin(d))
    return int(d[k]), segment.size + k


def matches(buf: np.ndarray, at: np.ndarray, ix: Index) -> list[tuple[int, int, int, int, int]]:
    """(document ordinal, item, begin, end, edits) for whole texts; begin and end
    are byte offsets in the document."""
    origin = at
    text, at, place = normalise(buf, at)
    best = _long(text, at, ix)
    for d, item, lo, hi in _short(text, at, ix):
        _widen(best, (d, item), 0, lo, hi)
    return [(d, item, int(place[lo] - origin[d]), int(place[hi - 1] - origin[d]) + 1, edits) for (d, item), (edits, lo, hi) in sorted(best.items())]


def _widen(best: dict, where: tuple[int, int], edits: int, lo: int, hi: int) -> None:
    have = best.get(where)
    best[where] = (edits, lo, hi) if have is None else (min(have[0], edits), min(have[1], lo), max(have[2], hi))


def _short(text: np.ndarray, at: np.ndarray, ix: Index) -> Iterator[tuple[int, int, int, int]]:
    """(document ordinal, item, begin, end) of short items as whole words."""
    if not ix.short or not text.size:
        return
    solid = text != 0x20
    first, last = solid.copy(), np.zeros(text.size + 1, bool)
    first[1:] &= ~solid[:-1]
    last[1:] = solid
    last[1:-1] &= ~solid[1:]
    edge = at[:-1][np.diff(at) > 0]
    first[edge] = solid[edge]
    last[at[1:][np.diff(at) > 0]] = solid[at[1:][np.diff(at) > 0] - 1]
    begin = np.flatnonzero(first)
    stop = at[np.searchsorted(at, begin, "right")]
    for n, (known, of) in ix.short.items():
        b = begin[begin + n <= stop]
        b = b[last[b + n]]
        if not b.size:
            continue
        h = _hashes(text, b, n)
        b = b[known[np.minimum(np.searchsorted(known, h), known.size - 1)] == h]
        for x, d in zip(b.tolist(), (np.searchsorted(at, b, "right") - 1).tolist()):
            item = of.get(text[x : x + n].tobytes())
            if item is not None:
                yield d, item, x, x + n


def _long(text: np.ndarray, at: np.ndarray, ix: Index) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(document ordinal, item) with fewest edits, begin and end of its segments found."""
    if not len(ix.segments) or text.size < Q:
        return {}
    g = grams(text)
    pos = np.flatnonzero(ix.slots[_slot(g)])
    if not pos.size:
        return {}
    k = np.minimum(np.searchsorted(ix.values, g[pos]), ix.values.size - 1)
    same = ix.values[k] == g[pos]
    pos, k = pos[same], k[same]
    #: positions near a window that holds enough shared q-grams of some class of segments
    near = np.zeros(g.size + 1, np.int32)
    length = ix.segments.end - ix.segments.start
    reach = int(length.max() + ix.edits.max())
    for width, least in ix.density:
        #: a window that holds enough may begin with a hit, so windows are tried at hits only
        if pos.size < least:
            continue
        first = np.flatnonzero(pos[least - 1 :] - pos[: pos.size - least + 1] < width)
        if first.size:
            np.add.at(near, np.maximum(pos[first] - reach, 0), 1)
            np.add.at(near, np.minimum(pos[first] + width + reach, g.size), -1)
    if not near.any():
        return {}
    marked = np.cumsum(near)[pos] > 0
    pos, k = pos[marked], k[marked]
    doc = np.searchsorted(at, pos, "right") - 1
    whole = pos + Q <= at[doc + 1]
    pos, k, doc = pos[whole], k[whole], doc[whole]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    #: hits are taken in tiles of bounded work that overlap by more than any match is long,
    #: so that a repetitive text against a repetitive item stays within memory
    work = np.concatenate(([0], np.cumsum(ix.begin[k + 1] - ix.begin[k])))
    overlap, lo = 2 * reach + Q, 0
    while lo < pos.size:
        hi = max(int(np.searchsorted(work, work[lo] + TILE, "right")) - 1, int(np.searchsorted(pos, pos[lo] + 2 * overlap, "right")))
        _align(text, at, ix, pos[lo:hi], k[lo:hi], doc[lo:hi], reach, best)
        if hi >= pos.size:
            break
        lo = max(lo + 1, int(np.searchsorted(pos, pos[hi - 1] - overlap)))
    return best


def _align(text: np.ndarray, at: np.ndarray, ix: Index, pos: np.ndarray, k: np.ndarray, doc: np.ndarray, reach: int, best: dict) -> None:
    """Count the hits in bands and align where a band holds enough of them."""
    n = ix.begin[k + 1] - ix.begin[k]
    post = concat_ranges(ix.begin[k], n)
    spot, pos, doc = ix.where[post], np.repeat(pos, n), np.repeat(doc, n)
    found = []
    for lo, hi in ix.groups:
        #: the segments that hold the whole q-gram
        head = lo + np.searchsorted(ix.segments.end[lo:hi], spot + Q, "left")
        n = np.maximum(lo + np.searchsorted(ix.segments.start[lo:hi], spot, "right") - head, 0)
        found.append((concat_ranges(head, n), np.repeat(spot, n), np.repeat(pos, n), np.repeat(doc, n)))
    seg, spot, pos, doc = (np.concatenate(x) for x in zip(*found))
    diagonal = pos - (spot - ix.segments.start[seg]) + reach
    band = diagonal // (ix.edits[seg] + 1)
    pair, which = np.unique(doc * len(ix.segments) + seg, return_inverse=True)
    bands = int(band.max(initial=0)) + 2
    key, total = np.unique(np.concatenate([which * bands + band + 1, which * bands + band]), return_counts=True)
    pair, band = pair[key // bands], key % bands - 1
    seg, doc = pair % len(ix.segments), pair // len(ix.segments)
    full = total >= ix.least[seg]
    for d, s, b in zip(doc[full].tolist(), seg[full].tolist(), band[full].tolist()):
        e = int(ix.edits[s])
        pattern = np.frombuffer(ix.segments[s], np.uint8)
        lo, hi = int(at[d]), int(at[d + 1])
        begin = b * (e + 1) - reach
        lo, hi = max(lo, begin - e), min(hi, begin + 2 * (e + 1) + pattern.size + e)
        where = (d, int(ix.item[s]))
        #: what can be found here changes nothing
        if (have := best.get(where)) and have[0] == 0 and have[1] <= lo and hi <= have[2]:
            continue
        part = text[lo:hi]
        if part.size < pattern.size:
            part = np.concatenate([part, np.zeros(pattern.size - part.size + e, np.uint8)])
        #: an exact copy needs no alignment; the band still has to hold it
        start = part.tobytes().find(ix.segments[s])
        if start >= 0:
            edits, end = 0, start + pattern.size
        else:
            edits, end = banded(pattern, part)
            if edits > e:
                continue
            back = part[:end][::-1]
            if back.size < pattern.size + e:
                back = np.concatenate([back, np.zeros(pattern.size + e - back.size, np.uint8)])
            start = end - banded(pattern[::-1], back[: pattern.size + e])[1]
            end = min(end, hi - lo)
            start = min(max(start, 0), end - 1)
        _widen(best, where, edits, lo + start, lo + end)


def _items(benchmark: DataFrame, slice_bytes: int) -> tuple[DataFrame, int]:
    """item_id, text: the least item of each normalised text; and the number of slices."""
    plain = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            raw = [np.frombuffer(t.encode(), np.uint8) for t in batch.column("text").to_pylist()]
            texts = [normalise(r, np.array([0, r.size]))[0].tobytes().strip().decode() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(texts, pa.string())], ["item_id", "text"])

    items = plain.mapInArrow(run, "item_id long, text string").groupBy("text").agg(F.min("item_id").alias("item_id"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return items, max(1, -(-size // slice_bytes))


def _indexes(docs: DataFrame, benchmark: DataFrame, slice_bytes: int, **options):
    """The broadcast index of each slice of the benchmark."""
    items, slices = _items(benchmark, slice_bytes)
    batched(docs)
    for k in range(slices):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k).select("item_id", "text").collect()
        yield docs.sparkSession.sparkContext.broadcast(build_index([(r[0], r[1]) for r in rows], **options))


def contaminated(docs: DataFrame, benchmark: DataFrame, error: float = 0.06, min_chars: int = 32, segment: int = 160, slice_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, begin, end, edits: each benchmark item found in a document.

    begin and end are byte offsets of the first and last byte found. The
    benchmark is broadcast in slices of about ``slice_bytes`` at most, so its
    size is not bounded by what one broadcast can hold. Null texts and empty
    tables match nothing; repeated documents give repeated rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, begin long, `end` long, edits int"
    found = None
    for shared in _indexes(docs, benchmark, slice_bytes, error=error, min_chars=min_chars, segment=segment):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                got = matches(*text_buffer(batch.column("text")), shared.value)
                ids = batch.column("doc_id").take(pa.array([x[0] for x in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[i] for x in got], t) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.int32())))], ["doc_id", "item_id", "begin", "end", "edits"])

        part = plain.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = 16 << 20, **options) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns.

    The decision is made on each row's own text, never by its doc_id: rows
    without doc_id are kept if their text is clean. Where the benchmark takes
    several slices, texts are named by their digest and scanned once a slice.
    """
    indexes = list(_indexes(docs, benchmark, slice_bytes, **options))
    if len(indexes) == 1:

        def run(batches: Iterator[pa.RecordBatch], shared=indexes[0]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                dirty = {x[0] for x in matches(*text_buffer(batch.column("text")), shared.value)}
                yield batch.filter(pa.array([i not in dirty for i in range(batch.num_rows)]))

        return docs.mapInArrow(run, docs.schema)
    keyed = docs.withColumn("__text", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    found = None
    for shared in indexes:

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                dirty = sorted({x[0] for x in matches(*text_buffer(batch.column("text")), shared.value)})
                yield pa.RecordBatch.from_arrays([batch.column("__text").take(pa.array(dirty, pa.int64()))], ["__text"])

        part = keyed.select("__text", F.col("text").cast("string").alias("text")).mapInArrow(run, "__text string")
        found = part if found is None else found.unionByName(part)
    return keyed.join(small(found.distinct()), "__text", "left_anti").select(*docs.columns)
