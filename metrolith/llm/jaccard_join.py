"""N-gram Jaccard join: a size-aware heavy-light join over shingle sets.

Documents with equal shingle sets are one class (named after a 128-bit digest of
the set); the join runs over classes. All sets are ordered by one global order
of shingles (rare before frequent, then by hash). Two sets of which the larger
has ``n`` shingles share at least ``t(n)`` of them if they link, hence

* light sets (up to ``boundary`` shingles) share two of the first
  ``n - t(n) + 2``: they are found by enumerating all 2-subsets of these;
* heavy sets share one of the first ``n - t(n) + 1``: they scan the inverted
  lists of these, which hold every set that is large enough to link to one.

The boundary is the size at which the two kinds of work cost least, computed
from the histogram of sizes and the measured mean length of lists.

Near copies, whose pairs grow with the square of a group, are never listed:

1. *Homes.* A set with a frequent shingle in its prefix joins the sets of the
   longest of its lists (and of one more), in blocks; all links inside a block
   are found exactly and leave the task as a star to one representative.
2. *Lists.* All lists are scanned. A pair whose components differ and that
   sizes, positions and bit maps allow becomes a visit: the set of the smaller
   component visits the other component, once, whatever the number of pairs.
3. *Visits.* A visitor is compared with all sets of the component, exactly; one
   link a visit is kept. As every linking pair shares a list, the components
   are then complete.
4. *Counts.* Links lie inside components: of those with three or more classes
   all sets are compared in pairs of blocks, and only the counts leave a task.

So what is written and shuffled grows with sets, visits and blocks; the number
of comparisons inside a group of near copies is that of its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, batched, binary, concat_ranges, mix, packed, pieces, ranges_of, runs, shuffle_partitions, small, text_buffer, unpacked, windows, words, written
from .components import components

_KEY_BITS = 48
MAX_HOT = 1 << 20
#: Lists of more entries have bit maps, and are homes.
SHORT = 16
#: Most 64-bit words of a bit map.
MAP_WORDS = 8
#: Sets, and shingles, that a block of a group holds.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1 << 20
_NO_ID = -(1 << 63)


def shingle_sets(buf: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document in ascending order, and where each
    document's begin. A document of fewer than ``size`` words has one shingle."""
    _, _, h, first = words(buf, at, lower=True)
    count = np.diff(first)
    out, start = windows(h, first, size)
    doc = np.repeat(np.arange(count.size), np.maximum(count - size + 1, 0))
    hashes, docs = [out], [doc]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if short.size:
            w = h[first[short][:, None] + np.arange(n)]
            x = np.full(short.size, n, U64)
            for j in range(n):
                x = mix(x * U64(0x9FB21C651E98DF25) + w[:, j])
            hashes.append(x)
            docs.append(short)
    x, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    new = np.ones(x.size, bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    x, d = x[new], d[new]
    return x, np.searchsorted(d, np.arange(count.size + 1))


def _overlap(n, percent: int):
    """Least overlap of a set of n with any set that it links to."""
    return -(-n * percent // 100)


def _keys(h: np.ndarray) -> np.ndarray:
    return mix(h ^ U64(0x5851F42D4C957F2D)) >> U64(64 - _KEY_BITS)


def _map_words(n: np.ndarray) -> np.ndarray:
    """Length of the bit map of a set of n, in 64-bit words."""
    return np.minimum(MAP_WORDS, np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 2) / 2)).astype(np.int64)) // 64)


def _bit_maps(x: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A bit for each shingle, added modulo 2: sets of n get the power of two from
    n / 2 on as their number of bits, within 64 and 64 * MAP_WORDS. Bits that differ
    between two maps are shingles that differ."""
    n = np.diff(at)
    bits = 64 * _map_words(n)
    start = np.concatenate(([0], np.cumsum(bits)))
    owner = np.repeat(np.arange(n.size), n)
    place = start[owner] + (mix(x ^ U64(0x2545F4914F6CDD1D)).view(np.int64) & (bits - 1)[owner])
    flat = np.packbits(np.bincount(place, minlength=int(start[-1])).astype(np.uint8) & 1, bitorder="little").tobytes()
    return [flat[a // 8 : b // 8] for a, b in zip(start[:-1].tolist(), start[1:].tolist())]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, did, row, text: ``did`` and ``row``, the id and a hash of the text,
    name a row (repeated rows alike), whatever the plan."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return batched(docs).select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(_NO_ID)).alias("did"), F.xxhash64(text).alias("row"), text.alias("text"))


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, did, row, d1, d2 (digest of the set; null if it is empty), n, low
    (how many of the keys are below the cut), bits, keys: all shingles below a cut
    of the hash space that is somewhat more than the prefix needs, and as many
    above it as may be needed."""
    cut = U64(min(0.95, (100 - percent) / 100 * 1.7) * 2.0**64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x, at = shingle_sets(*text_buffer(batch.column("text")), size)
            n = np.diff(at)
            full = np.flatnonzero(n)
            digest = np.zeros((2, n.size), U64)
            if full.size:
                for k, seed in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
                    digest[k, full] = np.add.reduceat(mix(x ^ U64(seed)), at[full])
            below = np.concatenate(([0], np.cumsum(x < cut)))
            low = below[at[1:]] - below[at[:-1]]
            keep = np.minimum(n, np.maximum(low, n - _overlap(n, percent) + 2))
            key = _keys(x)
            blobs = [packed(key[a : a + m]) for a, m in zip(at[:-1].tolist(), keep.tolist())]
            named = [pa.array(mix(d + n.astype(U64)).view(np.int64), mask=n == 0) for d in digest]
            columns = [batch.column("doc_id"), batch.column("did"), batch.column("row"), *named, pa.array(n), pa.array(low), binary(_bit_maps(x, at)), binary(blobs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "did", "row", "d1", "d2", "n", "low", "bits", "keys"])

    return _rows(docs).mapInArrow(run, "doc_id long, did long, row long, d1 long, d2 long, n long, low long, bits binary, keys binary")


def range_count(spark: SparkSession, total: int, target: int = 24 << 20) -> int:
    """How many groups ``total`` bytes are dealt into: two a shuffle partition, and
    more where a group would hold over ``target`` bytes."""
    return max(2 * shuffle_partitions(spark), -(-int(total or 0) // target))


def _batch_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    each = [unpacked(b, U64) for b in batch.column("keys").to_pylist()]
    return (np.concatenate(each) if each else np.zeros(0, U64)), np.concatenate(([0], np.cumsum([e.size for e in each]))).astype(np.int64)


def _ranged(key: np.ndarray, count: int, columns: dict[str, np.ndarray], maps: tuple[np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
    """One row for each hash range, with packed columns; ``maps`` are words and how
    many of them each entry has."""
    r = ranges_of(key << U64(64 - _KEY_BITS), count)
    order = np.argsort(r, kind="stable")
    r = r[order]
    at = runs(r)
    cut = list(zip(at[:-1].tolist(), at[1:].tolist()))
    arrays = [pa.array(r[at[:-1]])]
    for c in columns.values():
        c = c[order]
        arrays.append(binary(packed(c[a:b]) for a, b in cut))
    if maps is None:
        return pa.RecordBatch.from_arrays(arrays, ["r", *columns])
    flat, width = maps
    begin = np.cumsum(width) - width
    flat, end = flat[concat_ranges(begin[order], width[order])], np.concatenate(([0], np.cumsum(width[order])))
    arrays.append(binary(flat[end[a] : end[b]].tobytes() for a, b in cut))
    return pa.RecordBatch.from_arrays(arrays, ["r", *columns, "maps"])


def _gathered(batches: Iterator[pa.RecordBatch], limit: int = 8192) -> Iterator[pa.RecordBatch]:
    """Input rows in groups, so that a task writes few rows for each hash range."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _column(table: pa.Table, name: str, dtype) -> np.ndarray:
    parts = [unpacked(b, dtype) for b in table.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def frequent(classes: DataFrame, tables: Scratch, count: int, least: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """Keys that are in more than ``least`` classes, with their counts, and the mean
    length of the other lists. Counts cover all classes; ``least`` is doubled
    until at most MAX_HOT keys are left, which bounds what is broadcast. Any set
    of keys gives right results: they only decide the order."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            key, n = np.unique(_batch_keys(batch)[0], return_counts=True)
            yield _ranged(key, count, {"key": key, "n": n.astype(np.int32)})

    def add(table: pa.Table) -> pa.Table:
        key, n = _column(table, "key", U64), _column(table, "n", np.int32).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        at = runs(key)
        total = np.add.reduceat(n, at[:-1]) if key.size else n
        hot = total > least
        rest = total[~hot]
        return pa.table({"key": pa.array(np.append(key[at[:-1]][hot].view(np.int64), [-1, -2])), "n": pa.array(np.append(total[hot], [int((rest * rest).sum()), int(rest.sum())]))})

    found = classes.select("keys").mapInArrow(deal, "r long, key binary, n binary").groupBy("r").applyInArrow(add, "key long, n long")
    found = tables.written(found.groupBy("key").agg(F.sum("n").alias("n")), "hot")
    stats = {r[0]: r[1] for r in found.where("key < 0").collect()}
    sizes = sorted(found.where("key >= 0").select(F.floor(F.log2("n")).cast("int").alias("k")).groupBy("k").count().collect())
    total, floor = 0, least
    for k, n in reversed(sizes):
        total += n
        if total > MAX_HOT:
            floor = max(least, 2 ** (k + 1))
            break
    rows = found.where((F.col("key") >= 0) & (F.col("n") > floor)).toPandas().sort_values("key")
    return rows["key"].to_numpy(np.int64).view(U64), rows["n"].to_numpy(np.int64), stats.get(-1, 0) / max(1, stats.get(-2, 0))


def boundary(sizes: dict[int, int], mean_list: float, percent: int, top: int = 64) -> int:
    """The largest light size: the one with the least total of subsets enumerated
    and list entries scanned. ``sizes`` counts classes of up to ``top`` shingles."""
    p = {n: n - _overlap(n, percent) + 1 for n in range(1, top + 1)}
    best, at = None, 0
    for x in range(0, top + 1):
        light = sum(c * p[n] * (p[n] + 1) / 2 for n, c in sizes.items() if n <= x)
        heavy = sum(c * p[n] * (1 + mean_list) for n, c in sizes.items() if n >= _overlap(x + 1, percent))
        if best is None or light + heavy < best:
            best, at = light + heavy, x
    return at


@lru_cache(maxsize=256)
def _subsets(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


class _Ordered:
    """Keys of a batch of classes in the global order: frequent ones after the others,
    and those above the cut last."""

    def __init__(self, batch: pa.RecordBatch, hot: tuple[np.ndarray, np.ndarray], percent: int):
        hot_keys, hot_n = hot
        key, self.at = _batch_keys(batch)
        self.cls, self.n, low = (batch.column(c).to_numpy() for c in ("cls", "n", "low"))
        where = np.minimum(np.searchsorted(hot_keys, key), max(0, hot_keys.size - 1))
        is_hot = hot_keys[where] == key if hot_keys.size else np.zeros(key.size, bool)
        lists = np.where(is_hot, hot_n[where] if hot_keys.size else 0, 0)
        owner = np.repeat(np.arange(self.n.size), np.diff(self.at))
        rank = np.zeros(key.size, np.int8)
        below = np.arange(key.size) - self.at[owner] < low[owner]
        rank[below & is_hot] = 1
        rank[~below] = 2
        #: equal ones stay in the order of their hashes, as they were cut
        order = np.lexsort((np.where(rank == 1, lists, 0), rank, owner))
        #: ``lists``: how many classes hold the key, or 0 where it isn't frequent
        self.key, self.lists = key[order], lists[order]
        self.prefix = self.n - _overlap(self.n, percent) + 1


def homes(classes: DataFrame, shared, percent: int) -> DataFrame:
    """cls, g: the blocks of the (up to two) home lists of each class that has a
    frequent shingle in its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            o = _Ordered(batch, shared.value, percent)
            take = concat_ranges(o.at[:-1], np.minimum(o.prefix + 1, np.diff(o.at)))
            take = take[o.lists[take] > SHORT]
            owner = np.searchsorted(o.at, take, "right") - 1
            first = np.concatenate(([True], owner[1:] != owner[:-1])) if owner.size else np.zeros(0, bool)
            longest = take[np.lexsort((o.key[take], -o.lists[take], owner))][first]
            other = take[np.lexsort((mix(o.key[take]), owner))][first]
            who = np.concatenate([owner[first], owner[first][longest != other]])
            at = np.concatenate([longest, other[longest != other]])
            blocks = -(-o.lists[at] // BLOCK_SETS)
            own = mix(o.cls[who].view(U64)) % blocks.astype(U64)
            g = mix(o.key[at] * U64(0xD6E8FEB86659FD93) + own).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(o.cls[who]), pa.array(g)], ["cls", "g"])

    return classes.select("cls", "n", "low", "keys").mapInArrow(run, "cls long, g long")


@lru_cache(maxsize=256)
def _subsets(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def postings(classes: DataFrame, shared, light: int, percent: int, count: int, list_block: int) -> DataFrame:
    """r, key, cls, n, rest, comp, held, mapped, maps: the entries of all lists, by
    hash range. Entries of lists that may be long carry their bit maps; lists
    beyond ``list_block`` are cut into blocks, and each pair of blocks is a list."""
    #: single-token lists hold sets that can link to a heavy one
    reach = _overlap(light + 1, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            o = _Ordered(batch, shared.value, percent)
            at, key, n, prefix = o.at, o.key, o.n, o.prefix
            comp, held = batch.column("comp").to_numpy(), batch.column("held").to_numpy()
            width = _map_words(n)
            flat = np.frombuffer(b"".join(batch.column("bits").to_pylist()), U64)
            single = np.flatnonzero(n >= reach)
            take = concat_ranges(at[single], prefix[single])
            keys, rows, size = [key[take]], [np.repeat(single, prefix[single])], [o.lists[take]]
            #: how much a pair can share at most if this is the first that it shares
            rest = [n[rows[0]] - (take - at[rows[0]])]
            for i in np.flatnonzero((n <= light) & (n > 1)).tolist():
                a, b = _subsets(int(prefix[i]) + 1)
                own, lists = key[at[i] : at[i] + int(prefix[i]) + 1], o.lists[at[i] : at[i] + int(prefix[i]) + 1]
                lo, hi = np.minimum(own[a], own[b]), np.maximum(own[a], own[b])
                keys.append(mix(lo * U64(0x9E3779B97F4A7C15) + hi) >> U64(64 - _KEY_BITS))
                rows.append(np.full(a.size, i))
                #: a pair of shingles is in no more sets than either
                size.append(np.minimum(lists[a], lists[b]))
                rest.append(n[i] - b + 1)
            keys, rows, size, rest = np.concatenate(keys), np.concatenate(rows), np.concatenate(size), np.concatenate(rest)
            big = np.flatnonzero(size > list_block)
            if big.size:
                blocks = -(-size[big] // list_block)
                own = (mix(o.cls[rows[big]].view(U64)) % blocks.astype(U64)).astype(np.int64)
                again = np.repeat(np.arange(big.size), blocks)
                other = np.arange(again.size) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                pair = np.minimum(own[again], other) * blocks[again] + np.maximum(own[again], other)
                made = mix(keys[big][again] * U64(0xD6E8FEB86659FD93) + pair.astype(U64)) >> U64(64 - _KEY_BITS)
                keep = size <= list_block
                keys, rows, rest, size = (np.concatenate([x[keep], y]) for x, y in ((keys, made), (rows, rows[big][again]), (rest, rest[big][again]), (size, size[big][again])))
            mapped = size > SHORT
            each = np.where(mapped, width[rows], 0)
            begin = np.cumsum(width) - width
            maps = flat[concat_ranges(begin[rows], each)], each
            columns = {"key": keys, "cls": o.cls[rows], "n": n[rows].astype(np.int32), "rest": rest.astype(np.int32), "comp": comp[rows], "held": held[rows].astype(np.int32), "mapped": mapped.astype(np.uint8)}
            yield _ranged(keys, count, columns, maps)

    blobs = ", ".join(f"{c} binary" for c in ("key", "cls", "n", "rest", "comp", "held", "mapped", "maps"))
    return classes.select("cls", "n", "low", "keys", "bits", "comp", "held").mapInArrow(run, "r long, " + blobs)


def _needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of two linked sets of n and m."""
    return -(-(n + m) * percent // (100 + percent))


def _long_list(n, rest, comp, maps: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a list's entries that lie in different components and that sizes,
    positions and bit maps allow, tile by tile. Of the commonest component only
    pairs with others are looked at."""
    width = np.array([m.size for m in maps])
    labels, which, count = np.unique(comp, return_inverse=True, return_counts=True)
    main = which == np.argmax(count)
    rows = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    bits = {w: np.stack([maps[i] for i in x]) for w, x in rows.items()}
    for w, x in rows.items():
        for v, y in rows.items():
            #: sizes of linked sets are within one doubling of each other
            if v not in (w, 2 * w):
                continue
            other = bits[v] if v == w else bits[v][:, :w] ^ bits[v][:, w:]
            mine = bits[w]
            asks = [(~main[x], np.ones(y.size, bool))] if v == w else [(~main[x], np.ones(y.size, bool)), (main[x], ~main[y])]
            for left, right in asks:
                i_all, j_all = np.flatnonzero(left), np.flatnonzero(right)
                for s in range(0, i_all.size, 128):
                    at = i_all[s : s + 128]
                    i = x[at][:, None]
                    for t in range(0, j_all.size, 512):
                        to = j_all[t : t + 512]
                        j = y[to][None, :]
                        need = _needed(n[i], n[j], percent)
                        ok = (comp[i] != comp[j]) & (np.minimum(rest[i], rest[j]) >= need) & (np.minimum(n[i], n[j]) >= need)
                        if v == w:
                            ok &= (i < j) | main[j]
                        if ok.any():
                            differ = np.zeros(ok.shape, np.int64)
                            for k in range(w):
                                differ += np.bitwise_count(mine[at, k][:, None] ^ other[to, k][None, :])
                            a, b = np.nonzero(ok & (differ <= n[i] + n[j] - 2 * need))
                            yield x[at[a]], y[to[b]]


def _visits(percent: int):
    """x, comp: which classes have to be compared with which components."""

    def scan(table: pa.Table) -> pa.Table:
        key, cls, comp = (_column(table, c, d) for c, d in (("key", U64), ("cls", np.int64), ("comp", np.int64)))
        n, rest, held = (_column(table, c, np.int32).astype(np.int64) for c in ("n", "rest", "held"))
        mapped = _column(table, "mapped", np.uint8).astype(bool)
        flat = np.frombuffer(b"".join(table.column("maps").to_pylist()), U64)
        width = np.where(mapped, _map_words(n), 0)
        begin = np.cumsum(width) - width
        order = np.lexsort((cls, n, key))
        key, cls, comp, n, rest, held, mapped, width, begin = (x[order] for x in (key, cls, comp, n, rest, held, mapped, width, begin))
        at = runs(key)
        found = [np.zeros((0, 2), np.int64)]

        def add(i: np.ndarray, j: np.ndarray) -> None:
            #: the smaller component, or the one of the lesser name, visits
            first = (held[i] < held[j]) | ((held[i] == held[j]) & (comp[i] < comp[j]))
            found.append(np.unique(np.stack([np.where(first, cls[i], cls[j]), np.where(first, comp[j], comp[i])], axis=1), axis=0))

        if n.size:
            low, high = np.minimum.reduceat(comp, at[:-1]), np.maximum.reduceat(comp, at[:-1])
            size = np.diff(at)
            open_ = low != high
            long = open_ & (size > SHORT) & mapped[at[:-1]]
            short = open_ & ~long
            entry = concat_ranges(at[:-1][short], size[short])
            start = np.repeat(at[:-1][short], size[short])
            lo = 0
            while lo < entry.size:
                #: entries whose earlier partners number about two million
                many = np.cumsum(entry[lo : lo + 400_000] - start[lo : lo + 400_000])
                hi = lo + max(1, int(np.searchsorted(many, 2_000_000)))
                k, s = entry[lo:hi], start[lo:hi]
                i, j = np.repeat(k, k - s), concat_ranges(s, k - s)
                need = _needed(n[i], n[j], percent)
                keep = (comp[i] != comp[j]) & (np.minimum(rest[i], rest[j]) >= need) & (n[j] >= need)
                add(i[keep], j[keep])
                lo = hi
            for k in np.flatnonzero(long).tolist():
                a, b = int(at[k]), int(at[k + 1])
                maps = [flat[p : p + w] for p, w in zip(begin[a:b].tolist(), width[a:b].tolist())]
                for i, j in _long_list(n[a:b], rest[a:b], comp[a:b], maps, percent):
                    add(a + i, a + j)
        pair = np.unique(np.concatenate(found), axis=0)
        return pa.table({"cls": pair[:, 0], "comp": pair[:, 1]})

    return scan


def link_matrix(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the left sets (of distinct hashes) link to which of the right ones, by
    exact counts. Shingles of few sets are counted pair by pair, those of many
    with one bit each."""
    sets = left if left is right else left + right
    m, shift = len(sets), 0 if left is right else len(left)
    rows, cols = len(left), len(right)
    n = np.array([s.size for s in sets], np.int64)
    key, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    at = runs(key)
    size = np.diff(at)
    many = max(8, m // 25)
    both = np.zeros(rows * cols, np.int64)
    few = np.flatnonzero((size > 1) & (size < many))
    entry, start = concat_ranges(at[few], size[few]), np.repeat(at[few], size[few])
    step = 4_000_000 // many
    for s in range(0, entry.size, step):
        k, first = entry[s : s + step], start[s : s + step]
        i, j = owner[concat_ranges(first, k - first)], owner[np.repeat(k, k - first)]
        if left is right:
            both += np.bincount(i * cols + j, minlength=both.size)
        else:
            cross = (i < shift) & (j >= shift)
            both += np.bincount(i[cross] * cols + j[cross] - shift, minlength=both.size)
    both = both.reshape(rows, cols)
    if left is right:
        both = both + both.T
    common = np.flatnonzero(size >= many)
    if common.size:
        wide = -(-common.size // 64) * 64
        held = np.zeros((m, wide), bool)
        held[owner[concat_ranges(at[common], size[common])], np.repeat(np.arange(common.size), size[common])] = True
        bits = np.packbits(held, axis=1).view(U64)
        del held
        other = bits[shift:]
        tile = max(1, (1 << 18) // cols)
        for s in range(0, rows, tile):
            mine = bits[s : min(rows, s + tile)]
            for w in range(bits.shape[1]):
                both[s : s + tile] += np.bitwise_count(mine[:, w][:, None] & other[:, w][None, :])
    total = n[:rows, None] + n[None, shift:]
    return 100 * both >= percent * (total - both)


def _forest(link: np.ndarray) -> np.ndarray:
    """Least index that each row of a symmetric link matrix reaches."""
    label = np.arange(len(link))
    while True:
        #: least label among the neighbours, then jumps to the end
        near = np.array([min(int(label[i]), int(label[r].min(initial=len(link)))) for i, r in enumerate(link)])
        while (near[near] != near).any():
            near = near[near]
        if (near == label).all():
            return label
        label = near


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b, U64) for b in table.column("set").to_pylist()]


def _each(table: pa.Table, name: str = "g") -> Iterator[pa.Table]:
    """The rows of one group after the other."""
    table = table.sort_by(name)
    at = runs(table.column(name).to_numpy())
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield table.slice(a, b - a)


def _grouped(rows: DataFrame, total: int, run: Callable, schema: str) -> DataFrame:
    """``run`` over groups ``g`` of the rows, many groups a task."""
    count = range_count(rows.sparkSession, total)
    return rows.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(count))).groupBy("bucket").applyInArrow(lambda t: run(t.drop_columns(["bucket"])), schema)


def sets_of(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """cls, set: the sets of the classes ``wanted`` (cls, did, row), made again from
    the texts; a repeated row gives one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x, at = shingle_sets(*text_buffer(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays([batch.column("cls"), binary(x[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist()))], ["cls", "set"])

    made = texts.join(small(wanted), ["did", "row"]).select("cls", "text").mapInArrow(run, "cls long, set binary")
    return made.groupBy("cls").agg(F.first("set").alias("set"))


def _stars(percent: int):
    def run(table: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t in _each(table):
            if t.num_rows > 1:
                cls, sets = t.column("cls").to_numpy(), _sets(t)
                root = _forest(link_matrix(sets, sets, percent))
                a.append(cls[root != np.arange(cls.size)])
                b.append(cls[root[root != np.arange(cls.size)]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _met(percent: int):
    def run(table: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t in _each(table):
            cls, guest, sets = t.column("cls").to_numpy(), t.column("guest").to_numpy(zero_copy_only=False), _sets(t)
            x, y = np.flatnonzero(guest), np.flatnonzero(~guest)
            if x.size and y.size:
                link = link_matrix([sets[i] for i in x], [sets[i] for i in y], percent)
                some = link.any(axis=1)
                a.append(cls[x[some]])
                b.append(cls[y[link.argmax(axis=1)[some]]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _counted(percent: int):
    def run(table: pa.Table) -> pa.Table:
        who, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t in _each(table):
            cls, copies, side, sets = t.column("cls").to_numpy(), t.column("copies").to_numpy(), t.column("side").to_numpy(), _sets(t)
            x, y = np.flatnonzero(side != 2), np.flatnonzero(side == 2)
            one = [sets[i] for i in x]
            if y.size:
                #: two blocks of one component
                link = link_matrix(one, [sets[i] for i in y], percent)
                who += [cls[x], cls[y]]
                n += [link @ copies[y], copies[x] @ link]
            elif (side == 0).all():
                link = link_matrix(one, one, percent)
                np.fill_diagonal(link, False)
                who.append(cls[x])
                n.append(link @ copies[x])
        return pa.table({"cls": np.concatenate(who), "links": np.concatenate(n).astype(np.int64)})

    return run


def _blocks(sets, shingles):
    """Number of blocks of a group, as a column."""
    return F.greatest(F.ceil(sets / BLOCK_SETS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _block(blocks):
    return F.pmod(F.xxhash64("cls"), blocks).cast("int")


def _visited(visits: DataFrame, classes: DataFrame, texts: DataFrame, tables: Scratch, size: int, percent: int) -> DataFrame:
    """a, b: for each visit that meets one, a link to the visited component."""
    facts = classes.select("cls", "did", "row", "n", "comp")
    guests = visits.groupBy("comp").agg(F.count("*").alias("guests"))
    hosts = facts.join(small(guests), "comp")
    sizes = hosts.groupBy("comp", "guests").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    sizes = tables.written(sizes.select("comp", "blocks", F.ceil(F.col("guests") / BLOCK_SETS).cast("int").alias("parts")), "sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    group = lambda block, part: F.xxhash64("comp", block, part).alias("g")
    host = hosts.join(small(sizes), "comp").withColumn("part", every("parts")).select(group(_block(F.col("blocks")), F.col("part")), "cls", F.lit(False).alias("guest"))
    guest = visits.join(small(sizes), "comp").withColumn("block", every("blocks")).select(group(F.col("block"), _block(F.col("parts"))), "cls", F.lit(True).alias("guest"))
    meet = tables.written(host.unionByName(guest), "meet")
    wanted = facts.join(small(meet.select("cls").distinct()), "cls")
    total = meet.join(small(wanted.select("cls", "n")), "cls").agg(F.sum("n")).first()[0]
    rows = meet.join(sets_of(texts, wanted.select("cls", "did", "row"), size), "cls").select("g", "cls", "guest", "set")
    return _grouped(rows, 8 * (total or 0), _met(percent), "a long, b long")


def _link_counts(classes: DataFrame, texts: DataFrame, tables: Scratch, size: int, percent: int) -> DataFrame:
    """cls, links: how many documents of other classes each class of a component
    links to."""
    members = classes.select("cls", "did", "row", "n", "comp", "copies")
    sizes = members.groupBy("comp").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"), F.sum("copies").alias("docs")).where("sets > 1")
    members = tables.written(members.join(small(sizes), "comp"), "members")
    two = members.where("sets = 2").select("cls", (F.col("docs") - F.col("copies")).alias("links"))
    more = members.where("sets > 2").withColumn("blocks", _blocks(F.col("sets"), F.col("shingles"))).withColumn("own", _block(F.col("blocks")))
    more = more.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    #: 0: a block with itself; 1, 2: the two sides of a pair of blocks
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int")
    more = more.select(F.xxhash64("comp", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "cls", "copies", side.alias("side"), "n")
    total = more.agg(F.sum("n")).first()[0]
    wanted = members.where("sets > 2").select("cls", "did", "row")
    rows = more.drop("n").join(sets_of(texts, wanted, size), "cls").select("g", "cls", "copies", "side", "set")
    counted = _grouped(rows, 8 * (total or 0), _counted(percent), "cls long, links long")
    return two.unionByName(counted.groupBy("cls").agg(F.sum("links").alias("links")))


def _labelled(classes: DataFrame, comps: DataFrame, tables: Scratch) -> DataFrame:
    """The classes with ``comp``, the label of their component or their own name, and
    ``held``, how many classes it has."""
    sizes = comps.groupBy("label").agg(F.count("*").alias("held"))
    known = tables.written(comps.join(small(sizes), "label").select(F.col("node").alias("cls"), "label", "held"), "labels")
    return classes.join(small(known), "cls", "left").withColumn("comp", F.coalesce("label", "cls")).withColumn("held", F.coalesce("held", F.lit(1))).drop("label")


def _joined(docs: DataFrame, size: int, percent: int, list_block: int, count_links: bool) -> DataFrame:
    """doc_id, did, row, n, copies, component_id, keep_did, keep_row, links: the last
    six null for rows that link to no other row."""
    spark = docs.sparkSession
    texts = _rows(docs).select("did", "row", "text")
    signed = written(signatures(docs, size, percent), "signatures")
    with Scratch(spark, "jaccard-join") as tables:
        known = signed.where("d1 is not null")
        first = F.min(F.struct(F.col("doc_id").isNull(), "did", "row")).alias("m")
        classes = known.groupBy("d1", "d2", "n").agg(first, F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("low", "bits", "keys")])
        classes = classes.select(F.monotonically_increasing_id().alias("cls"), "d1", "d2", "m.did", "m.row", "copies", "n", "low", "bits", "keys")
        classes = tables.written(classes, "classes")
        shingles, sizes = classes.agg(F.sum("n")).first()[0] or 0, {r[0]: r[1] for r in classes.where("n <= 64").groupBy("n").count().collect()}
        entries = shingles * (100 - percent) // 100
        hot_keys, hot_n, mean_list = frequent(classes, tables, range_count(spark, 16 * entries))
        light = boundary(sizes, mean_list, percent)
        shared = spark.sparkContext.broadcast((hot_keys, hot_n))

        at_home = tables.written(homes(classes, shared, percent), "homes")
        wanted = classes.select("cls", "did", "row", "n").join(small(at_home.select("cls").distinct()), "cls")
        total = at_home.join(small(wanted.select("cls", "n")), "cls").agg(F.sum("n")).first()[0]
        rows = at_home.join(sets_of(texts, wanted.select("cls", "did", "row"), size), "cls").select("g", "cls", "set")
        links = tables.written(_grouped(rows, 8 * (total or 0), _stars(percent), "a long, b long"), "stars")

        labelled = _labelled(classes, components(links), tables)
        lists = postings(labelled, shared, light, percent, range_count(spark, 40 * entries), list_block)
        visits = lists.groupBy("r").applyInArrow(_visits(percent), "cls long, comp long").distinct()
        visits = tables.written(visits, "visits")
        links = tables.written(links.unionByName(_visited(visits, labelled, texts, tables, size, percent)), "links")

        labelled = _labelled(classes, components(links), tables)
        named = labelled.where("held > 1 or copies > 1").select("cls", "d1", "d2", "did", "row", "n", "copies", "comp")
        named = tables.written(named, "named")
        keeper = F.min(F.struct((F.col("did") == _NO_ID).alias("nameless"), "did", "row")).alias("k")
        final = named.join(small(named.groupBy("comp").agg(keeper)), "comp")
        if count_links:
            final = final.join(small(_link_counts(named, texts, tables, size, percent)), "cls", "left")
        else:
            final = final.withColumn("links", F.lit(0))
        final = final.select("d1", "d2", "copies", F.when(F.col("k.did") != _NO_ID, F.col("k.did")).alias("component_id"), F.col("k.did").alias("keep_did"), F.col("k.row").alias("keep_row"), F.coalesce("links", F.lit(0)).alias("links"))
        final = written(final, "linked")
    return signed.select("doc_id", "did", "row", "n", "d1", "d2").join(small(final), ["d1", "d2"], "left").drop("d1", "d2")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, list_block: int = 20_000) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row of ``docs``.

    Words are maximal runs without space and \\t..\\r, A-Z lower-cased; a set is
    the distinct ``size``-word shingles, or the whole sequence where there are
    fewer words. Two rows link when 100 * intersection >= percent * union.
    component_id is the smallest doc_id that links reach, n_links the number of
    other rows that the row links to (copies of it included).

    Null or empty texts: n_shingles 0, no links, a component of their own. A null
    doc_id stays null and never names a component unless all its members are
    null. Repeated rows are copies of each other. Empty table: no rows.
    """
    out = _joined(docs, size, percent, list_block, True)
    links = F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), links.alias("n_links"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, list_block: int = 20_000) -> DataFrame:
    """One document of each component, with all its columns: the one of the smallest
    doc_id (one without id only if none has an id; of several of that id the
    one whose text has the least hash). Of repeated rows one stays. Rows without
    words link to nothing and stay."""
    out = written(_joined(docs, size, percent, list_block, False).where("keep_did is not null").select(F.col("did").alias("__did"), F.col("row").alias("__row"), ((F.col("did") == F.col("keep_did")) & (F.col("row") == F.col("keep_row"))).alias("keep")), "fates")
    named = docs.withColumn("__did", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn("__row", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    name = ["__did", "__row"]
    left = named.join(small(out.where("not keep").select(*name).distinct()), name, "left_anti")
    #: only rows that are repeated have to meet
    repeated = small(out.where("keep").groupBy(*name).count().where("count > 1").select(*name))
    again = left.join(repeated, name, "left_semi").select(*named.columns).dropDuplicates(name)
    return left.join(repeated, name, "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))
