"""Substring deduplication by recompression.

Words are the symbols of level 0. Each round renames what stands side by side:
a maximal run of one symbol becomes a symbol, then each pair of neighbours of
which the first has a hash bit of 0 and the second of 1. What becomes of two
neighbours depends on them and on what stands next to them, so equal word
sequences get equal symbols in their interior; every symbol knows the words
that its making depended on (its *support*).

A round is one exchange over the corpus: the blocks of documents send the symbols
made in it, named with their support, and learn which of them other documents
made too. A window of ``size`` words that occurs twice holds only shared names
among the symbols whose support lies inside it, so each round leaves fewer windows: those of the second
round come from the regions that the first left. The windows that remain are
named and grouped, which gives the least document of each, and are at last
compared with that document word by word, as stretches of consecutive windows.
Names (64 bits for symbols, 96 for windows) thus only propose.

A block sends a name once, however often it occurs inside, and a stretch that
many documents hold is compared once: a passage of a third of all documents
costs one entry a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _P, _P_INV, _SPAN, U64, _power, Scratch, batched, concat_ranges, mix, packed, ranges_of, runs, shuffle_partitions, small, text_buffer, unpacked, windows, words, written

_FAR = np.iinfo(np.int64).max >> 1


class Symbols:
    """The symbols of some documents after a number of rounds: names, first words,
    support [lo, hi] in words, whether a document begins there, and which of the
    symbols the last round made."""

    def __init__(self, h: np.ndarray, first: np.ndarray):
        self.name, self.at, self.words = h, np.arange(h.size), h
        self.lo, self.hi = self.at, self.at
        self.opens = np.zeros(h.size, bool)
        self.opens[first[:-1][np.diff(first) > 0]] = True
        self.made = np.zeros(h.size, bool)

    def _beside(self) -> tuple[np.ndarray, np.ndarray]:
        """Support of the left and of the right neighbour; beyond a document's ends
        nothing is known."""
        before = np.where(self.opens, -_FAR, np.concatenate(([-_FAR], self.lo[:-1])))
        ends = np.concatenate((self.opens[1:], [True]))
        return before, np.where(ends, _FAR, np.concatenate((self.hi[1:], [_FAR])))

    def _keep(self, first: np.ndarray, name: np.ndarray, lo: np.ndarray, hi: np.ndarray, made: np.ndarray) -> None:
        self.name, self.lo, self.hi, self.made = name, lo, hi, made
        self.at, self.opens = self.at[first], self.opens[first]

    def round(self, k: int) -> None:
        if not self.name.size:
            return
        #: runs of one symbol
        same = np.concatenate(([False], (self.name[1:] == self.name[:-1]) & ~self.opens[1:]))
        first = np.flatnonzero(~same)
        last = np.append(first[1:], self.name.size) - 1
        long = last > first
        name = np.where(long, mix(self.name[first] * U64(0x9E3779B97F4A7C15) + U64(4 * k + 1) * (last - first + 1).astype(U64)), self.name[first])
        before, after = self._beside()
        self._keep(first, name, before[first], after[last], long)
        #: pairs
        side = (mix(self.name + U64(4 * k + 2)) >> U64(63)).astype(bool)
        joins = np.append(~side[:-1] & side[1:] & ~self.opens[1:], False)
        first = np.flatnonzero(~np.concatenate(([False], joins[:-1])))
        pair = joins[first]
        then = np.minimum(first + 1, self.name.size - 1)
        name = np.where(pair, mix(self.name[first] * U64(0xD6E8FEB86659FD93) + mix(self.name[then] + U64(4 * k + 3))), self.name[first])
        before, after = self._beside()
        self._keep(first, name, np.where(pair, self.lo[first], before[first]), np.where(pair, self.hi[then], after[first]), pair | self.made[first])

    def supported(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of the last round whose support is of ``size`` words at most, and
        their names within it: hashes of the words that they depended on."""
        at = np.flatnonzero(self.made & (self.hi - self.lo < size))
        lo, hi, n = self.lo[at], self.hi[at] + 1, self.words.size
        total = np.zeros(n + 1, U64)
        np.cumsum(self.words * _power("p", _P, n), out=total[1:])
        return at, mix((total[hi] - total[lo]) * _power("q", _P_INV, n)[lo] + U64(1))


def _parts(docs: pa.Table, limit: int = _SPAN):
    """Row ranges of a block with bounded text, with their words."""
    for batch in docs.select(["text"]).to_batches():
        if not batch.num_rows:
            continue
        col = batch.column(0)
        _, at = text_buffer(col)
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            buf, own = text_buffer(col.slice(lo, hi - lo))
            yield lo, hi, buf, words(buf, own)
            lo = hi


def _whole(docs: pa.Table) -> pa.Table:
    return docs.combine_chunks()


def _ids(docs: pa.Table) -> np.ndarray:
    return docs.column("doc_id").to_numpy().astype(np.int64)


def _least(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where distinct keys first stand, in order, their least document, and whether
    they have another."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    at = runs(key)
    if not key.size:
        return order, doc, np.zeros(0, bool)
    return order[at[:-1]], doc[at[:-1]], doc[at[1:] - 1] != doc[at[:-1]]


def _by_range(block: int, key: np.ndarray, count: int, columns: dict[str, np.ndarray]) -> pa.Table:
    r = ranges_of(key, count)
    order = np.lexsort((key, r))
    r = r[order]
    at = runs(r)
    cut = list(zip(at[:-1].tolist(), at[1:].tolist()))
    blob = lambda x: pa.array([packed(x[a:b]) for a, b in cut], pa.binary())
    return pa.table({"r": pa.array(r[at[:-1]]), "block": pa.array(np.full(len(cut), block, np.int64)), **{n: blob(c[order]) for n, c in columns.items()}})


def _column(t: pa.Table, name: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpacked(b, dtype) for b in t.column(name).to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([p.size for p in parts], np.int64)


def _answers(block: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    order = np.argsort(block, kind="stable")
    block = block[order]
    at = runs(block)
    cut = list(zip(at[:-1].tolist(), at[1:].tolist()))
    return pa.table({"block": pa.array(block[at[:-1]]), **{n: pa.array([packed(c[order][a:b]) for a, b in cut], pa.binary()) for n, c in columns.items()}})


def _after(h: np.ndarray, first: np.ndarray, k: int) -> Symbols:
    s = Symbols(h, first)
    for i in range(k + 1):
        s.round(i)
    return s


def _names(size: int, k: int, count: int) -> Callable[[pa.Table], pa.Table]:
    """Sends the names that round ``k`` makes in a block, and whether two of its
    documents have one. A name goes as its range and 32 bits."""

    def run(docs: pa.Table) -> pa.Table:
        docs = _whole(docs)
        ids, names, owners = _ids(docs), [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for lo, hi, _, (_, _, h, first) in _parts(docs):
            s = _after(h, first, k)
            at, name = s.supported(size)
            names.append(name)
            owners.append(np.repeat(ids[lo:hi], np.diff(first))[s.at[at]])
        name = np.concatenate(names)
        at, _, more = _least(name, np.concatenate(owners))
        return _by_range(docs.column("block")[0].as_py(), name[at], count, {"key": (name[at] & U64(0xFFFFFFFF)).astype(np.uint32), "more": more.astype(np.uint8)})

    return run


def _shared(t: pa.Table) -> pa.Table:
    """Answers each block with those of its names that another document made too."""
    key, n = _column(t, "key", np.uint32)
    more, _ = _column(t, "more", np.uint8)
    block = np.repeat(t.column("block").to_numpy(), n)
    r = np.repeat(t.column("r").to_numpy(), n)
    order = np.argsort(key, kind="stable")
    key, more, block, r = key[order], more[order], block[order], r[order]
    at = runs(key)
    several = (np.diff(at) > 1) | (np.maximum.reduceat(more, at[:-1]) > 0) if key.size else np.zeros(0, bool)
    keep = np.repeat(several, np.diff(at))
    return _answers(block[keep], {"key": key[keep], "r": r[keep].astype(np.uint32)})


def _short(name: np.ndarray, count: int) -> np.ndarray:
    """A name as the exchange knows it: its range and 32 bits."""
    return ranges_of(name, count).astype(U64) << U64(32) | (name & U64(0xFFFFFFFF))


def _known(shared: pa.Table) -> np.ndarray:
    if not shared.num_rows:
        return np.zeros(0, U64)
    return np.unique(_column(shared, "r", np.uint32)[0].astype(U64) << U64(32) | _column(shared, "key", np.uint32)[0].astype(U64))


def open_windows(h: np.ndarray, first: np.ndarray, size: int, k: int, known: np.ndarray, count: int) -> np.ndarray:
    """Starts of the windows in which all symbols made by round ``k``, whose support
    lies inside, have names among those ``known`` (sorted, as the exchange knows them)."""
    start = windows(h, first, size)[1]
    s = _after(h, first, k)
    at, name = s.supported(size)
    name = _short(name, count)
    bad = at[known[np.minimum(np.searchsorted(known, name), known.size - 1)] != name] if known.size else at
    #: a lonely symbol closes all windows around its support
    dead = np.zeros(h.size + 1, np.int64)
    np.add.at(dead, np.maximum(s.hi[bad] - size + 1, 0), 1)
    np.add.at(dead, s.lo[bad] + 1, -1)
    return start[np.cumsum(dead[:-1])[start] == 0]


def _regions(size: int, k: int, count: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The stretches of each document that open windows cover: block, doc_id, row, begin
    (in words) and text."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        block, rows, begin, text = [], [], [], []
        if docs.num_rows:
            docs, known = _whole(docs), _known(shared)
            here, at_word = docs.column("block")[0].as_py(), docs.column("begin").to_numpy()
            for lo, hi, buf, (b, e, h, first) in _parts(docs):
                start = open_windows(h, first, size, k, known, count)
                owner = np.searchsorted(first, start, "right") - 1
                #: windows of one document that overlap or touch are one region
                cut = np.flatnonzero((np.diff(start) > size) | (np.diff(owner) > 0)) + 1
                data = _joined(buf, b, e)
                for x, y in zip(np.append(0, cut).tolist(), np.append(cut, start.size).tolist()):
                    if y > x:
                        i, j = int(start[x]), int(start[y - 1]) + size
                        block.append(here)
                        rows.append(int(lo + owner[x]))
                        begin.append(i - int(first[owner[x]]) + int(at_word[rows[-1]]))
                        text.append(data(i, j))
        which = pa.array(rows, pa.int64())
        named = [docs.column(c).take(which) if rows else pa.array([], pa.int64()) for c in ("doc_id", "row")]
        return pa.table([pa.array(block, pa.int64()), *named, pa.array(begin, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], ["block", "doc_id", "row", "begin", "text"])

    return run


def _joined(buf: np.ndarray, b: np.ndarray, e: np.ndarray) -> Callable[[int, int], bytes]:
    """Gives words [i, j) as bytes, with one space between them."""
    size = e - b + 1
    end = np.cumsum(size)
    flat = np.append(buf, np.uint8(0x20))[np.minimum(concat_ranges(b, size), buf.size)]
    flat[end - 1] = 0x20
    data = flat.tobytes()
    at = np.concatenate(([0], end)).tolist()
    return lambda i, j: data[at[i] : max(at[i], at[j] - 1)]


def _check(h: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """32 more bits of each window's name."""
    return (windows(mix(h ^ U64(0x5851F42D4C957F2D)), first, size)[0] >> U64(32)).astype(np.uint32)


def _open(regions: pa.Table, shared: pa.Table, size: int, k: int, count: int):
    """The open windows of a block's regions, part by part: rows, words, starts, names,
    checks and documents."""
    known, ids = _known(shared), _ids(regions)
    for lo, hi, buf, (b, e, h, first) in _parts(regions):
        name, start = windows(h, first, size)
        left = np.isin(start, open_windows(h, first, size, k, known, count), assume_unique=True)
        check = _check(h, first, size)
        yield lo, buf, (b, e, h, first), start[left], name[left], check[left], np.repeat(ids[lo:hi], np.diff(first))[start[left]]


def _send_windows(size: int, k: int, count: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(regions: pa.Table, shared: pa.Table) -> pa.Table:
        block, found = 0, [(np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        if regions.num_rows:
            regions, block = _whole(regions), regions.column("block")[0].as_py()
            found += [(name, check, doc) for _, _, _, _, name, check, doc in _open(regions, shared, size, k, count)]
        name, check, doc = (np.concatenate(x) for x in zip(*found))
        at, least, _ = _least(name ^ check.astype(U64) * U64(0x9E3779B97F4A7C15), doc)
        return _by_range(block, name[at], count, {"key": name[at], "check": check[at], "doc": least})

    return run


def _first_owner(t: pa.Table) -> pa.Table:
    """Answers each block with the windows that have an owner earlier than its own."""
    key, n = _column(t, "key", U64)
    check, _ = _column(t, "check", np.uint32)
    doc, _ = _column(t, "doc", np.int64)
    block = np.repeat(t.column("block").to_numpy(), n)
    order = np.lexsort((check, key))
    key, check, doc, block = key[order], check[order], doc[order], block[order]
    new = np.ones(key.size, bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    at = np.append(np.flatnonzero(new), key.size)
    least = np.repeat(np.minimum.reduceat(doc, at[:-1]), np.diff(at)) if key.size else doc
    keep = least < doc
    return _answers(block[keep], {"key": key[keep], "check": check[keep], "least": least[keep]})


def _stretches(size: int, k: int, count: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """block, doc_id, row, begin, words, owner, text: consecutive windows of a document that
    are said to start in one earlier document as well."""

    def run(regions: pa.Table, both: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("block", "doc_id", "row", "begin", "words", "owner", "text")}
        if regions.num_rows:
            regions = _whole(regions)
            here, at_word, rows = regions.column("block")[0].as_py(), regions.column("begin").to_numpy(), regions.column("row").to_numpy()
            empty = not both.num_rows
            shared, owned = (both, both) if empty else (both.filter(pc.is_valid(both.column(c))) for c in ("r", "least"))
            held = list(_open(regions, shared, size, k, count))
            mixed = lambda name, check: name ^ check.astype(U64) * U64(0x9E3779B97F4A7C15)
            own = np.concatenate([mixed(x[4], x[5]) for x in held] or [np.zeros(0, U64)])
            doc = np.concatenate([x[6] for x in held] or [np.zeros(0, np.int64)])
            key, check, least = (np.zeros(0, d) if empty else _column(owned, c, d)[0] for c, d in (("key", U64), ("check", np.uint32), ("least", np.int64)))
            key = mixed(key, check)
            every, docs = np.concatenate([own, key]), np.concatenate([doc, least])
            at, owner, _ = _least(every, docs)
            names = every[at]
            for lo, buf, (b, e, h, first), start, name, check, mine in held:
                who = owner[np.searchsorted(names, mixed(name, check))] if names.size else mine
                hit = np.flatnonzero(who < mine)
                s, who, mine = start[hit], who[hit], mine[hit]
                row = np.searchsorted(first, s, "right") - 1
                cut = np.flatnonzero((np.diff(s) != 1) | (np.diff(who) != 0) | (np.diff(row) != 0)) + 1
                data = _joined(buf, b, e)
                for x, y in zip(np.append(0, cut).tolist(), np.append(cut, s.size).tolist()):
                    if y > x:
                        i, j = int(s[x]), int(s[y - 1]) + size
                        values = (here, int(mine[x]), int(rows[lo + row[x]]), i - int(first[row[x]]) + int(at_word[lo + row[x]]), j - i, int(who[x]), data(i, j))
                        for c, v in zip(out, values):
                            out[c].append(v)
        text = pa.array(out.pop("text"), pa.binary()).cast(pa.string())
        return pa.table({**{c: pa.array(v, pa.int64()) for c, v in out.items()}, "text": text})

    return run


def true_names(buf: np.ndarray, b: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Numbers of the words that are equal for words of equal bytes, and only for these."""
    _, rep, number = np.unique(h, return_index=True, return_inverse=True)
    size = e - b
    other = b[rep][number]
    same = size == size[rep][number]
    at, to = concat_ranges(b, np.where(same, size, 0)), concat_ranges(other, np.where(same, size, 0))
    if same.all() and np.array_equal(buf[at], buf[to]):
        return number
    data = buf.tobytes()
    by: dict[bytes, int] = {}
    return np.array([by.setdefault(data[x:y], len(by)) for x, y in zip(b.tolist(), e.tolist())], np.int64)


def _unverified(size: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """owner, text of the stretches that hold a window which, word by word, is in no
    region of the owner."""

    def run(said: pa.Table, regions: pa.Table) -> pa.Table:
        if not said.num_rows:
            return pa.table({"owner": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
        if not regions.num_rows:
            return said.select(["owner", "text"])
        bad: list[int] = []
        owner = said.column("owner").to_numpy()
        order = np.argsort(owner, kind="stable")
        step = 4096
        doc = regions.column("doc_id").to_numpy()
        for lo in range(0, order.size, step):
            pick = order[lo : lo + step]
            of = np.flatnonzero(np.isin(doc, owner[pick]))
            text = pa.chunked_array([*said.column("text").take(pa.array(pick)).chunks, *regions.column("text").take(pa.array(of)).chunks], pa.string())
            buf, at = text_buffer(text.combine_chunks())
            b, e, h, first = words(buf, at)
            number = true_names(buf, b, e, h)
            name, start = windows(mix(number.astype(U64)), first, size)
            row = np.searchsorted(first, start, "right") - 1
            whose = np.concatenate([owner[pick], doc[of]])[row]
            key = mix(name + mix(whose.astype(U64)))
            theirs = np.flatnonzero(row >= pick.size)
            by = theirs[np.argsort(key[theirs], kind="stable")]
            mine = np.flatnonzero(row < pick.size)
            ok = np.zeros(mine.size, bool)
            if by.size:
                to = by[np.minimum(np.searchsorted(key[by], key[mine]), by.size - 1)]
                ok = whose[to] == whose[mine]
                for i in range(size):
                    ok &= number[start[to] + i] == number[start[mine] + i]
            bad += pick[np.unique(row[mine[~ok]])].tolist()
        return said.select(["owner", "text"]).take(pa.array(bad, pa.int64()))

    return run


def _removed(size: int, with_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The result for the documents of a block, from the stretches to remove."""

    def named(t: pa.Table) -> np.ndarray:
        return mix(mix(t.column("doc_id").to_numpy().astype(np.int64).view(U64)) + t.column("row").to_numpy().astype(np.int64).view(U64))

    def run(docs: pa.Table, gone: pa.Table) -> pa.Table:
        n_words, n_removed, digest, text = [], [], [], []
        docs = _whole(docs)
        if gone.num_rows:
            doc = named(gone)
            order = np.argsort(doc, kind="stable")
            doc, begin, n = doc[order], *(gone.column(c).to_numpy()[order] for c in ("begin", "words"))
            ids = named(docs.set_column(docs.column_names.index("doc_id"), "doc_id", pc.fill_null(docs.column("doc_id"), 0)))
            ids[docs.column("doc_id").is_null().to_numpy()] = 0
        for lo, hi, buf, (b, e, h, first) in _parts(docs):
            cover = np.zeros(h.size + 1, np.int32)
            if gone.num_rows:
                x, y = np.searchsorted(doc, ids[lo:hi]), np.searchsorted(doc, ids[lo:hi], "right")
                which = concat_ranges(x, y - x)
                base = np.repeat(first[:-1], y - x) + begin[which]
                np.add.at(cover, base, 1)
                np.add.at(cover, base + n[which], -1)
            kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
            at = np.searchsorted(kept, first)
            data = _joined(buf, b[kept], e[kept])
            n_words += np.diff(first).tolist()
            n_removed += (np.diff(first) - np.diff(at)).tolist()
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                body = data(i, j)
                digest.append(hashlib.sha256(body).hexdigest())
                if with_text:
                    text.append(body)
        columns = {"doc_id": docs.column("doc_id").cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(columns | ({"kept": pa.array(text, pa.binary()).cast(pa.string())} if with_text else {}))

    return run


def deduplicate(docs: DataFrame, size: int = 13, rounds: int = 2, block_bytes: int = 8 << 20, range_bytes: int = 24 << 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and ``kept`` text) for each row.

    Removed are the words that are covered by ``size`` consecutive words of the
    row which also start in a row with a smaller doc_id. A null text has no
    words. Rows with a null doc_id are neither changed nor a reason to change
    others; of rows with equal doc_ids neither changes the other, and each is
    judged by its own words. Windows do not depend on what is removed elsewhere.
    """
    if rounds < 1:
        raise ValueError("at least one round is needed")
    spark = batched(docs).sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(shuffle_partitions(spark), -(-total // block_bytes))
    #: about one byte of names for four of text is sent in the first round; a block has one
    #: row for each range, so these are no more than their bytes ask for
    count = max(-(-shuffle_partitions(spark) // 2), -(-total // (4 * range_bytes)))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    #: a row is named by its id and a hash of its text, repeated rows alike
    dealt = plain.withColumn("row", F.xxhash64("text")).withColumn("begin", F.lit(0).cast("long"))
    dealt = dealt.withColumn("block", of(F.coalesce("doc_id", "row"))).select("block", "doc_id", "row", "begin", "text")
    rows = known = dealt.where("doc_id is not null")
    answer, region = "block long, key binary, r binary", "block long, doc_id long, row long, begin long, text string"

    def exchange(rows: DataFrame, k: int) -> DataFrame:
        sent = rows.groupBy("block").applyInArrow(_names(size, k, count), "r long, block long, key binary, more binary")
        return sent.groupBy("r").applyInArrow(_shared, answer)

    with Scratch(spark, "substring-dedup") as tables:
        for k in range(rounds - 1):
            rows = tables.written(rows.groupBy("block").cogroup(exchange(rows, k).groupBy("block")).applyInArrow(_regions(size, k, count), region), "regions")
        if rounds == 1:
            rows = tables.written(known, "regions")
        shared = tables.written(exchange(rows, rounds - 1), "shared")
        seen = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_send_windows(size, rounds - 1, count), "r long, block long, key binary, check binary, doc binary")
        owners = tables.written(seen.groupBy("r").applyInArrow(_first_owner, "block long, key binary, check binary, least binary"), "owners")
        none = F.lit(None).cast("binary")
        both = shared.select("block", "key", "r", none.alias("check"), none.alias("least")).unionByName(owners.withColumn("r", none))
        said = rows.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_stretches(size, rounds - 1, count), "block long, doc_id long, row long, begin long, words long, owner long, text string")
        said = tables.written(said, "stretches")
        #: a stretch that many documents hold is compared once
        once = said.select("owner", "text").distinct().withColumn("block", of("owner"))
        bad = once.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(_unverified(size), "owner long, text string")
        gone = written(said.join(small(tables.written(bad, "unverified")), ["owner", "text"], "left_anti").select("block", "doc_id", "row", "begin", "words"), "gone")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return dealt.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(_removed(size, with_text), schema)
