"""Shared kernels of the training-data operators.

Text is handled as the UTF-8 buffers that Arrow delivers: words, hashes and
windows of a whole batch are found with a few vectorised passes, never a
Python loop over characters. Batches are cut by bytes, so a worker's memory
does not depend on how many or how long the documents are (one document is
the smallest unit).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Separators of the word definition used by the operators: space and \t..\r.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C55
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
#: Bytes of text that are looked at together; some twenty times as much memory is
#: used for them. Longer texts are taken in stretches between two words.
_SPAN = 512 << 10


def batched(df: DataFrame, rows: int = 2000) -> DataFrame:
    """The table as it is; from now on its session sends Python at most ``rows`` rows of
    texts at once, unless the session has a number of its own."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``; only where that is unset a folder below
    the warehouse is used: in local sessions, or if the warehouse is no machine's own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
        if at.startswith(("file:", "/")) and spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return at.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here,
    and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    return _kept(df, at)


def _kept(df: DataFrame, at: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(at)
    again = df.sparkSession.read.schema(df.schema).parquet(at)
    again._at = at
    return again


class Scratch:
    """A folder of intermediate tables below the shared folder, deleted at the end of
    a ``with`` block; what outlives it has to be written elsewhere before."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        delete(self.spark, self.at)

    def written(self, df: DataFrame, label: str) -> DataFrame:
        at = f"{self.at}/{label}-{uuid.uuid4().hex}"
        return _kept(df, at)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """The table, marked for broadcast if it is no longer than ``rows`` rows (of a few
    numbers each); a longer one is left to a shuffled join. The table is written
    first, so that it's counted and read without being made twice."""
    df = df if hasattr(df, "_at") else written(df, "small")
    return F.broadcast(df) if df.count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_count(spark: SparkSession, per_partition: int = 2) -> int:
    """Number of hash ranges: several per shuffle partition, so they even out."""
    return shuffle_partitions(spark) * per_partition


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or have.size < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.full(size, U64(base))
            have[0] = 1
            have = np.multiply.accumulate(have)
        #: tables for very long words aren't kept
        if size <= 2 * _SPAN:
            _powers[kind] = have
    return have[:n]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings in turn, and where each begins; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = _SPAN) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each holds ``limit`` bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_buffer(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def words(buf: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document: begins, ends (bytes), 64-bit hashes, and the
    position of each document's first word (one more entry than documents).

    A word is a maximal run without space and \\t..\\r. Equal words have equal
    hashes wherever they stand.
    """
    begins, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    full = np.diff(at) > 0
    heads, tails = at[:-1][full], at[1:][full] - 1
    lo = 0
    while lo < buf.size:
        hi = _stretch(buf, lo)
        part = _LOWER[buf[lo:hi]] if lower else buf[lo:hi]
        solid = ~_SPACE[part]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        for mark, edge in ((begin, heads), (end, tails)):
            edge = edge[np.searchsorted(edge, lo) : np.searchsorted(edge, hi)] - lo
            mark[edge] = solid[edge]
        b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        with np.errstate(over="ignore"):
            total = np.zeros(part.size + 1, U64)
            np.cumsum((part.astype(U64) + U64(1)) * _power("p", _P, part.size), out=total[1:])
            hashes.append(mix((total[e] - total[b]) * _power("q", _P_INV, part.size)[b]))
        begins.append(b + lo)
        ends.append(e + lo)
        lo = hi
    b, e, h = np.concatenate(begins), np.concatenate(ends), np.concatenate(hashes)
    return b, e, h, np.searchsorted(b, at)


def _stretch(buf: np.ndarray, lo: int) -> int:
    """Where a stretch from ``lo`` ends: at a separator, or at the end of the buffer."""
    hi = lo + _SPAN
    while hi < buf.size:
        gap = np.flatnonzero(_SPACE[buf[max(lo, hi - 4096) : hi]])
        if gap.size:
            return max(lo, hi - 4096) + int(gap[-1]) + 1
        hi += 4096
    return buf.size


def windows(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside one document, and where it starts."""
    n = h.size - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    q = _power("w", 0xD6E8FEB86659FD93, size)
    with np.errstate(over="ignore"):
        out = h[:n] * q[0]
        for j in range(1, size):
            out += h[j : j + n] * q[j]
        out = mix(out)
    ok = np.ones(n + 1, bool)
    for k in range(1, size):
        cut = first[1:-1] - k
        ok[cut[(cut >= 0) & (cut < n)]] = False
    start = np.flatnonzero(ok[:n])
    return out[start], start


def packed(a: np.ndarray) -> bytes:
    """Integers as byte planes: small ones leave planes of zeros, which the
    shuffle's compression removes."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.size else b""


def unpacked(b: bytes, dtype) -> np.ndarray:
    d = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(d.itemsize, -1).T).view(d).ravel() if len(b) else np.zeros(0, d)


def binary(values) -> pa.Array:
    return pa.array(list(values), pa.binary())


def ranges_of(h: np.ndarray, count: int) -> np.ndarray:
    """Which of ``count`` equal ranges of the hash space each value falls in."""
    return ((h >> U64(32)) * U64(count) >> U64(32)).astype(np.int64)


def runs(a: np.ndarray) -> np.ndarray:
    """Begins of runs of equal values, with the length as the last entry."""
    if not a.size:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1, [a.size]))


def concat_ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All integers of [begin, begin + length) for each entry, in turn."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = length > 0
    begin, length = begin[keep], length[keep]
    at = np.cumsum(length)[:-1]
    out[0] = begin[0]
    out[at] = begin[1:] - (begin[:-1] + length[:-1] - 1)
    return np.cumsum(out)
