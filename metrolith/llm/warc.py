"""WARC archives through a chunked record table.

Writing goes through rows of (record identifier, chunk number, chunk): a
payload is cut into chunks as it is read, each chunk row carries the digest of
the payload so far, and each chunk becomes one WARC record (a ``response``
or, from the second chunk on, a ``continuation`` segment). Reading turns
records back into chunk rows and digests them in order, so neither side holds
an oversized payload as one value. Archives are written and read by Spark's
own file sources; any file system that Spark knows will do.

Equal payloads of ``min_bytes`` or more are stored once: the record of the
largest page_id is the response, the others are ``revisit`` records.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, pieces, shared_dir, written

CHUNK_CHARS = 16_384
_CHUNKS = "rid string, page_id long, url string, chunk_no int, last boolean, bytes_so_far long, digest_so_far string, chunk string"
_SEGMENTS = "rid string, page_id long, record_type string, refers_to long, chunk_no int, last boolean, full_bytes long, full_digest string, chunk binary"
_RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), types[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def chunk_table(pages: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Rows of record identifier and chunk number, with running byte count and SHA-1.

    A null or empty html gives one empty chunk. Each input row is a record,
    repeated page_ids included; other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, "html"):
            rows, size = [], 0
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                rid, n = f"{part}-{n}", n + 1
                done, total, html = hashlib.sha1(), 0, html or ""
                for k, at in enumerate(range(0, max(1, len(html)), chunk_chars)):
                    chunk = html[at : at + chunk_chars]
                    data = chunk.encode()
                    done.update(data)
                    total += len(data)
                    size += len(data)
                    rows.append((rid, page, url, k, at + chunk_chars >= len(html), total, done.hexdigest(), chunk))
                    if size > 4 << 20:
                        yield _table(rows, _CHUNKS)
                        rows, size = [], 0
            yield _table(rows, _CHUNKS)

    return batched(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, _CHUNKS)


def _delimiter(token: str) -> str:
    return f"WARC/1.1\r\nWARC-Boundary: {token}\r\n"


def write_archive(chunks: DataFrame, path: str, min_bytes: int = 1000) -> str:
    """Write gzip-compressed WARC files from a (materialised) chunk table; returns
    the archive's boundary token, a header that no payload can hold by chance."""
    heads = chunks.where("last").select("rid", "page_id", F.col("bytes_so_far").alias("n"), F.col("digest_so_far").alias("digest"))
    large = heads.where(F.col("n") >= min_bytes)
    first = large.groupBy("digest", "n").agg(F.max(F.struct("page_id", "rid")).alias("w"), F.count("*").alias("copies")).where("copies > 1")
    first = first.select("digest", "n", F.col("w.page_id").alias("refers_to"), F.col("w.rid").alias("refers_rid"))
    revisits = large.join(first, ["digest", "n"]).where("rid <> refers_rid").select("rid", "refers_to", "refers_rid")
    token = uuid.uuid4().hex
    rows = chunks.join(revisits, "rid", "left").where("refers_rid is null or last")

    header = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\r\n"))
    only_if = lambda test, value: F.when(test, value).otherwise(F.lit(""))
    revisit = F.col("refers_rid").isNotNull()
    payload = F.when(revisit, F.lit("")).otherwise(F.col("chunk"))
    segmented = ~revisit & ~((F.col("chunk_no") == 0) & F.col("last"))
    kind = F.when(revisit, "revisit").when(F.col("chunk_no") == 0, "response").otherwise("continuation")
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20]", "%20")
    text = F.concat(
        F.lit(_delimiter(token)),
        header("WARC-Type", kind),
        header("WARC-Record-ID", F.concat(F.lit("<urn:record:"), F.col("rid"), F.lit(":"), F.col("chunk_no").cast("string"), F.lit(">"))),
        header("WARC-Target-URI", url),
        header("WARC-Page-ID", F.col("page_id")),
        only_if(segmented, header("WARC-Segment-Number", F.col("chunk_no") + 1)),
        only_if(segmented & (F.col("chunk_no") > 0), header("WARC-Segment-Origin-ID", F.concat(F.lit("<urn:record:"), F.col("rid"), F.lit(":0>")))),
        only_if(segmented & F.col("last"), header("WARC-Segment-Total-Length", F.col("bytes_so_far"))),
        only_if(F.col("last"), header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest_so_far")))),
        only_if(revisit, header("WARC-Refers-To", F.concat(F.lit("<urn:record:"), F.col("refers_rid"), F.lit(":0>")))),
        only_if(revisit, header("WARC-Refers-To-Page-ID", F.col("refers_to"))),
        only_if(revisit, header("WARC-Payload-Length", F.col("bytes_so_far"))),
        header("Content-Length", F.octet_length(payload)),
        F.lit("\r\n"),
        payload,
        F.lit("\r\n"),
    )
    rows.select(text.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)
    return token


def read_segments(spark: SparkSession, path: str, token: str) -> DataFrame:
    """Chunk rows of an archive. A record of one segment is digested at once and
    carries no chunk further; only segments of larger records do."""

    def number(x: str | None) -> int | None:
        return int(x) if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "value"):
            rows = []
            for record in batch.column("value").to_pylist():
                head, _, body = record.partition("\r\n\r\n")
                at = dict(line.split(": ", 1) for line in head.split("\r\n") if ": " in line)
                rid, chunk_no = at["WARC-Record-ID"][len("<urn:record:") : -1].rsplit(":", 1)
                data = body.encode()[: int(at["Content-Length"])]
                digest, page = at.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, number(at.get("WARC-Page-ID"))
                if at["WARC-Type"] == "revisit":
                    rows.append((rid, page, "revisit", number(at.get("WARC-Refers-To-Page-ID")), 0, True, int(at["WARC-Payload-Length"]), digest, None))
                elif "WARC-Segment-Number" in at:
                    rows.append((rid, page, "response", None, int(chunk_no), digest is not None, number(at.get("WARC-Segment-Total-Length")), digest, data))
                else:
                    _same(rid, digest, hashlib.sha1(data).hexdigest())
                    rows.append((rid, page, "response", None, 0, True, len(data), digest, None))
            yield _table(rows, _SEGMENTS)

    return spark.read.option("lineSep", _delimiter(token)).text(path).where("value <> ''").mapInArrow(run, _SEGMENTS)


def _same(rid: str, said: str | None, got: str) -> None:
    if said != got:
        raise ValueError(f"record {rid}: its payload has digest {got}, its header says {said}")


_RECORDS = "file string, record_no long, warc_type string, record_id string, target_uri string, headers map<string,string>, chunk_no int, last boolean, bytes_so_far long, digest_so_far string, chunk binary"


def read_records(spark: SparkSession, path: str, chunk_bytes: int = 64 << 10) -> DataFrame:
    """Chunk rows of the records of gzip-compressed WARC files by any writer, of one gzip
    member a file or a record: records are framed by their Content-Length, whatever
    their payload holds. Rows of a record are in order of chunk_no and carry the running
    byte count and SHA-1 of its block.

    A compressed file is read by one task, in order; a block is one value there while
    it is cut. A file that ends inside a record is an error."""
    mark = "WARC/1."

    def chunks(file: str, n: int, head: bytes, block: bytes) -> Iterator[tuple]:
        at: dict[str, str] = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                at[name.strip()] = value.strip()
        by = {k.lower(): v for k, v in at.items()}
        done = hashlib.sha1()
        for k, lo in enumerate(range(0, max(1, len(block)), chunk_bytes)):
            part = block[lo : lo + chunk_bytes]
            done.update(part)
            yield (file, n, by.get("warc-type"), by.get("warc-record-id"), by.get("warc-target-uri"), list(at.items()), k, lo + chunk_bytes >= len(block), lo + len(part), done.hexdigest(), part)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split()[0] for x in _RECORDS.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, n, held, rows, size = None, 0, None, [], 0
        for batch in batches:
            for now, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                if now != file:
                    if held is not None:
                        raise ValueError(f"{file} ends inside a record")
                    file, n = now, 0
                    if not value.strip():
                        continue
                held = value if held is None else held + mark.encode() + value
                head, blank, body = held.partition(b"\r\n\r\n")
                length = [x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                if not blank or not length or len(body) < int(length[0]):
                    continue  # the mark stood inside the record
                for row in chunks(file, n, head, body[: int(length[0])]):
                    rows.append(row)
                    size += len(row[-1])
                    if size > 4 << 20:
                        yield table(rows)
                        rows, size = [], 0
                n, held = n + 1, None
        if held is not None:
            raise ValueError(f"{file} ends inside a record")
        yield table(rows)

    lines = spark.read.option("lineSep", mark).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return batched(lines).mapInArrow(run, _RECORDS)


def digest_records(segments: DataFrame) -> DataFrame:
    """One row for each record: segments of a record meet in order and are
    digested one after the other; the task holds one chunk at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, done, n = None, hashlib.sha1(), 0
        for batch in batches:
            rows = []
            for now, page, kind, refers, k, last, total, said, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk is None:
                    rows.append((page, total, said, kind, refers))
                    continue
                if now != rid:
                    rid, done, n = now, hashlib.sha1(), 0
                    if k != 0:
                        raise ValueError(f"record {rid}: its first segment is missing")
                done.update(chunk)
                n += len(chunk)
                if last:
                    _same(rid, said, done.hexdigest())
                    rows.append((page, n, said, kind, refers))
            yield _table(rows, _RESULT)

    return segments.repartition(F.col("rid")).sortWithinPartitions("rid", "chunk_no").mapInArrow(run, _RESULT)


def round_trip(pages: DataFrame, min_bytes: int = 1000, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Archive every row of ``pages`` and read the archive back: page_id,
    payload_bytes, payload_digest, record_type, refers_to for each row.

    Null html: an empty payload. Null page_id or url: kept as null. Empty
    table: no rows. Equal payloads below ``min_bytes`` are all responses.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    token = write_archive(written(chunk_table(pages, chunk_chars), "warc-chunks"), path, min_bytes)
    return digest_records(read_segments(spark, path, token))
