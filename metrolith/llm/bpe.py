"""Byte-level BPE encoding and decoding with a local rank file.

Ranks are read once on the driver and broadcast (a vocabulary is of fixed
size); no executor needs the file. Texts are cut at safe boundaries before
they reach the encoder, so a very long text costs no more memory than a short
one, and decoding works on raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, pieces

#: A space between two non-spaces: every token of the split pattern may begin
#: with one space and none holds a space further in, so a token always begins here.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Runs of white space so long that the split pattern's look-ahead would exhaust the
#: stack of its engine. The characters are those of the Unicode property White_Space.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{8192,}")
_made: dict = {}


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def safe_parts(text: str, limit: int = 4096) -> list[str]:
    """Cut a text into parts of about ``limit`` characters whose encodings,
    put together, are the encoding of the text. A part without a safe
    boundary stays longer."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = _SAFE.search(text, at + limit)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def stretches(text: str, limit: int = 4096) -> Iterator[tuple[str, bool]]:
    """Safe parts of a text, and whether a part is one match of the pattern as it stands.

    A long run of white space is such a match, whole at the end of a text and
    otherwise without its last character, which the next match may begin with."""
    at = 0
    for m in _RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        if m.start() > at:
            yield from ((p, False) for p in safe_parts(text[at : m.start()], limit))
        yield text[m.start() : end], True
        at = end
    if at < len(text):
        yield from ((p, False) for p in safe_parts(text[at:], limit))


def encoder(table: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode(text: str, enc) -> list[int]:
    if len(text) <= 4096:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part, single in stretches(text):
        ids += _ids(part, single, enc)
    return ids


def _ids(part: str, single: bool, enc) -> list[int]:
    return enc._encode_single_piece(part) if single else enc.encode_ordinary(part)


def _cached(shared):
    """One encoder for each worker process."""
    if shared.value["key"] not in _made:
        table = shared.value["ranks"]
        names = {rank: b"%d" % rank for rank in table.values()}
        _made[shared.value["key"]] = encoder(table, shared.value["pattern"]), {v: k for k, v in table.items()}, names
    return _made[shared.value["key"]]


def _shared(docs: DataFrame, path: str, pattern: str):
    return batched(docs).sparkSession.sparkContext.broadcast({"key": (path, pattern), "ranks": ranks(path), "pattern": pattern})


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of each whole text as ``array<int>``; null is an empty text.

    Empty table: empty result. Any other columns stay, but one named like the
    new column is replaced.
    """
    shared = _shared(docs, path, pattern)
    rest = docs.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _cached(shared)[0]
        for batch in pieces(batches, text):
            got = [encode(t or "", enc) for t in batch.column(text).to_pylist()]
            yield batch.append_column(ids, pa.array(got, pa.list_(pa.int32())))

    return rest.mapInArrow(run, f"{rest._jdf.schema().toDDL()}, `{ids}` array<int>" if rest.columns else f"`{ids}` array<int>")


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Add the raw bytes that the ids stand for; null ids give no bytes."""
    shared = _shared(encoded, path, public_tokenizers.PATTERN)
    rest = encoded.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _cached(shared)[1]
        for batch in batches:
            got = [b"".join(map(token.__getitem__, row or ())) for row in batch.column(ids).to_pylist()]
            yield batch.append_column(out, pa.array(got, pa.binary()))

    return rest.mapInArrow(run, f"{rest._jdf.schema().toDDL()}, `{out}` binary")


def digest_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row.

    Encoding, decoding and both digests of a text happen in one pass; a digest
    takes in the ids of one safe part after the other, so no list of all ids
    of a long text is held; a run of white space of any length is encoded whole.
    Repeated rows give repeated results; a null doc_id
    is passed on as null.
    """
    shared = _shared(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, token, names = _cached(shared)
        for batch in pieces(batches):
            counts, coded, plain = [], [], []
            for text in batch.column("text").to_pylist():
                n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                for part, single in stretches(text or ""):
                    ids = _ids(part, single, enc)
                    if ids:
                        a.update((b"," if n else b"") + b",".join([names[i] for i in ids]))
                        b.update(b"".join([token[i] for i in ids]))
                        n += len(ids)
                counts.append(n)
                coded.append(a.hexdigest())
                plain.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded), pa.array(plain)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
