"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with FTRL and elastic net, then temperature-calibrated.

Document frequencies and language counts cover all training documents. The
classifier is fitted on a sample of them whose expected size is bounded by
``sample`` (and calibrated on one bounded by ``calibration``); rows are chosen
by a hash of doc_id, so the sample does not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ftrl
from .common import batched, pieces, text_buffer

BITS = 15
FEATURES = 1 << BITS
_SCALE = 20.0
_UNIT = 1 << 16
#: Bytes of text whose n-grams are held at once (one text at least).
_PIECE = 256 << 10
_tables: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        _tables["letter"] = np.array([chr(c).isalpha() for c in range(0x110000)])
        _tables["lower"] = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x600)], np.uint32)
    return _tables["letter"], _tables["lower"]


def letters(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters of each text, each run of other characters as one 0.

    Returns symbols, document offsets, and whether a document has a letter."""
    letter, lower = _letters()
    c = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.zeros(buf.size + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=starts[1:])
    at = starts[at]
    known = letter[c]
    small = c < lower.size
    c = np.where(known, np.where(small, lower[np.minimum(c, lower.size - 1)], c), 0).astype(np.uint32)
    keep = known.copy()
    keep[1:] |= known[:-1]
    edge = at[:-1][np.diff(at) > 0]
    keep[edge] = True
    n = np.zeros(c.size + 1, np.int64)
    np.cumsum(known, out=n[1:])
    place = np.zeros(c.size + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return c[keep], place[at], n[at[1:]] > n[at[:-1]]


def features(c: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Hashed n-grams of 1, 2 and 3 symbols that end at each position; the first
    ones of a text look back on 0s, whatever stands before it in the batch."""
    c = c.astype(np.uint64)
    one, two = np.zeros_like(c), np.zeros_like(c)
    one[1:], two[2:] = c[:-1], c[:-2]
    first = at[:-1][np.diff(at) > 0]
    one[first], two[first] = 0, 0
    second = first[np.diff(np.append(first, c.size)) > 1] + 1
    two[second] = 0
    a, b, d = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    shift = np.uint64(64 - BITS)
    h1 = (c + np.uint64(1)) * a
    h2 = h1 + (one + np.uint64(1)) * b
    h3 = h2 + (two + np.uint64(1)) * d
    m = np.uint64(0xFF51AFD7ED558CCD)
    return [((h ^ (h >> np.uint64(29))) * m >> shift).astype(np.int32) for h in (h1, h2, h3)]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # idf * weight, one row per feature, as multiples of 2^-16
    intercept: np.ndarray
    temperature: float

    def logits(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated logits of each text, and whether it has a letter."""
        c, at, known = letters(buf, at)
        out = np.zeros((at.size - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(at) > 0)
        if full.size and self.languages:
            #: sums of integers: the same for a text alone and in any batch
            total = np.zeros((c.size, len(self.languages)), np.int32)
            for f in features(c, at):
                total += self.table[f]
            out[full] = np.add.reduceat(total, at[full], axis=0, dtype=np.int64) / np.diff(at)[full, None] * (_SCALE / _UNIT)
        return out + self.intercept, known


def _plain(docs: DataFrame, *more) -> DataFrame:
    return batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def train(docs: DataFrame, language: str = "lang", sample: int = 4000, calibration: int = 1000, **options) -> Model:
    """Learn from rows whose text and language are not null.

    Without such rows the model knows no language and predicts ``und``.
    """
    rows = _plain(docs, F.col(language).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((FEATURES, 0), np.int32), np.zeros(0), 1.0)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, seen = np.zeros(FEATURES, np.int64), 0, np.zeros(FEATURES, bool)
        for batch in pieces(batches, limit=_PIECE):
            c, at, _ = letters(*text_buffer(batch.column("text")))
            f = features(c, at)
            for lo, hi in zip(at[:-1], at[1:]):
                seen[:] = False
                for x in f:
                    seen[x[lo:hi]] = True
                df += seen
            n += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["feature", "n"])

    df, total = np.zeros(FEATURES), 0
    for feature, n in rows.select("text").mapInArrow(frequency, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():
        if feature < 0:
            total = n
        else:
            df[feature] = n
    idf = np.log((total + 1) / (df + 1)) + 1

    #: a fixed share of each language, by a hash of the row's id and text
    each = max(1, (sample + calibration) // len(languages))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, each / counts[k])))])
    ticket = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) + F.lit(0.5)) / F.lit(float(1 << 20))
    chosen = rows.withColumn("ticket", ticket).withColumn("share", share[F.col("lang")]).where("ticket < share")
    chosen = chosen.select("lang", "text", (F.col("ticket") / F.col("share") < sample / (sample + calibration)).alias("fit"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=_PIECE):
            c, at, _ = letters(*text_buffer(batch.column("text")))
            f = features(c, at)
            got = [np.unique(np.concatenate([x[lo:hi] for x in f]), return_counts=True) for lo, hi in zip(at[:-1], at[1:])]
            pack = lambda k: pa.array([g[k].astype(np.int32).tobytes() for g in got], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("fit"), pa.array(np.diff(at)), pack(0), pack(1)], ["lang", "fit", "size", "at", "count"])

    fit, known, held, truth = [], [], [], []
    for lang, for_fit, size, at, n in chosen.mapInArrow(sparse, "lang string, fit boolean, size long, at binary, count binary").collect():
        at, n = np.frombuffer(at, np.int32), np.frombuffer(n, np.int32)
        row = (at, n / max(1, size) * idf[at] * _SCALE)
        (fit if for_fit else held).append(row)
        (known if for_fit else truth).append(languages.index(lang))
    order = sorted(range(len(fit)), key=lambda i: (known[i], fit[i][0].size, fit[i][1].sum()))
    w = ftrl.multinomial([fit[i] for i in order], np.array([known[i] for i in order]), FEATURES, len(languages), **options)
    logits = np.array([x @ w[at] + w[-1] for at, x in held]).reshape(-1, len(languages))
    return Model(languages, np.round(idf[:, None] * w[:-1] * _UNIT).clip(-(2**29), 2**29).astype(np.int32), w[-1], ftrl.temperature(logits, np.array(truth, int)))


def _predict(shared, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    m = shared.value
    logits, known = m.logits(*text_buffer(batch.column("text")))
    if not m.languages:
        return ["und"] * batch.num_rows, np.zeros(batch.num_rows)
    p = ftrl.softmax(logits / m.temperature)
    best = p.argmax(axis=1)
    return [m.languages[b] if k else "und" for b, k in zip(best, known)], np.where(known, p.max(axis=1), 0.0)


def predict(docs: DataFrame, model: Model, *more) -> DataFrame:
    """doc_id, columns ``more``, lang_pred and score (calibrated probability) for each row.

    A text that is null or has no letter is ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = _plain(docs, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=_PIECE):
            lang, score = _predict(shared, batch)
            yield batch.drop_columns(["text"]).append_column("lang_pred", pa.array(lang, pa.string())).append_column("score", pa.array(score))

    return plain.mapInArrow(run, plain.drop("text")._jdf.schema().toDDL() + ", lang_pred string, score double")


def fold(column: str = "doc_id"):
    """True for the rows that are held out of training."""
    return (F.crc32(F.col(column).cast("string").cast("binary")) % 5) == 0


def predict_held_out(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents that are
    not held out (a null doc_id is in neither part) and applied to all."""
    model = train(docs.where(~fold()), **options)
    return predict(docs, model, fold().alias("held_out")).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.35, **options) -> DataFrame:
    """The documents whose language is identified with probability ``least`` or
    more, with all their columns. Null texts and texts without letters go."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=_PIECE):
            lang, score = _predict(shared, batch)
            yield batch.filter(pa.array([a != "und" and b >= least for a, b in zip(lang, score.tolist())]))

    return docs.mapInArrow(run, docs.schema)
