"""Toxicity by cumulative-link (proportional odds) regression.

Features are the distinct words of a text and the first four to six bytes of
longer words. One weight vector serves all ordered severity thresholds; the
elastic net of the FTRL learner keeps weights only where evidence is strong.
The result is the expected severity, the mean grade under the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ftrl
from .common import _P, _P_INV, _power, batched, mix, pieces, text_buffer, words
from .decontaminate import normalise

BITS = 20
FEATURES = 1 << BITS
PREFIXES = (4, 5, 6)


def features(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document ordinal) of all words and prefixes, with repeats."""
    text, at, _ = normalise(buf, at)
    b, e, h, first = words(text, at)
    doc = np.repeat(np.arange(at.size - 1), np.diff(first))
    found, owner = [h], [doc]
    if text.size:
        with np.errstate(over="ignore"):
            total = np.zeros(text.size + 1, np.uint64)
            np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _power("p", _P, text.size), out=total[1:])
            back = _power("q", _P_INV, text.size)
            for n in PREFIXES:
                long = e - b > n
                found.append(mix((total[b[long] + n] - total[b[long]]) * back[b[long]] + np.uint64(n)))
                owner.append(doc[long])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owner)


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    cuts: np.ndarray

    def scores(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        f, doc = features(buf, at)
        hit = self.weights[f] != 0
        key = np.unique(doc[hit] * FEATURES + f[hit])
        out = np.zeros(at.size - 1)
        np.add.at(out, key // FEATURES, self.weights[key % FEATURES])
        return out


def train(docs: DataFrame, labels: DataFrame, grade: str = "toxic", sample: int = 12_000, **options) -> Model:
    """Fit on labelled documents; ``sample`` bounds the expected number of rows,
    shared evenly among grades and chosen by a hash of the id.

    Grades are the distinct non-null integers of the label column, in order. A
    document with several labels counts with its highest. Without two grades
    every severity is the one grade there is, or 0.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade).cast("int").alias("grade")).where("doc_id is not null and grade is not null")
    marks = marks.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    counts = {r[0]: r[1] for r in marks.groupBy("grade").count().collect()}
    grades = sorted(counts)
    if len(grades) < 2:
        return Model(grades or [0], np.zeros(FEATURES), np.zeros(0))
    each = max(1, sample // len(grades))
    share = F.create_map(*[x for k in grades for x in (F.lit(k), F.lit(min(1.0, each / counts[k])))])
    ticket = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) + F.lit(0.5)) / F.lit(float(1 << 20))
    chosen = marks.where(ticket < share[F.col("grade")])
    plain = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = plain.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            f, doc = features(*text_buffer(batch.column("text")))
            key = np.unique(doc * FEATURES + f)
            cut = np.searchsorted(key // FEATURES, np.arange(batch.num_rows + 1))
            got = [(key[a:b] % FEATURES).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(got, pa.binary())], ["doc_id", "grade", "at"])

    got = sorted((r[0], r[1], bytes(r[2])) for r in rows.mapInArrow(sparse, "doc_id long, grade int, at binary").collect())
    y = np.array([grades.index(g) for _, g, _ in got], int)
    have = np.bincount(y, minlength=len(grades))
    #: each grade weighs as much as it does among all labelled documents
    weight = np.array([counts[g] for g in grades]) / np.maximum(have, 1)
    weight = weight / weight[have > 0].min() if len(got) else weight
    options = {"alpha": 0.3, "l1": 4.0, "l2": 0.1} | options
    w, cuts = ftrl.cumulative_link([np.frombuffer(a, np.int32) for *_, a in got], y, len(grades), FEATURES, weight[y], **options)
    return Model(grades, w, cuts)


def score(docs: DataFrame, model: Model, toxic_from: float = 0.5) -> DataFrame:
    """doc_id, severity (expected grade), grade (most probable) and toxic (severity
    at ``toxic_from`` of the way from the lowest to the highest grade, or more).

    A null or empty text has no features: it gets the severity of the intercept.
    """
    shared = batched(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        grades = np.array(m.grades)
        for batch in pieces(batches):
            p = ftrl.grade_probabilities(m.scores(*text_buffer(batch.column("text"))), m.cuts)
            severity = p @ grades
            span = grades[-1] - grades[0]
            toxic = severity >= grades[0] + toxic_from * span if span else np.zeros(batch.num_rows, bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(severity.astype(float)), pa.array(grades[p.argmax(axis=1)].astype(np.int32)), pa.array(toxic)], ["doc_id", "severity", "grade", "toxic"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")
