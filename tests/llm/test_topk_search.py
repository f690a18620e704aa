import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrolith.llm import topk_search as T


def whole(x, scale=256):
    return [math.floor(scale * float(y)) for y in x]


def brute(vectors, every, k=5):
    """(query_id, rank, vec_id, score) of each query row; rows of one id are several."""
    ok = [(i, whole(v)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, x) in enumerate(ok):
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), r) for n, (r, y) in enumerate(ok) if n != at and len(y) == len(x))[:k]
            out += [(q, n + 1, r, -s) for n, (s, r) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block, part, sample, leaf_rows", [(32768, 8192, 4096, 4096), (37, 5, 120, 20)])
def test_equals_brute_force(spark, block, part, sample, leaf_rows):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)).round(2)
    x[50:120] = x[50]  # many equal vectors: ties go to the smaller id
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (304, [])]
    rows += [(310, [1.0, 2.0]), (320, [0.5, -2.0]), (7, [3.0, 1.0]), (10, rows[10][1]), (10, [0.25] * 6), (11, rows[12][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit(2)).withColumn("leaf", F.lit("x"))
    got = sorted(tuple(r) for r in T.top_k(df, F.col("vec_id") % 10 == 0, 5, block, part, sample, leaf_rows).collect())
    f32 = [(i, None if v is None else [None if y is None else float(np.float32(y)) for y in v]) for i, v in rows]
    assert got == brute(f32, 10)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate((rng.normal(size=(60, 5)) * 4e5).round(3))]
    rows += [(60, [4e6, -4e6, 3.0, 0.0, 1.0]), (61, [4e6, -4e6, 3.0, 0.0, 1.0 + 2**-8]), (62, [8.4e6 * 2, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in T.top_k(df, F.col("vec_id") % 2 == 0).collect()) == brute(rows, 2)
    huge = spark.createDataFrame([(0, [1e300]), (1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in T.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63) + 1)]


def test_empty_and_few(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert T.top_k(none, F.col("vec_id") % 10 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (7, [2.0]), (7, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in T.top_k(two, F.col("vec_id") % 10 == 0).collect()) == [(0, 1, 7, 256 * 512), (0, 2, 7, 256 * 512)]
    assert T.top_k(two, F.col("vec_id") > 100).count() == 0


def test_clustered_rows_stay_where_they_are(spark, monkeypatch):
    """Leaves out of reach are pruned before their rows are copied."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(30, 16)) * 4
    rows = [(i, [float(v) for v in (centers[i % 30] + rng.normal(size=16) * 0.05).round(3)]) for i in range(1500)]
    made = {}

    class Watched(T.Scratch):
        def written(self, df, label):
            out = super().written(df, label)
            made[label] = out.count()
            return out

    monkeypatch.setattr(T, "Scratch", Watched)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in T.top_k(df, F.col("vec_id") % 10 == 0, 5, 500, 50, 1000, 20).collect())
    assert got == brute(rows, 10)
    assert made["leaves"] >= 30 and made["meet"] < 0.35 * made["leaves"] * 30


def test_cover_tree_covers():
    x = np.random.default_rng(1).integers(-50, 50, (700, 3)).astype(float)
    t = T.CoverTree(x)
    assert sorted(t.order.tolist()) == list(range(700))
    for c, r, (a, b) in zip(t.center, t.radius, t.span):
        assert np.sqrt(((x[t.order[a:b]] - x[c]) ** 2).sum(axis=1)).max() <= r + 1e-6
