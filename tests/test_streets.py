"""Street geometry and unit statistics against plain versions."""

import numpy as np

from metrolith.functions import geometry as G
from metrolith.operators import matrix as M
from metrolith.operators import streets as S
from metrolith.operators import trajectory as R


def test_near_interval_equals_sampling():
    rng = np.random.default_rng(0)
    t = np.linspace(0, 1, 4001)
    hits = 0
    for _ in range(400):
        a, b, c, d = rng.integers(-5, 6, (4, 2)).astype(float)
        radius = float(rng.choice([0.5, 1, 2, 3]))
        p = a + t[:, None] * (b - a)
        s = d - c
        u = np.clip(((p - c) @ s) / max(s @ s, 1e-12), 0, 1)
        near = np.hypot(*(p - c - u[:, None] * s).T) <= radius
        lo, hi = S.near_interval(a, b, c, d, radius)
        if not (b - a).any():
            continue
        if not near.any():
            assert hi - lo < 1e-3
        else:
            assert abs(lo - t[near].min()) < 1e-3 and abs(hi - t[near].max()) < 1e-3
            hits += 1
    assert hits > 100


def test_faces_of_random_lines_tile_their_limit():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lines = [np.array([[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], float)]
        for _ in range(rng.integers(1, 6)):
            lines.append(rng.uniform(-3, 13, (2, 2)))
        rings = S.face_rings(lines)
        area = [(r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum() / 2 for r in rings]
        inside = [(r[:-1].mean(axis=0) > -1e-6).all() and (r[:-1].mean(axis=0) < 10 + 1e-6).all() for r in rings]
        assert min(area) > 0 and abs(sum(a for a, i in zip(area, inside) if i) - 100) < 1e-3


def test_polygonal_parts():
    bow = np.array([[0, 0], [4, 4], [4, 0], [0, 4], [0, 0]], float)
    assert S.polygonal_area([bow]) == (8.0, 2)
    assert S.polygonal_area([np.array([[0, 0], [4, 0], [0, 0]], float)]) == (0.0, 0)
    outer, hole = np.array([[0, 0], [9, 0], [9, 9], [0, 9], [0, 0]], float), np.array([[2, 2], [2, 4], [4, 4], [4, 2], [2, 2]], float)
    assert S.polygonal_area([outer, hole])[0] in (77.0, 81.0)


def test_triangles_are_delaunay():
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 100, (60, 2))
    for x, y, z in S.triangles(p):
        a, b, c = p[x], p[y], p[z]
        m = np.array([b - a, c - a]) * 2
        centre = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
        r = np.hypot(*(a - centre))
        others = np.delete(np.arange(60), [x, y, z])
        assert (np.hypot(*(p[others] - centre).T) > r - 1e-6).all()
    z = 2 * p[:, 0] - 3 * p[:, 1] + 1
    at = rng.uniform(20, 80, (40, 2))
    got = S.interpolated(p, z, at)
    assert np.allclose(got[~np.isnan(got)], (2 * at[:, 0] - 3 * at[:, 1] + 1)[~np.isnan(got)]) and np.isnan(got).sum() < 10
    assert np.isnan(S.interpolated(p, z, np.array([[500.0, 500.0]]))).all()


def test_shared_boundaries():
    a, b = G.parts(G.box(0, 0, 4, 4)), G.parts(G.box(4, 1, 6, 9))
    assert S.shared_length(a, b) == 3.0 == S.shared_length(b, a)
    assert S.shared_length(a, G.parts(G.box(4, 4, 5, 5))) == 0.0


def test_owned_lengths(spark):
    line = G.line_wkb(np.array([[0, 5], [10, 5], [10, 15]], float))
    units = [(1, G.box(0, 0, 10, 5)), (2, G.box(0, 5, 10, 20)), (3, G.box(10, 0, 20, 20))]
    lines = spark.createDataFrame([("a", line)], "k string, geometry binary")
    got = {r.u: r.length_m for r in S.owned_lengths(lines, "k", spark.createDataFrame(units, "u int, geometry binary"), "u", 50.0).collect()}
    assert got == {1: 10.0, 2: 10.0}


def test_unit_statistics():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 4)) @ rng.normal(size=(4, 4))
    scores, share = M.svd_axes(x, 4)
    assert np.allclose(np.cov(scores.T, bias=True), np.diag(np.var(scores, axis=0))) and abs(share[-1] - 1) < 1e-12
    assert np.allclose(np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1], np.var(scores, axis=0))
    d = M.mahalanobis(x)
    inverse = np.linalg.inv(M.ledoit_wolf(x))
    assert np.isclose(d[2, 5], np.sqrt((x[2] - x[5]) @ inverse @ (x[2] - x[5]))) and np.allclose(d, d.T)
    assert M.align_labels(np.array([2, 2, 0, 0, 1]), np.array([0, 0, 1, 1, 2])).tolist() == [0, 0, 1, 1, 2]
    z = M.normal_scores(np.array([3.0, 1.0, 2.0]))
    assert np.isclose(z[2], 0) and np.isclose(z[0], -z[1])


def test_heading_chain_and_steps(spark):
    runs = [("s", 0.0, 5.0, 10.0, 0.0), ("s", 10.0, 92.0, 80.0, 90.0), ("s", 20.0, 0.0, 10.0, 88.0), ("s", 30.0, 268.0, 90.0, 90.0), ("s", 40.0, 0.0, 5.0, -90.0)]
    df = spark.createDataFrame(runs, "session string, start_s double, bearing_deg double, distance_m double, turn_deg double")
    got = [r.quarter for r in R.quarter_headings(df, 0.0).orderBy("start_s").collect()]
    assert got == [0, 1, 2, 3, 2]
    t = np.arange(0, 20, 0.02)
    walk = 9.8 + 2 * np.sin(2 * np.pi * 1.8 * t)
    steps = R.steps(spark.createDataFrame([("s", float(a), float(b), 0.0, 0.0) for a, b in zip(t, walk)], "session string, t double, x double, y double, z double"))
    assert abs(steps.count() - 36) <= 1


def test_knocks_and_their_offset():
    rng = np.random.default_rng(4)
    t = np.arange(0, 30, 0.01)

    def signal(at):
        x = np.abs(rng.normal(0, 0.05, t.size))
        for a, h in zip(at, (4.0, 3.0, 5.0)):
            x += h * np.exp(-(((t - a) / 0.02) ** 2))
        return x

    a, b = signal((7.0, 7.8, 8.7)), signal((9.5, 10.3, 11.2))
    assert np.allclose(R.three_knocks(t, a), (7.0, 7.8, 8.7), atol=0.02)
    assert abs(R.sync_offset((t, a), (t, b)) - 2.5) < 0.02
    assert R.three_knocks(t, signal((7.0, 12.0, 19.0))) is None
    assert R.sync_offset((t, a), (t, signal((9.5, 10.3, 11.9)))) is None


def test_areas_on_land(spark):
    from metrolith.operators import spatial as P

    rows = [(1, "a", G.box(0, 0, 4, 4)), (1, "b", G.box(2, 0, 6, 4)), (2, "a", G.box(0, 0, 1, 1))]
    land = spark.createDataFrame([(1, G.box(1, 1, 5, 9)), (2, G.box(5, 5, 6, 6))], "u int, geometry binary")
    got = {(r.u, r.c): r.area for r in P.exclusive_category_areas(spark.createDataFrame(rows, "u int, c string, geometry binary"), "u", "c", land).collect()}
    assert got == {(1, "a"): 3.0, (1, "b"): 3.0, (1, "(contested)"): 6.0, (2, "a"): 0.0, (2, "(contested)"): 0.0}


def test_ties_of_asof_rows_do_not_depend_on_buckets(spark):
    from metrolith.operators import intervals as I

    left = spark.createDataFrame([("k", 5.0), ("k", 25.0)], "k string, t double")
    right = spark.createDataFrame([("k", 5.0, 1), ("k", 5.0, 9), ("k", 5.0, 4)], "k string, t double, v int")
    for width in (1.0, 10.0, 100.0):
        assert [r.v for r in I.asof_join(left, right, ["k"], "t", ["v"], width).orderBy("t").collect()] == [9, 9]


def test_entropy_refuses_what_is_no_mass(spark):
    import pytest
    from pyspark.sql import functions as F

    from metrolith.functions.stats import normalized_entropy

    for bad in (float("nan"), float("inf"), -1.0):
        with pytest.raises(Exception, match="not finite"):
            spark.createDataFrame([(bad, 1.0)], "a double, b double").select(normalized_entropy([F.col("a"), F.col("b")], 2)).collect()
    assert spark.createDataFrame([(None, 1.0)], "a double, b double").select(normalized_entropy([F.col("a"), F.col("b")], 2)).first()[0] == 0.0
