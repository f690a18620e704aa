"""What larger tables bring: exact shares, ties, many copies, crowded units."""

import functools
import time

import numpy as np
import pytest

from metrolith.functions import geometry as G
from metrolith.operators import overlays as O
from metrolith.operators import spatial as S
from metrolith.operators import trajectory as R


def test_side_of_exactly_the_share(spark):
    rows = [(run, 1.0, x, x + 20) for run, left in ((1, 9), (2, 11), (3, 10)) for x in [10.0] * left + [60.0] * (20 - left)]
    got = R.road_side(spark.createDataFrame(rows, "run int, score double, x0 double, x1 double"), 100.0, share=0.55)
    assert {r.run: (r.side, r.n) for r in got.collect()} == {1: ("right", 20), 2: ("left", 20), 3: ("abstain", 20)}


def test_streets_equally_near_in_the_given_decimals(spark):
    streets = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 9.0), (2, 7.0, 0.0, 7.0, 9.0)], "street int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 3.5 + 1e-8, 4.0, 0.0), (2, 3.5 + 1e-5, 4.0, 0.0)], "k int, x double, y double, bearing_deg double")
    near = lambda **more: {r.k: (r.street, r.side) for r in O.nearest_street(points, "k", streets, "street", **more).collect()}
    assert near() == {1: (2, -1), 2: (2, -1)}
    assert near(digits=6) == {1: (1, 1), 2: (2, -1)}


def test_points_meet_equal_streets_once(spark, monkeypatch):
    streets = spark.createDataFrame([(k, 0.0, 0.0, 0.0, 9.0) for k in range(5, 505)] + [(1, 50.0, 0.0, 50.0, 9.0)], "street int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(k, 1.0 + k / 1000, 4.0, 0.0) for k in range(20)], "k int, x double, y double, bearing_deg double")
    met = []
    first = O.first_by
    monkeypatch.setattr(O, "first_by", lambda df, *a: (met.append(df.count()), first(df, *a))[1])
    assert {(r.street, r.side) for r in O.nearest_street(points, "k", streets, "street").collect()} == {(5, 1)}
    assert met == [20]


def polygons_of(rng, n):
    """Random convex quadrangles and boxes, some with a hole, some twice."""
    out = []
    for _ in range(n):
        x, y = rng.uniform(0, 8, 2)
        if rng.random() < 0.4:
            w, h = rng.integers(1, 6, 2)
            ring = G.parts(G.box(round(x), round(y), round(x) + w, round(y) + h))[0]
        else:
            t = np.sort(rng.uniform(0, 2 * np.pi, 4))
            ring = np.stack([x + 3 * np.cos(t), y + 3 * np.sin(t)], axis=1)
            ring = np.concatenate([ring, ring[:1]])
        rings = [ring]
        if rng.random() < 0.3:
            mid = ring[:-1].mean(axis=0)
            rings.append((mid + (ring - mid) / 3)[::-1])
        out += [rings] * int(rng.integers(1, 3))
    return out


def test_cover_equals_points():
    rng = np.random.default_rng(3)
    for k in range(12):
        polygons = polygons_of(rng, 8)
        owners = rng.integers(0, 3, len(polygons))
        box = (1.3, 2.1, 9.7, 8.9) if k % 2 else (-4.0, -4.0, 16.0, 16.0)
        p = rng.uniform(box[:2], box[2:], (40000, 2))
        inside = np.stack([np.any([G.locate(p, q) > 0 for q, o in zip(polygons, owners) if o == w] or [np.zeros(len(p), bool)], axis=0) for w in range(3)])
        scale = (box[2] - box[0]) * (box[3] - box[1]) / len(p)
        n, ids = inside.sum(axis=0), (inside * np.arange(3)[:, None]).sum(axis=0)
        area, m, total = G.cover(polygons, owners, box if k % 2 else None)
        for i in range(1, 4):
            for j in range(4):
                assert abs(area[(m == i) & (total == j)].sum() - ((n == i) & (ids == j)).sum() * scale) < 2.5
        #: by tiles as in one piece
        whole = G.cover(polygons, owners)
        tiles = [G.cover(polygons, owners, (x, y, x + 2.5, y + 2.5)) for x in np.arange(-5, 17.5, 2.5) for y in np.arange(-5, 17.5, 2.5)]
        for i in range(1, 4):
            assert sum(a[b == i].sum() for a, b, _ in tiles) == pytest.approx(whole[0][whole[1] == i].sum())


def test_cover_of_boxes_that_are_cut(monkeypatch):
    """However small the boxes that are swept, the pieces are the same, by rings and by WKB."""
    rng = np.random.default_rng(5)
    for k in range(5):
        polygons = polygons_of(rng, 20)
        owners = rng.integers(0, 3, len(polygons))
        for box in (None, (1.3, 2.1, 9.7, 8.9), (2.0, 2.0, 5.0, 6.0)):
            sums = []
            for leaf in (1 << 30, 60, 12):
                monkeypatch.setattr(G, "LEAF", leaf)
                for area, n, ids in (G.cover(polygons, owners, box), G.cover_edges(*G.edge_table([G.polygon_wkb(p) for p in polygons]), owners, box)):
                    sums.append([area[(n == i) & (ids == j)].sum() for i in range(1, 4) for j in range(4)])
            assert np.abs(np.array(sums) - sums[0]).max() < 1e-9


def turned(n, step):
    """n * n different turned squares, one inside each square of a grid: their rings and areas."""
    rng = np.random.default_rng(7)
    at, t, size = np.stack(np.divmod(np.arange(n * n), n), axis=1), rng.uniform(0, np.pi, n * n), rng.uniform(0.2, 0.7, n * n) * step
    corner = np.pi / 4 + np.pi / 2 * np.arange(5)
    rings = [(a + 0.5) * step + s / np.sqrt(2) * np.stack([np.cos(u + corner), np.sin(u + corner)], axis=1) for a, u, s in zip(at, t, size)]
    return [[np.concatenate([r[:4], r[:1]])] for r in rings], at, size**2


def test_cover_of_many_different_polygons():
    """Slabs times edges took 26 s; the second owner holds a half."""
    polygons, at, areas = turned(64, 10.0)
    half = G.parts(G.box(0, 0, 320, 640))
    began = time.monotonic()
    area, n, ids = G.cover([*polygons, half], np.array([1] * len(polygons) + [2]), (0.0, 0.0, 640.0, 640.0))
    assert time.monotonic() - began < 10
    left = areas[at[:, 0] < 32].sum()
    assert [area[ids == i].sum() for i in (1, 2, 3)] == pytest.approx([areas.sum() - left, 320 * 640 - left, left])


def test_coverage_of_many_different_footprints(spark):
    """A unit that is no rectangle takes what lies inside it, not inside its box."""
    polygons, at, areas = turned(64, 10.0)
    df = spark.createDataFrame([(bytearray(G.polygon_wkb(p)),) for p in polygons for _ in (0, 1)], "geometry binary")
    bend = G.polygon_wkb([np.array([[320, 0], [960, 0], [960, 640], [640, 640], [640, 320], [320, 320], [320, 0]], float)])
    units = spark.createDataFrame([(0, bytearray(G.box(0, 0, 320, 640))), (1, bytearray(bend)), (2, bytearray(G.box(640, 0, 960, 640)))], "unit int, geometry binary")
    land = spark.createDataFrame([(0, bytearray(G.box(0, 0, 160, 640))), (1, bytearray(G.box(480, 0, 700, 640)))], "unit int, geometry binary")
    began = time.monotonic()
    got = {r.unit: (r.covered_m2, r.summed_m2, r.on_land_m2) for r in S.union_coverage(df, units, "unit", 500.0, land).collect()}
    assert time.monotonic() - began < 60
    i, j = at.T
    in_0, in_1 = i < 32, (i >= 32) & (j < 32)
    assert set(got) == {0, 1}
    for u, inside, ground in ((0, in_0, i < 16), (1, in_1, i >= 48)):
        assert got[u] == pytest.approx((areas[inside].sum(), 2 * areas[inside].sum(), areas[inside & ground].sum()))


def crowd(spark, n):
    """Boxes at 100 places, and what covers each unit square, by unit and code."""
    rows, cells = [], np.zeros((2, 3, 130, 130), bool)
    for k in range(n):
        x, y, w, h = k * 37 % 100, k * 53 % 100, 10 + k % 20, 5 + k % 25
        rows.append((k % 2, f"R{k % 3}" if k % 3 else "C", bytearray(G.box(x, y, x + w, y + h))))
        cells[k % 2, k % 3, x : x + w, y : y + h] = True
    return spark.createDataFrame(rows, "unit int, code string, geometry binary"), cells


def test_areas_of_crowded_units(spark):
    """6,000 boxes a unit: the union of all pairs of polygons took minutes for 800."""
    df, cells = crowd(spark, 12000)
    n = cells.sum(axis=1)
    want = {(u, c): float((cells[u, i] & (n[u] == 1)).sum()) for u in (0, 1) for i, c in enumerate(("C", "R1", "R2"))} | {(u, "(contested)"): float((n[u] > 1).sum()) for u in (0, 1)}
    for tile in (None, 50.0):
        began = time.monotonic()
        got = {(r.unit, r.code): r.area for r in S.exclusive_category_areas(df, "unit", "code", tile=tile).collect()}
        assert got == want and time.monotonic() - began < 60


def test_support_of_crowded_blocks(spark):
    df, cells = crowd(spark, 12000)
    n = cells.sum(axis=1)
    want = {u: (float(((n[u] == 1) & ~cells[u, 0]).sum()), float((n[u] > 0).sum()), float((n[u] > 1).sum())) for u in (0, 1)}
    for tile in (None, 50.0):
        began = time.monotonic()
        assert {r.unit: (r.support, r.covered, r.ambiguous) for r in O.exclusive_support(df, "unit", "code", "R", tile).collect()} == want
        assert time.monotonic() - began < 60


def test_land_of_crowded_districts(spark):
    df, cells = crowd(spark, 12000)
    b = cells.any(axis=(0, 1))
    units = spark.createDataFrame([(u, bytearray(G.box(65 * u, 0, 65 * u + 65, 130))) for u in (0, 1)], "unit int, geometry binary")
    land = spark.createDataFrame([(u, bytearray(G.box(65 * u + 10, 20, 65 * u + 45, 130))) for u in (0, 1)], "unit int, geometry binary")
    began = time.monotonic()
    got = {r.unit: r.on_land_m2 for r in S.union_coverage(df.select("geometry"), units, "unit", 50.0, land).collect()}
    assert got == {u: float(b[65 * u + 10 : 65 * u + 45, 20:].sum()) for u in (0, 1)} and time.monotonic() - began < 60


def test_coverage_of_crowded_districts(spark):
    df, cells = crowd(spark, 12000)
    b = cells.any(axis=(0, 1))
    units = spark.createDataFrame([(u, bytearray(G.box(65 * u, 0, 65 * u + 65, 130))) for u in (0, 1)], "unit int, geometry binary")
    began = time.monotonic()
    got = {r.unit: (r.covered_m2, r.summed_m2) for r in S.union_coverage(df.select("geometry"), units, "unit", 50.0).collect()}
    part = lambda k, u: max(0, min(65 * u + 65, k * 37 % 100 + 10 + k % 20) - max(65 * u, k * 37 % 100)) * (5 + k % 25)
    assert got == {u: (float(b[65 * u : 65 * u + 65].sum()), float(sum(part(k, u) for k in range(12000)))) for u in (0, 1)} and time.monotonic() - began < 60


def test_overlaps_of_copies_are_tested_once(spark, monkeypatch):
    boxes = [(k, (k * 37 % 10, k * 53 % 10, k * 37 % 10 + 4 + k % 3, k * 53 % 10 + 5)) for k in range(240)] + [(k, None) for k in range(240, 280)]
    star = G.polygon_wkb([np.array([[2, 2], [8, 3], [3, 8], [2, 2]], float)])
    df = spark.createDataFrame([(k, bytearray(star if b is None else G.box(*b))) for k, b in boxes], "k int, geometry binary")
    g = {k: G.parts(star if b is None else G.box(*b)) for k, b in boxes}
    over = functools.cache(lambda a, b: G.overlap_area(G.parts(a), G.parts(b)) >= 0.25 * min(G.area(G.parts(a)), G.area(G.parts(b))) - 1e-12)
    wkb = {k: star if b is None else G.box(*b) for k, b in boxes}
    want = {(i, j) for i in g for j in g if i < j and over(wkb[i], wkb[j])}
    met = []
    meet = O.candidates
    monkeypatch.setattr(O, "candidates", lambda *a: (met.append(meet(*a).count()), meet(*a))[1])
    got = [(r.a, r.b) for r in O.overlapping_pairs(df, "k", 6.0, 0.25).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert met[0] <= 31 * 31
