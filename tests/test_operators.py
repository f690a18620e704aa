"""Small cases with answers worked out by hand, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrolith.functions import geometry as G
from metrolith.functions import numbers as N
from metrolith.functions import stats as S
from metrolith.functions import text as X
from metrolith.operators import graph, intervals, matrix, relational, similarity, spatial, trajectory, transit


def one(df):
    return [tuple(r) for r in df.collect()]


def boxes(spark, rows, key):
    return spark.createDataFrame([(k, bytearray(G.box(*b)), *rest) for k, b, *rest in rows], key)


def test_clock(spark):
    df = spark.createDataFrame([("07:00:00",), ("25:30:00",)], "x string")
    assert [r[0] for r in df.select(N.clock_seconds(F.col("x"))).collect()] == [25200, 91800]
    bad = spark.createDataFrame([("12:61:00",)], "x string")
    assert bad.select(N.clock_seconds(F.col("x"), strict=False)).first()[0] is None
    with pytest.raises(Exception, match="clock"):
        bad.select(N.clock_seconds(F.col("x"))).collect()


def test_headways(spark):
    df = spark.range(1)
    lit = lambda *v: [F.lit(x) for x in v]
    got = df.select(*[N.expected_departures(*lit(*v)) for v in ((0, 3600, 60, 0, 0, 3600), (0, 3600, 60, 600, 0, 3600), (0, 3600, 60, 0, 3600, 7200))]).first()
    assert tuple(got) == (60, 50, 0)
    for s, e, h, o, lo, hi in ((0, 3600, 60, 0, 0, 3600), (100, 5000, 77, 31, 400, 4000), (0, 100, 30, 500, 0, 400)):
        want = sum(1 for k in range(1000) if s + k * h < e and lo <= s + k * h + o < hi)
        assert df.select(N.exact_departures(*lit(s, e, h, o, lo, hi))).first()[0] == want


def test_access_index_of_the_published_example(spark):
    rows = [("bus", 0.0, 30.0), ("bus", 80.0, 10.0)]
    df = spark.createDataFrame(rows, "mode string, d double, f double").select(N.edf(F.col("d"), F.col("f"), F.col("mode")).alias("e"))
    a, b = 30 / (0 + 1 + 2), 30 / (1 + 3 + 2)
    assert df.agg(transit.access_of_mode(F.col("e"))).first()[0] == pytest.approx(max(a, b) + min(a, b) / 2)


def test_calendar(spark):
    days = "monday tuesday wednesday thursday friday saturday sunday".split()
    cal = spark.createDataFrame([("regular", "20260101", "20261231", *"1111100")], ["service_id", "start_date", "end_date", *days])
    exc = spark.createDataFrame([("regular", "20260916", "2"), ("special", "20260916", "1"), ("regular", "20261007", "2")], "service_id string, date string, exception_type string")
    assert one(transit.active_services(cal, exc, "20260916")) == [("special",)]
    assert one(transit.active_services(cal, exc, "20261007")) == []
    wrong = spark.createDataFrame([("x", "20260916", "7")], "service_id string, date string, exception_type string")
    with pytest.raises(Exception, match="exception type"):
        transit.active_services(cal, wrong, "20260916").collect()


def test_supply(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 2000.0, 0.0)], "point_id long, x double, y double")
    stops = spark.createDataFrame([("a", 100.0, 0.0), ("b", 200.0, 0.0), ("c", 700.0, 0.0)], "stop_id string, x2 double, y2 double")
    service = spark.createDataFrame([("a", "r", 0, 3), ("b", "r", 0, 5), ("a", "r", 1, 2), ("c", "r", 0, 9)], "stop_id string, route_id string, direction_id int, departures int")
    got = transit.supply(spatial.within(points, stops, 800.0), service, [400, 800])
    assert one(got) == [(0, 7, 11)]


def test_allocation_keeps_the_rest_outside(spark):
    blocks = boxes(spark, [("a", (0, 0, 600, 100), 120.0, 30.0)], "block string, geometry binary, pop double, jobs double")
    units = boxes(spark, [("CHI:01", (0, 0, 200, 100)), ("CHI:02", (200, 0, 400, 100))], "unit string, geometry binary")
    got = sorted(one(spatial.allocate(blocks, "block", units, "unit", ["pop", "jobs"], 250.0).select("unit", "pop", "jobs")))
    assert [g[1] for g in got] == pytest.approx([40, 40]) and sum(g[2] for g in got) == pytest.approx(20)
    twice = boxes(spark, [("x", (0, 0, 600, 100)), ("y", (0, 0, 600, 100))], "unit string, geometry binary")
    with pytest.raises(Exception, match="allocation above 1"):
        spatial.allocate(blocks, "block", twice, "unit", ["pop"], 250.0).collect()


def test_jobs_fall_back_to_area(spark):
    p = spark.createDataFrame([("b", "CHI:01", 50.0, 0.0, 20.0), ("b", "OUT", 50.0, 0.0, 80.0), ("c", "CHI:01", 100.0, 0.0, 50.0), ("c", "OUT", 100.0, 20.0, 50.0)], "block string, unit string, jobs double, support double, area double")
    got = {(r.block, r.unit): (r.allocated, r.fallback) for r in spatial.allocate_jobs(p, "block", "jobs", "support", "area").collect()}
    assert got == {("b", "CHI:01"): (10.0, True), ("b", "OUT"): (40.0, True), ("c", "CHI:01"): (0.0, False), ("c", "OUT"): (100.0, False)}


def test_owner_by_overlap(spark):
    units = boxes(spark, [("01", (0, 0, 10, 10)), ("02", (10, 0, 20, 10))], "unit string, geometry binary")
    things = boxes(spark, [(1, (8, 1, 14, 3)), (2, (20, 1, 21, 3)), (3, (9, 1, 11, 3))], "k long, geometry binary")
    got = {r.k: (r.unit, r.inside, r.candidates) for r in spatial.largest_overlap(things, "k", units, "unit", 5.0).collect()}
    assert got[1][:2] == ("02", pytest.approx(8)) and got[2][:2] == (None, 0) and got[3] == ("01", pytest.approx(2), 2)


def test_overlap_of_general_polygons():
    hole = [np.array([[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], float), np.array([[4, 4], [4, 6], [6, 6], [6, 4], [4, 4]], float)]
    assert G.area(hole) == 96
    part = [np.array([[3, 3], [7, 3], [7, 7], [3, 7], [3, 3]], float)]
    assert G.overlap_area(hole, part) == pytest.approx(12)
    star = [np.array([[0, 0], [10, 5], [0, 10], [4, 5], [0, 0]], float)]
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 10, (40000, 2))
    inside = ((G.locate(p, star) > 0) & (G.locate(p, hole) > 0)).mean() * 100
    assert G.overlap_area(star, hole) == pytest.approx(inside, abs=1.0)
    assert G.overlap_area(hole, hole) == pytest.approx(96)
    assert G.union_area([part, part, hole]) == pytest.approx(100 - 4 + 4)


def test_raster_rules(spark):
    schema = "unit string, value double, valid boolean, overlap_m2 double, cell_area_m2 double, support_area_m2 double"
    df = spark.createDataFrame([("u", 100.0, True, 5000.0, 10000.0, 10000.0), ("u", None, False, 5000.0, 10000.0, 10000.0)], schema)
    r = spatial.raster_summary(df, "unit", True).first()
    assert (r["value"], r.mass, r.nodata_m2) == (None, 50.0, 5000.0)
    df = spark.createDataFrame([("u", 0.0, True, 100.0, 1e4, 400.0), ("u", 10.0, True, 300.0, 1e4, 400.0)], schema)
    r = spatial.raster_summary(df, "unit", False).first()
    assert (r["value"], r.valid_fraction) == (7.5, 1.0)
    with pytest.raises(Exception, match="raster cell"):
        spatial.raster_summary(spark.createDataFrame([("u", 1.0, True, -1.0, 1.0, 1.0)], schema), "unit", False).collect()


def test_entropy(spark):
    row = lambda *v: spark.range(1).select(S.normalized_entropy([F.lit(float(x)) for x in v], len(v))).first()[0]
    assert row(*[1] * 8) == pytest.approx(1) and row(5, 0, 0) == 0 and row(0, 0) is None
    with pytest.raises(Exception, match="negative"):
        row(-1, 2)


def test_similarity_invariants(spark):
    rows = [(1, 1.0, 1.0, 0.0), (2, 2.0, 0.5, 0.5), (3, 2.0, 0.0, 1.0), (4, 2.0, 0.3, 0.7), (5, 9.0, 0.7, 0.3)]
    wide = spark.createDataFrame(rows, "u long, x double, a double, b double")
    long = similarity.to_long(wide, "u", {"A": ["x"], "C": ["a", "b"]}, blocks={"C": "C"})
    pairs = similarity.calibrated(similarity.pair_table(long)).cache()
    d1 = {(r.i, r.j): (r.d, r.parts) for r in similarity.distances(pairs, {"A": 1.0, "C": 2.0}).collect()}
    d2 = {(r.i, r.j): r.d for r in similarity.distances(pairs, {"A": 2.0, "C": 4.0}).collect()}
    assert len(d1) == 10
    for k, (d, parts) in d1.items():
        assert d == pytest.approx(d2[k])
        assert d * d == pytest.approx(sum(parts.values()))
    full = {**{k: v[0] for k, v in d1.items()}, **{(j, i): v[0] for (i, j), v in d1.items()}}
    for i in range(1, 6):
        for j in range(1, 6):
            for k in range(1, 6):
                if len({i, j, k}) == 3:
                    assert full[i, j] <= full[i, k] + full[k, j] + 1e-9
    tied = similarity.neighbours(spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 3, 1.0)], "i long, j long, d double"), 1)
    assert (1, 2) in [(r.i, r.j) for r in tied.collect()]


def test_matrix_steps():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.1, (10, 3)), rng.normal(5, 0.1, (10, 3)), rng.normal([9, 0, 0], 0.1, (10, 3))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    k, labels = matrix.best_clusters(d)
    assert k == 3 and len({tuple(labels[s : s + 10].tolist()) for s in (0, 10, 20)}) == 3
    coords, share, negative = matrix.principal_coordinates(d, 1.0)
    back = np.sqrt(((coords[:, None] - coords[None]) ** 2).sum(axis=2))
    assert np.allclose(back, d, atol=1e-6) and share.sum() == pytest.approx(1) and negative < 1e-6
    assert (matrix.align_labels((labels + 1) % 3, labels) == labels).all()
    assert matrix.prune(["a", "b", "c"], np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])) in (["a", "c"], ["b", "c"])


def test_graph(spark):
    roads = spark.createDataFrame([("ab", [("a", 0.0), ("b", 1.0)], 8.0), ("bc", [("b", 0.0), ("c", 0.5), ("d", 1.0)], 4.0)], "id string, connectors array<struct<connector_id:string,at:double>>, m double")
    assert dict(one(graph.connector_arms(roads))) == {"a": 1, "b": 2, "c": 2, "d": 1}
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 8.0, 0.0), ("c", 9.0, 2.0), ("d", 90.0, 2.0)], "id string, x double, y double")
    assert sorted(r[:2] for r in one(graph.short_links(roads, nodes, "m"))) == [("a", "b"), ("b", "c")]
    links = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    chain = spark.createDataFrame([("a", 0.0, 0.0), ("b", 20.0, 0.0), ("c", 40.0, 0.0)], "id string, x double, y double")
    assert one(graph.linked_components(chain, links)) == [("a", 3, 40.0, True)]
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 5.0)], "a long, b long, w double")
    src = spark.createDataFrame([("g", "s", 1, 0.5)], "g string, source string, node long, start double")
    want = [(1, 0.5), (2, 1.5), (3, 2.5)]
    assert sorted((r.node, r.dist) for r in graph.bounded_paths(edges, src, "g", 4.0).collect()) == want
    assert sorted((r.node, r.dist) for r in graph.relaxed_paths(edges, src, "g", 4.0).collect()) == want


def test_tour_covers_and_closes():
    edges = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 0, 1.0), (0, 2, 1.5)]
    walk, total = graph.tour(edges, list(range(5)))
    assert walk[0] == walk[-1] and total == pytest.approx(5.5 + 1.5)
    steps = {frozenset(p) for p in zip(walk, walk[1:])}
    assert {frozenset(e[:2]) for e in edges} <= steps


def test_traces(spark):
    t = np.arange(0, 20, 0.01)
    acc = spark.createDataFrame([(1, float(a), 0.0, 0.0, 9.8 + 3 * math.sin(2 * math.pi * 2 * a)) for a in t], "session int, t double, x double, y double, z double")
    assert abs(trajectory.steps(acc).count() - 40) <= 2
    obs = spark.createDataFrame([(1, float(k), 5.0 if k != 3 else None, float(k)) for k in range(8)], "session int, t double, u double, v double")
    got = trajectory.rts_smooth(obs, 0.5, 0.5).orderBy("t").collect()
    assert all(abs(r.u - 5) < 1e-3 for r in got) and all(b.v >= a.v for a, b in zip(got, got[1:]))
    sig = spark.createDataFrame([(1, k / 10, math.sin(k / 7)) for k in range(300)], "session int, t double, v double")
    late = sig.withColumn("t", F.col("t") - 0.5)
    assert trajectory.best_lag(late, sig, "v", 1.0, 0.25).first().lag == 0.5


def test_asof_buckets_do_not_matter(spark):
    left = spark.createDataFrame([(1, float(t)) for t in (0, 5, 17, 99)], "k long, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 5.0, "b"), (1, 16.0, "c"), (2, 0.0, "z")], "k long, t double, v string")
    for bucket in (1.0, 7.0, 1000.0):
        assert sorted((r.t, r.v) for r in intervals.asof_join(left, right, ["k"], "t", ["v"], bucket).collect()) == [(0, None), (5, "b"), (17, "c"), (99, "c")]
        assert {r.t: r.v for r in intervals.asof_join(left, right, ["k"], "t", ["v"], bucket, strict=True).collect()}[5.0] == "a"


def test_relational_rules(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "k long, v long")
    with pytest.raises(Exception, match="not unique"):
        relational.checked_join(a, a, ["k"], validate="many_to_one").collect()
    assert {(r.k, r.v, r.n) for r in relational.only_match(a, ["k"], "v").collect()} == {(1, None, 2)}
    text = spark.createDataFrame([("São Paulo - Brás",)], "x string")
    assert tuple(text.select(X.norm(F.col("x")), X.name_key(F.col("x"))).first()) == ("SAO PAULO BRAS", "saopaulobras")


def test_union_area_of_boxes_and_slivers():
    import numpy as np

    from metrolith.functions import geometry as G

    rng = np.random.default_rng(1)
    for _ in range(300):
        boxes, grid = [], np.zeros((12, 12), bool)
        for _ in range(rng.integers(1, 5)):
            x, y = rng.integers(0, 6, 2)
            w, h = rng.integers(0, 5, 2)  # some have no width or no height
            boxes.append([G.parts(G.box(float(x), float(y), float(x + w), float(y + h)))[0]])
            grid[x : x + w, y : y + h] = True
        assert abs(G.union_area(boxes) - grid.sum()) < 1e-9
