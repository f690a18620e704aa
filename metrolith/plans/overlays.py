"""Queries of further geometry operators and of driver-side steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import matrix as M
from ..operators import overlays as O
from ..operators import spatial as S
from .intervals_spatial import _AREA, _BLOCKS, _DISTRICTS, _POINTS, _blocks, _districts, _points
from .registry import Tables, portable, query
from .similarity import BUDGETS, compare_sql, pairs


@query("r108_block_partition", (108, 275), f"""
    WITH o AS (SELECT block, CAST(unit AS VARCHAR) AS unit, {_AREA} AS a, (b.x1 - b.x0) * (b.y1 - b.y0) AS w FROM {_BLOCKS} b, {_DISTRICTS} d)
    SELECT block, unit, round(a, 3) AS area FROM o WHERE a > 0 UNION ALL SELECT block, 'OUTSIDE', round(max(w) - sum(a), 3) + 0.0 FROM o GROUP BY block HAVING sum(a) > 0""")
def _(t: Tables):
    p = S.candidates(_blocks(t).select("block", "geometry"), _districts(t).select("unit", "geometry"), 100.0)
    p = p.where(S.overlap_of("geometry", "geometry_r") > 0).select("block", "unit", F.col("geometry").alias("block_geometry"), F.col("geometry_r").alias("geometry"))
    return O.partition_block(p, "block", "unit").select("block", "unit", (F.round("area", 3) + 0.0).alias("area"))


@query("r119_road_intervals", (119,), """
    WITH r AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k FROM orders)
    SELECT id, 0.0::DOUBLE AS a, 0.25::DOUBLE AS b FROM r WHERE k <> 3 UNION ALL SELECT id, 0.25, 0.5 FROM r WHERE k NOT IN (1, 3) UNION ALL SELECT id, 0.5, 1.0 FROM r WHERE k <> 3""")
def _(t: Tables):
    k = F.col("o_orderkey") % 4
    rule = lambda v, between: F.struct(v.alias("value"), between.alias("between"))
    rules = F.array(rule(F.when(k == 1, "link").otherwise("ok"), F.array(F.lit(0.25), F.lit(0.5))), rule(F.when(k == 3, "link").otherwise("ok"), F.lit(None).cast("array<double>")))
    roads = t.orders.select(F.col("o_orderkey").alias("id"), rules.alias("rules"))
    return O.road_parts(roads, "id", F.col("rule.value") == "link", "rules")


@query("r120_near_fraction", (120,), f"""
    WITH p AS (SELECT block, x0 + 60 * (i + 0.5) / 4 AS x, y0 + 10 * (i + 0.5) / 4 AS y FROM {_BLOCKS}, range(0, 4) AS r(i)),
    e AS (SELECT block, p.x, p.y, CASE WHEN p.x BETWEEN d.x0 AND d.x1 AND p.y BETWEEN d.y0 AND d.y1 THEN least(p.x - d.x0, d.x1 - p.x, p.y - d.y0, d.y1 - p.y)
        ELSE sqrt(power(greatest(d.x0 - p.x, 0, p.x - d.x1), 2) + power(greatest(d.y0 - p.y, 0, p.y - d.y1), 2)) END AS d FROM p, {_DISTRICTS} d),
    n AS (SELECT block, x, y, min(d) AS d FROM e GROUP BY 1, 2, 3)
    SELECT block, avg(CASE WHEN d <= 5 THEN 1.0 ELSE 0 END) AS near_5, avg(CASE WHEN d <= 15 THEN 1.0 ELSE 0 END) AS near_15, avg(CASE WHEN d <= 30 THEN 1.0 ELSE 0 END) AS near_30 FROM n GROUP BY block""")
def _(t: Tables):
    from pyspark.sql import types as T

    @F.pandas_udf(T.BinaryType())
    def line(x, y):
        return x.combine(y, lambda a, b: G.line_wkb([[a, b], [a + 60, b + 10]]))

    lines = _blocks(t).select("block", line("x0", "y0").alias("geometry"))
    n = S.near_fraction(lines, "block", _districts(t), 20.0, [5.0, 15.0, 30.0])
    return n.select("block", *[F.round(c, 9).alias(c) for c in ("near_5", "near_15", "near_30")])


@query("r124_best_match", (124,), f"""
    WITH o AS (SELECT block, unit, {_AREA} AS i, (b.x1 - b.x0) * (b.y1 - b.y0) AS w FROM {_BLOCKS} b, {_DISTRICTS} d), u AS (SELECT block, unit, i / (w + 10000 - i) AS iou FROM o WHERE i > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY iou DESC, unit) AS n FROM u) SELECT b.block, k.unit, round(coalesce(iou, 0), 6) AS iou FROM {_BLOCKS} b LEFT JOIN k ON k.block = b.block AND n = 1""")
def _(t: Tables):
    return O.best_match(_blocks(t), "block", _districts(t), "unit", 100.0).select("block", "unit", F.round("iou", 6).alias("iou"))


@query("r271_capped_overlap", (271,), f"SELECT block, round(least(coalesce(sum({_AREA}), 0), max((b.x1 - b.x0) * (b.y1 - b.y0))), 3) AS overlap FROM {_BLOCKS} b, {_DISTRICTS} d GROUP BY block")
def _(t: Tables):
    return O.capped_overlap(_blocks(t), "block", _districts(t), 100.0).select("block", F.round("overlap", 3).alias("overlap"))


@query("r123_crossings", (123,), f"""
    WITH s AS (SELECT block, x0 AS px, y0 AS py, 60.0 AS rx, CASE WHEN CAST(x0 AS BIGINT) % 2 = 1 THEN 30.0 ELSE -30.0 END AS ry FROM {_BLOCKS}),
    p AS (SELECT a.block AS i, b.block AS j, a.px, a.py, a.rx, a.ry, b.px AS qx, b.py AS qy, b.rx AS sx, b.ry AS sy, ((b.px - a.px) * b.ry - (b.py - a.py) * b.rx) / (a.rx * b.ry - a.ry * b.rx) AS t,
        ((b.px - a.px) * a.ry - (b.py - a.py) * a.rx) / (a.rx * b.ry - a.ry * b.rx) AS u FROM s a JOIN s b ON a.block < b.block AND a.rx * b.ry <> a.ry * b.rx),
    q AS (SELECT *, px + t * rx AS x, py + t * ry AS y FROM p WHERE t BETWEEN -1e-9 AND 1 + 1e-9 AND u BETWEEN -1e-9 AND 1 + 1e-9),
    e AS (SELECT x, y, i AS line, CASE WHEN least(t, 1 - t) * sqrt(rx * rx + ry * ry) < 1e-6 THEN 1 ELSE 2 END AS n FROM q UNION ALL SELECT x, y, j, CASE WHEN least(u, 1 - u) * sqrt(sx * sx + sy * sy) < 1e-6 THEN 1 ELSE 2 END FROM q),
    l AS (SELECT round(x, 6) AS x, round(y, 6) AS y, line, max(n) AS n FROM e GROUP BY 1, 2, 3)
    SELECT x, y, count(*) AS lines, CAST(sum(n) AS BIGINT) AS arms FROM l GROUP BY x, y""")
def _(t: Tables):
    from pyspark.sql import types as T

    @F.pandas_udf(T.BinaryType())
    def line(x, y):
        return x.combine(y, lambda a, b: G.line_wkb([[a, b], [a + 60, b + (30 if int(a) % 2 else -30)]]))

    return O.crossings(_blocks(t).select("block", line("x0", "y0").alias("geometry")), "block", 60.0).withColumns({"x": F.round("x", 6) + 0.0, "y": F.round("y", 6) + 0.0})


@query("r125_overlapping_pieces", (125,), f"""
    SELECT a.block AS a, b.block AS b FROM {_BLOCKS} a JOIN {_BLOCKS} b ON a.block < b.block WHERE greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)
        >= 0.25 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))""")
def _(t: Tables):
    return O.overlapping_pairs(_blocks(t), "block", 60.0, 0.25)


@query("r285_heights_above_ground", (286,), f"""
    WITH p AS (SELECT c_custkey, floor(x / 50) AS cx, floor(y / 50) AS cy, c_acctbal AS z, c_custkey % 3 AS class FROM {_POINTS}), g AS (SELECT cx, cy, avg(z) AS g FROM p WHERE class = 2 GROUP BY 1, 2)
    SELECT c_custkey, round(z - g, 4) AS height FROM p LEFT JOIN g USING (cx, cy) WHERE class <> 2""")
def _(t: Tables):
    p = _points(t).select("c_custkey", "x", "y", F.col("c_acctbal").alias("z"), (F.col("c_custkey") % 3).alias("class"))
    return O.heights_above_ground(p, 50.0).select("c_custkey", F.round("height", 4).alias("height"))


@query("r286_cell_heights", (286,), f"""
    SELECT unit, round(sum(mass * a) / sum(a), 4) AS height, count(*) AS n FROM (SELECT unit, mass, {_AREA} AS a FROM {_BLOCKS} b, {_DISTRICTS} d) WHERE a > 0 GROUP BY unit""")
def _(t: Tables):
    return O.cell_heights(_blocks(t), _districts(t), "unit", "mass", 100.0).select("unit", F.round("height", 4).alias("height"), "n")


_STREETS = "(SELECT s_suppkey AS street, CAST(s_suppkey * 31 % 530 AS DOUBLE) AS x1, CAST(s_suppkey * 41 % 530 AS DOUBLE) AS y1 FROM supplier)"


def _streets(t: Tables):
    return t.supplier.selectExpr("s_suppkey AS street", "CAST(s_suppkey * 31 % 530 AS DOUBLE) AS x1", "CAST(s_suppkey * 41 % 530 AS DOUBLE) AS y1").withColumns({"x2": F.col("x1") + 40, "y2": F.col("y1") + 12})


@query("r245_nearest_street", (245,), f"""
    WITH p AS (SELECT c_custkey, street, x - x1 AS wx, y - y1 AS wy, greatest(least(((x - x1) * 40.0 + (y - y1) * 12.0) / (40.0 * 40.0 + 12.0 * 12.0), 1), 0) AS t FROM {_POINTS}, {_STREETS}),
    d AS (SELECT c_custkey, street, sqrt(power(wx - t * 40.0, 2) + power(wy - t * 12.0, 2)) AS dist, CAST(sign(wx * 12.0 - wy * 40.0) AS DOUBLE) AS side FROM p),
    k AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(dist, 6), street) AS n FROM d WHERE dist <= 30)
    SELECT c_custkey, street, round(dist, 6) AS dist, side FROM k WHERE n = 1""")
def _(t: Tables):
    p = _points(t).withColumn("bearing_deg", F.lit(70.0))
    return O.nearest_street(p, "c_custkey", _streets(t), "street", digits=6).select("c_custkey", "street", F.round("dist", 6).alias("dist"), "side")


@query("r202_displaced_baseline", (202,))
def _(t: Tables):
    p = O.displaced(_points(t), "c_custkey", 5.0).withColumn("bearing_deg", F.lit(70.0))
    return O.nearest_street(p, "c_custkey", _streets(t), "street")


@query("r104_land_cascade", (104,), """
    WITH g AS (SELECT c_nationkey AS "group", c_custkey AS block, c_custkey % 7 + 1 AS pop FROM customer), s AS (SELECT *, pop / sum(pop) OVER (PARTITION BY "group") AS sh FROM g)
    SELECT block % 4 AS unit, round(sum(n * sh * 0.5), 5) AS n FROM s JOIN (SELECT s_nationkey AS "group", count(*) AS n FROM supplier GROUP BY 1) USING ("group") GROUP BY 1""")
def _(t: Tables):
    people = t.supplier.groupBy(F.col("s_nationkey").alias("group")).agg(F.count("*").alias("n"))
    groups = t.customer.select(F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("block"), (F.col("c_custkey") % 7 + 1).alias("pop"))
    pieces = t.customer.select(F.col("c_custkey").alias("block"), (F.col("c_custkey") % 4).alias("unit"), F.lit(0.5).alias("land_share"))
    return O.cascade(people, groups, pieces, "n").select("unit", F.round("n", 5).alias("n"))


@query("r228_boundary_invariance", (228,), """
    WITH p AS (SELECT c_nationkey % 5 AS g, sum(c_acctbal) AS a, CAST(count(*) AS DOUBLE) AS b FROM customer GROUP BY c_nationkey)
    SELECT g, round(sum(a) / sum(b), 6) AS ratio, sum(a) / sum(b) BETWEEN min(a / b) - 1e-12 AND max(a / b) + 1e-12 AS pass FROM p GROUP BY g""")
def _(t: Tables):
    p = t.customer.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("a"), F.count("*").cast("double").alias("b")).withColumn("g", F.col("c_nationkey") % 5)
    return O.merged_within_range(p, "g", "a", "b").select("g", F.round("ratio", 6).alias("ratio"), "pass")


portable("r197_ordered_pairs", (197,), "SELECT a.n_nationkey AS i, b.n_nationkey AS j, abs(a.n_regionkey - b.n_regionkey) AS d FROM {nation} AS a JOIN {nation} AS b ON a.n_nationkey <> b.n_nationkey")


@query("r127_density_valley", (127, 200, 280, 121))
def _(t: Tables):
    v = np.array([r[0] for r in t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_nationkey").agg(F.avg("s_acctbal")).orderBy("n_nationkey").collect()])
    both = np.concatenate([v / v.max(), v / v.max() + 6])
    lo, hi = M.bootstrap_interval(v, v[::-1])
    ring = [np.array([[0, 0], [4, 0], [0, 4], [0, 0]], float)]
    inside = G.locate(O.random_points(ring, 20, 3), ring) > 0
    return t.spark.createDataFrame([("valley", M.density_valley(both)), ("rho_lo", lo), ("rho_hi", hi), ("inside", float(inside.mean())), ("hausdorff", O.hausdorff(ring[0][:2], ring[0][:2] + 1))], "name string, value double")


@query("r222_scenarios", (222,), " UNION ALL ".join(
    f"SELECT '{name}' AS scenario, * FROM ({compare_sql(budgets, BUDGETS)}) AS c{k}"
    for k, (name, budgets) in enumerate({"equal": {f: 1 / 3 for f in BUDGETS}, **{f"without {f}": {x: (0.0 if x == f else b) for x, b in BUDGETS.items()} for f in BUDGETS}}.items())))
def _(t: Tables):
    from ..operators import similarity as L

    p = pairs(t).persist()  # read once per scenario; one row per pair of units and block
    base = L.distances(p, BUDGETS)
    out = None
    scenarios = {"equal": {k: 1 / 3 for k in BUDGETS}, **{f"without {k}": {f: (0.0 if f == k else b) for f, b in BUDGETS.items()} for k in BUDGETS}}
    for name, budgets in scenarios.items():
        row = L.compare(L.distances(p, budgets), base).select(F.lit(name).alias("scenario"), F.round("rho", 6).alias("rho"), F.round("overlap", 6).alias("overlap"))
        out = row if out is None else out.unionByName(row)
    return out
