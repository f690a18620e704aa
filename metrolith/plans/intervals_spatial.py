"""Queries of time intervals and of spatial joins over boxes made from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import intervals as I
from ..operators import spatial as S
from ..operators import transit as T
from .registry import Tables, query

_SEC = "CAST(floor(epoch_us(ts) / 1e6) AS BIGINT)"


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"))


@query("r085_asof_join", (85,), f"""
    WITH e AS (SELECT *, {_SEC} AS sec FROM events), p AS (SELECT user_id, sec, max(value) AS price FROM e WHERE event_type = 'purchase' GROUP BY 1, 2)
    SELECT e.event_id, p.price FROM e ASOF LEFT JOIN p ON p.user_id = e.user_id AND p.sec <= e.sec WHERE e.event_type <> 'purchase'""")
def _(t: Tables):
    e = _events(t)
    p = e.where("event_type = 'purchase'").groupBy("user_id", "sec").agg(F.max("value").alias("price"))
    return I.asof_join(e.where("event_type <> 'purchase'"), p, ["user_id"], "sec", ["price"], 86400.0).select("event_id", "price")


_RUNS = f"(SELECT event_id AS run, user_id, {_SEC} AS start_s, {_SEC} + CAST(value * 40 AS BIGINT) AS end_s FROM events WHERE event_type = 'signup')"


def _runs(t: Tables) -> DataFrame:
    e = _events(t).where("event_type = 'signup'")
    return e.select(F.col("event_id").alias("run"), "user_id", F.col("sec").alias("start_s"), (F.col("sec") + F.round(F.col("value") * 40).cast("long")).alias("end_s"))


@query("r086_interval_join", (86, 265), f"""
    SELECT run, count(*) AS n, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS views FROM {_RUNS} r JOIN (SELECT *, {_SEC} AS sec FROM events) e
    ON e.user_id = r.user_id AND sec BETWEEN start_s AND end_s GROUP BY run""")
def _(t: Tables):
    j = I.interval_join(_events(t), _runs(t), ["user_id"], "sec", 7200)
    return j.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("views"))


@query("r087_interval_anti_join", (87,), f"""
    SELECT event_id FROM (SELECT *, {_SEC} AS sec FROM events) e WHERE NOT EXISTS (SELECT 1 FROM {_RUNS} r WHERE r.user_id = e.user_id AND sec >= start_s AND sec < end_s)""")
def _(t: Tables):
    return I.interval_join(_events(t), _runs(t), ["user_id"], "sec", 7200, "left_anti", "left").select("event_id")


@query("r088_overlap_length", (88,), f"""
    WITH r AS {_RUNS}, s AS (SELECT user_id, {_SEC} AS start_s, {_SEC} + 900 AS end_s FROM events WHERE event_type = 'error')
    SELECT run, CAST(end_s - start_s - coalesce((SELECT sum(greatest(least(r.end_s, s.end_s) - greatest(r.start_s, s.start_s), 0)) FROM s WHERE s.user_id = r.user_id), 0) AS DOUBLE) AS moving FROM r""")
def _(t: Tables):
    stops = _events(t).where("event_type = 'error'").select("user_id", F.col("sec").alias("start_s"), (F.col("sec") + 900).alias("end_s"))
    o = I.overlap_length(_runs(t), stops, ["user_id"], 7200)
    return o.select("run", (F.col("end_s") - F.col("start_s") - F.col("overlap")).cast("double").alias("moving"))


@query("r089_interpolation_join", (89,), f"""
    WITH e AS (SELECT *, {_SEC} AS sec FROM events), k AS (SELECT user_id, sec, min(value) AS v FROM e WHERE event_type = 'view' GROUP BY 1, 2), c AS (SELECT event_id, user_id, sec FROM e WHERE event_type = 'click'),
    a AS (SELECT c.*, k.sec AS t0, k.v AS v0 FROM c ASOF LEFT JOIN k ON k.user_id = c.user_id AND k.sec <= c.sec),
    b AS (SELECT a.*, k.sec AS t1, k.v AS v1 FROM a ASOF LEFT JOIN k ON k.user_id = a.user_id AND k.sec >= a.sec)
    SELECT event_id, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (sec - t0) / (t1 - t0) END, 5) AS v FROM b""")
def _(t: Tables):
    e = _events(t)
    track = e.where("event_type = 'view'").groupBy("user_id", "sec").agg(F.min("value").alias("v"))
    return I.interpolate(e.where("event_type = 'click'").select("event_id", "user_id", "sec"), track, ["user_id"], "sec", ["v"]).select("event_id", F.round("v", 5).alias("v"))


@query("r180_sessionization", (180, 184), f"""
    WITH e AS (SELECT user_id, event_id, {_SEC} AS sec FROM events), g AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) > 14400 THEN 1 ELSE 0 END AS new FROM e),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, min(sec) - 30 AS start_s, max(sec) + 30 AS end_s, count(*) AS n FROM s GROUP BY user_id, session HAVING count(*) >= 2""")
def _(t: Tables):
    return I.session_intervals(_events(t), ["user_id"], "sec", 14400, 2, 30).select("user_id", "session", F.col("start_s"), "end_s", "n")


@query("r181_runs_of_true", (181,), """
    WITH e AS (SELECT user_id, event_id, value > 30 AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e WHERE f)
    SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g GROUP BY user_id, k""")
def _(t: Tables):
    return I.runs_of(t.events, ["user_id"], "event_id", F.col("value") > 30)


@query("r182_coverage_gaps", (182,), f"""
    WITH r AS {_RUNS}, w AS (SELECT user_id, max(end_s) OVER (PARTITION BY user_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS top, lead(start_s) OVER (PARTITION BY user_id ORDER BY start_s, end_s) AS nxt FROM r)
    SELECT user_id, top AS gap_from, nxt AS gap_to FROM w WHERE nxt > top""")
def _(t: Tables):
    return I.coverage_gaps(_runs(t), ["user_id"], "start_s", "end_s")


@query("r183_state_around", (183,), """
    WITH e AS (SELECT event_id, user_id, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS s FROM events),
    w AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
        first_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM e)
    SELECT event_id, coalesce(b, a) AS state, coalesce(b <> a, false) AS conflict FROM w""")
def _(t: Tables):
    return I.state_around(t.events, ["user_id"], "event_id", F.when(F.col("event_type").isin("view", "click"), F.col("event_type"))).select("event_id", "state", "conflict")


@query("r246_active_services", (246,), """
    WITH cal(service_id, first, last, wednesday) AS (VALUES ('regular', '20260101', '20261231', '1'), ('weekend', '20260101', '20261231', '0')),
    exc(service_id, date, kind) AS (VALUES ('regular', '20260916', '2'), ('special', '20260916', '1'))
    SELECT service_id FROM cal WHERE wednesday = '1' AND '20260916' BETWEEN first AND last AND service_id NOT IN (SELECT service_id FROM exc WHERE date = '20260916' AND kind = '2')
    UNION SELECT service_id FROM exc WHERE date = '20260916' AND kind = '1'""")
def _(t: Tables):
    days = ", ".join(["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"])
    cal = t.spark.sql(f"SELECT * FROM VALUES ('regular', '20260101', '20261231', '1','1','1','1','1','0','0'), ('weekend', '20260101', '20261231', '0','0','0','0','0','1','1') AS c(service_id, start_date, end_date, {days})")
    exc = t.spark.sql("SELECT * FROM VALUES ('regular', '20260916', '2'), ('special', '20260916', '1') AS e(service_id, date, exception_type)")
    return T.active_services(cal, exc, "20260916")


@query("r247_window_departures", (247, 250), """
    WITH st AS (SELECT l_suppkey AS stop_id, l_returnflag AS route_id, l_linestatus AS direction_id, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS service_id, CAST(l_quantity * 2000 AS BIGINT) AS sec FROM lineitem),
    sv(service_id, back) AS (VALUES ('a', 0), ('b', 0), ('b', 1)), w(name, lo, hi) AS (VALUES ('am', 25200, 32400), ('night', 0, 7200))
    SELECT name, stop_id, route_id, direction_id, count(*) AS departures FROM st JOIN sv USING (service_id) JOIN w ON sec - 86400 * back >= lo AND sec - 86400 * back < hi GROUP BY ALL""")
def _(t: Tables):
    st = t.lineitem.selectExpr("l_suppkey AS stop_id", "l_returnflag AS route_id", "l_linestatus AS direction_id", "CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS service_id", "CAST(l_quantity * 2000 AS BIGINT) AS sec")
    sv = t.spark.sql("SELECT * FROM VALUES ('a', 0), ('b', 0), ('b', 1) AS s(service_id, back)")
    w = t.spark.sql("SELECT * FROM VALUES ('am', 25200, 32400), ('night', 0, 7200) AS w(name, lo, hi)")
    return T.window_departures(st, sv, w)


@query("r251_trip_stops", (251, 252), """
    SELECT l_suppkey AS stop_id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS modes FROM lineitem
    WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2) GROUP BY 1""")
def _(t: Tables):
    st = T.at_least_two_stops(t.lineitem.selectExpr("l_orderkey AS trip_id", "l_suppkey AS stop_id", "l_returnflag AS route_type"))
    return st.groupBy("stop_id").agg(F.array_join(F.array_sort(F.collect_set("route_type")), ",").alias("modes"))


def _grid(df: DataFrame, key: str, x: str, y: str, w: str, h: str) -> DataFrame:
    return df.select(key, *[F.expr(e).cast("double").alias(n) for n, e in (("x0", x), ("y0", y), ("x1", f"{x} + {w}"), ("y1", f"{y} + {h}"))])


def _boxes(df: DataFrame, key: str, x: str, y: str, w: str, h: str) -> DataFrame:
    return _grid(df, key, x, y, w, h).withColumn("geometry", S.box_of("x0", "y0", "x1", "y1"))


_DISTRICTS = "(SELECT n_nationkey AS unit, (n_nationkey % 5) * 100.0 AS x0, (n_nationkey // 5) * 100.0 AS y0, (n_nationkey % 5) * 100.0 + 100 AS x1, (n_nationkey // 5) * 100.0 + 100 AS y1 FROM nation)"
_BLOCKS = "(SELECT s_suppkey AS block, s_acctbal AS mass, CAST(s_suppkey * 37 % 470 AS DOUBLE) AS x0, CAST(s_suppkey * 53 % 470 AS DOUBLE) AS y0, CAST(s_suppkey * 37 % 470 + 20 + s_suppkey % 30 AS DOUBLE) AS x1, CAST(s_suppkey * 53 % 470 + 10 + s_suppkey % 40 AS DOUBLE) AS y1 FROM supplier)"
_AREA = "greatest(least(b.x1, d.x1) - greatest(b.x0, d.x0), 0) * greatest(least(b.y1, d.y1) - greatest(b.y0, d.y0), 0)"


def _districts(t: Tables) -> DataFrame:
    return _boxes(t.nation.select(F.col("n_nationkey").alias("unit")), "unit", "(unit % 5) * 100", "(unit div 5) * 100", "100", "100")


def _blocks(t: Tables) -> DataFrame:
    s = t.supplier.select(F.col("s_suppkey").alias("block"), F.col("s_acctbal").alias("mass"))
    return _boxes(s, "block", "block * 37 % 470", "block * 53 % 470", "20 + block % 30", "10 + block % 40").join(s, "block")


_POINTS = "(SELECT c_custkey, c_acctbal, CAST(c_custkey * 17 % 530 AS DOUBLE) + 0.5 AS x, CAST(c_custkey * 29 % 530 AS DOUBLE) + 0.5 AS y FROM customer)"


def _points(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_custkey", "c_acctbal", "CAST(c_custkey * 17 % 530 AS DOUBLE) + 0.5 AS x", "CAST(c_custkey * 29 % 530 AS DOUBLE) + 0.5 AS y")


@query("r091_point_in_polygon", (91, 92, 93), f"SELECT c_custkey, (SELECT min(unit) FROM {_DISTRICTS} d WHERE p.x BETWEEN d.x0 AND d.x1 AND p.y BETWEEN d.y0 AND d.y1) AS unit FROM {_POINTS} p")
def _(t: Tables):
    return S.assign_points(_points(t), "c_custkey", _districts(t), "unit", 100.0).select("c_custkey", "unit")


@query("r094_nearest_fallback", (94, 95), f"""
    SELECT c_custkey, arg_min(unit, struct_pack(d := d, u := unit)) FILTER (WHERE d <= 25) AS unit FROM (
        SELECT c_custkey, unit, sqrt(power(greatest(d.x0 - p.x, 0, p.x - d.x1), 2) + power(greatest(d.y0 - p.y, 0, p.y - d.y1), 2)) AS d FROM {_POINTS} p, {_DISTRICTS} d) GROUP BY 1""")
def _(t: Tables):
    return S.assign_points(_points(t), "c_custkey", _districts(t), "unit", 100.0, 25.0).select("c_custkey", "unit")


_STOPS = "(SELECT s_suppkey, s_nationkey, CAST(s_suppkey * 31 % 530 AS DOUBLE) AS x2, CAST(s_suppkey * 41 % 530 AS DOUBLE) AS y2 FROM supplier)"


def _stops(t: Tables) -> DataFrame:
    return t.supplier.selectExpr("s_suppkey", "s_nationkey", "CAST(s_suppkey * 31 % 530 AS DOUBLE) AS x2", "CAST(s_suppkey * 41 % 530 AS DOUBLE) AS y2")


@query("r096_distance_within", (96, 97, 98), f"""
    SELECT c_custkey, bool_or(d <= 10) AS any_10, bool_or(d <= 20) AS any_20, bool_or(d <= 10 AND m) AS named_10, bool_or(d <= 20 AND m) AS named_20 FROM (
        SELECT c_custkey, sqrt(power(x - x2, 2) + power(y - y2, 2)) AS d, s_nationkey % 5 = c_custkey % 5 AS m FROM {_POINTS} p, {_STOPS} s) WHERE d <= 20 GROUP BY 1""")
def _(t: Tables):
    near = S.within(_points(t), _stops(t), 20.0)
    return S.match_at_radii(near, "c_custkey", F.col("s_nationkey") % 5 == F.col("c_custkey") % 5, [10, 20])


@query("r239_supply_within", (239, 140, 141), f"""
    WITH near AS (SELECT c_custkey AS point_id, s_suppkey AS stop_id, sqrt(power(x - x2, 2) + power(y - y2, 2)) AS dist FROM {_POINTS} p, {_STOPS} s),
    sv AS (SELECT l_suppkey AS stop_id, l_returnflag AS route_id, l_linestatus AS direction_id, count(*) AS departures FROM lineitem GROUP BY 1, 2, 3),
    b AS (SELECT point_id, route_id, direction_id, max(CASE WHEN dist <= 15 THEN departures END) AS r15, max(departures) AS r30 FROM near JOIN sv USING (stop_id) WHERE dist <= 30 GROUP BY 1, 2, 3)
    SELECT point_id, CAST(coalesce(sum(r15), 0) AS BIGINT) AS supply_15, CAST(coalesce(sum(r30), 0) AS BIGINT) AS supply_30 FROM b GROUP BY 1""")
def _(t: Tables):
    near = S.within(_points(t), _stops(t), 30.0).select(F.col("c_custkey").alias("point_id"), F.col("s_suppkey").alias("stop_id"), "dist")
    sv = t.lineitem.groupBy(F.col("l_suppkey").alias("stop_id"), F.col("l_returnflag").alias("route_id"), F.col("l_linestatus").alias("direction_id")).agg(F.count("*").alias("departures"))
    return T.supply(near, sv, [15, 30])


@query("r099_largest_overlap", (99, 100, 101), f"""
    WITH o AS (SELECT block, unit, {_AREA} AS inside, (b.x1 - b.x0) * (b.y1 - b.y0) AS whole FROM {_BLOCKS} b, {_DISTRICTS} d),
    k AS (SELECT *, max(inside) OVER (PARTITION BY block) AS top, count(*) OVER (PARTITION BY block) AS candidates FROM o WHERE inside > 0)
    SELECT block, min(unit) AS unit, round(max(inside), 4) AS inside, candidates, count(*) > 1 AS tied FROM k WHERE inside >= top - 1e-8 GROUP BY block, candidates""")
def _(t: Tables):
    return S.largest_overlap(_blocks(t), "block", _districts(t), "unit", 100.0, 1e-8).select("block", "unit", F.round("inside", 4).alias("inside"), "candidates", "tied")


@query("r102_area_allocation", (102, 103, 105, 139), f"""
    WITH o AS (SELECT unit, mass * {_AREA} / ((b.x1 - b.x0) * (b.y1 - b.y0)) AS m FROM {_BLOCKS} b, {_DISTRICTS} d) SELECT unit, round(sum(m), 3) AS mass FROM o WHERE m <> 0 GROUP BY unit""")
def _(t: Tables):
    return S.allocate(_blocks(t), "block", _districts(t), "unit", ["mass"], 100.0).groupBy("unit").agg(F.round(F.sum("mass"), 3).alias("mass"))


def _cells_sql(source: str) -> str:
    """SQL for g(unit, a, cell, ...): the cells that the edges of the boxes in ``source`` cut
    each unit into, joined with the boxes that cover them."""
    return f"""
    xs AS (SELECT unit, x0 AS x FROM {source} UNION SELECT unit, x1 FROM {source}), xr AS (SELECT unit, x, lead(x) OVER (PARTITION BY unit ORDER BY x) AS x2 FROM xs),
    ys AS (SELECT unit, y0 AS y FROM {source} UNION SELECT unit, y1 FROM {source}), yr AS (SELECT unit, y, lead(y) OVER (PARTITION BY unit ORDER BY y) AS y2 FROM ys),
    g AS (SELECT b.*, x, y, (x2 - x) * (y2 - y) AS a FROM xr JOIN yr ON xr.unit = yr.unit JOIN {source} b ON b.unit = xr.unit AND b.x0 <= x AND b.x1 >= x2 AND b.y0 <= y AND b.y1 >= y2)"""


@query("r111_union_coverage", (111,), f"""
    WITH c AS (SELECT unit, greatest(b.x0, d.x0) AS x0, greatest(b.y0, d.y0) AS y0, least(b.x1, d.x1) AS x1, least(b.y1, d.y1) AS y1 FROM {_BLOCKS} b, {_DISTRICTS} d WHERE {_AREA} > 0), {_cells_sql("c")},
    w AS (SELECT unit, sum(a) AS covered FROM (SELECT DISTINCT unit, x, y, a FROM g) GROUP BY unit), s AS (SELECT unit, sum((x1 - x0) * (y1 - y0)) AS summed FROM c GROUP BY unit)
    SELECT unit, round(covered, 3) AS covered_m2, round(summed, 3) AS summed_m2 FROM w JOIN s USING (unit)""")
def _(t: Tables):
    u = S.union_coverage(_blocks(t), _districts(t), "unit", 50.0)
    return u.where("covered_m2 > 0").select("unit", F.round("covered_m2", 3).alias("covered_m2"), F.round("summed_m2", 3).alias("summed_m2"))


_LAND = "(SELECT n_nationkey AS unit, n_nationkey % 5 * 100.0 AS x0, n_nationkey // 5 * 100.0 + 20 AS y0, n_nationkey % 5 * 100.0 + 70 AS x1, n_nationkey // 5 * 100.0 + 100 AS y1 FROM nation)"


@query("r111_coverage_on_land", (111, 129), f"""
    WITH c AS (SELECT d.unit, greatest(b.x0, d.x0) AS x0, greatest(b.y0, d.y0) AS y0, least(b.x1, d.x1) AS x1, least(b.y1, d.y1) AS y1 FROM {_BLOCKS} b, {_LAND} d WHERE {_AREA} > 0), {_cells_sql("c")}
    SELECT unit, round(sum(a), 3) AS on_land_m2 FROM (SELECT DISTINCT unit, x, y, a FROM g) GROUP BY unit""")
def _(t: Tables):
    """What buildings cover of each district's land, its area less its water."""
    land = _boxes(t.nation.select(F.col("n_nationkey").alias("unit")), "unit", "(unit % 5) * 100", "(unit div 5) * 100 + 20", "70", "80")
    u = S.union_coverage(_blocks(t), _districts(t), "unit", 50.0, land)
    return u.select("unit", F.round("on_land_m2", 3).alias("on_land_m2")).where("on_land_m2 > 0")


@query("r112_clip_length", (112, 114), f"""
    SELECT unit, round(sum(greatest(least(b.x1, d.x1) - greatest(b.x0, d.x0), 0)), 3) AS length_m FROM {_BLOCKS} b, {_DISTRICTS} d
    WHERE b.y0 + 0.25 BETWEEN d.y0 AND d.y1 AND least(b.x1, d.x1) > greatest(b.x0, d.x0) GROUP BY unit""")
def _(t: Tables):
    @F.pandas_udf("binary")
    def line(x0, x1, y):
        return x0.combine(x1, lambda a, b: (a, b)).combine(y, lambda ab, v: G.line_wkb([[ab[0], v], [ab[1], v]]))

    lines = _blocks(t).select("block", line("x0", "x1", F.col("y0") + 0.25).alias("geometry"))
    return S.clip_lengths(lines, ["block"], _districts(t), "unit", 100.0).groupBy("unit").agg(F.round(F.sum("length_m"), 3).alias("length_m"))


@query("r117_shape_metrics", (117, 118), f"""
    SELECT block, round((x1 - x0) * (y1 - y0), 4) AS area, round(4 * pi() * (x1 - x0) * (y1 - y0) / power(2 * (x1 - x0 + y1 - y0), 2), 6) AS compactness,
        round(greatest(x1 - x0, y1 - y0) / least(x1 - x0, y1 - y0), 6) AS elongation FROM {_BLOCKS}""")
def _(t: Tables):
    s = _blocks(t).select("block", S.shape_of("geometry").alias("s"))
    return s.select("block", F.round("s.area", 4).alias("area"), F.round("s.compactness", 6).alias("compactness"), F.round("s.elongation", 6).alias("elongation"))


@query("r130_population_grid", (130,), f"""
    SELECT block, round(sum(mass * greatest(least(b.x1, cx * 25 + 25) - greatest(b.x0, cx * 25), 0) * greatest(least(b.y1, cy * 25 + 25) - greatest(b.y0, cy * 25), 0) / ((b.x1 - b.x0) * (b.y1 - b.y0))), 3) AS weight,
        count(*) FILTER (WHERE least(b.x1, cx * 25 + 25) > greatest(b.x0, cx * 25) AND least(b.y1, cy * 25 + 25) > greatest(b.y0, cy * 25)) AS n
    FROM {_BLOCKS} b, range(0, 30) AS r(cx), range(0, 30) AS q(cy) GROUP BY block""")
def _(t: Tables):
    g = S.grid_population(_blocks(t), "block", "mass", 25.0)
    return g.groupBy("block").agg(F.round(F.sum("weight"), 3).alias("weight"), F.count("*").alias("n"))


@query("r132_raster_summary", (132,), """
    WITH c AS (SELECT l_suppkey AS unit, l_quantity AS v, l_returnflag <> 'N' AS ok, CAST(100.0 * l_linenumber AS DOUBLE) AS o FROM lineitem)
    SELECT unit, round(sum(CASE WHEN ok THEN v * o END) / sum(CASE WHEN ok THEN o END), 6) AS value, round(sum(CASE WHEN ok THEN v * o / 10000 END), 4) AS mass, sum(CASE WHEN NOT ok THEN o ELSE 0 END) AS nodata_m2 FROM c GROUP BY unit""")
def _(t: Tables):
    c = t.lineitem.select(F.col("l_suppkey").alias("unit"), F.col("l_quantity").alias("value"), (F.col("l_returnflag") != "N").alias("valid"), (F.lit(100.0) * F.col("l_linenumber")).alias("overlap_m2"), F.lit(10000.0).alias("cell_area_m2"), F.lit(1e12).alias("support_area_m2"))
    return S.raster_summary(c, "unit", False).select("unit", F.round("value", 6).alias("value"), F.round("mass", 4).alias("mass"), "nodata_m2")


@query("r106_exclusive_areas", (106, 110), f"""
    WITH b AS (SELECT block % 7 AS unit, block % 2 = 0 AS even, x0, y0, x1, y1 FROM {_BLOCKS}), {_cells_sql("b")},
    c AS (SELECT unit, a, bool_or(even) AS e, bool_or(NOT even) AS o FROM g GROUP BY unit, x, y, a)
    SELECT k.unit, CASE WHEN even THEN 'even' ELSE 'odd' END AS category, round(coalesce(sum(a) FILTER (WHERE e <> o AND e = even), 0), 3) AS area FROM (SELECT DISTINCT unit, even FROM b) k JOIN c USING (unit) GROUP BY k.unit, even
    UNION ALL SELECT unit, '(contested)', round(coalesce(sum(a) FILTER (WHERE e AND o), 0), 3) FROM c GROUP BY unit""")
def _(t: Tables):
    b = _blocks(t).withColumn("category", F.when(F.col("block") % 2 == 0, "even").otherwise("odd")).withColumn("unit", F.col("block") % 7)
    return S.exclusive_category_areas(b.select("unit", "category", "geometry"), "unit", "category", tile=50.0).withColumn("area", F.round("area", 3) + 0.0)
