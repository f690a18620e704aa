"""Queries of readers and sinks: tables are written in a format and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as N
from ..functions.geometry import utm
from ..operators import spatial as S
from ..sources import readers as R
from ..sources import writers as W
from ..sources.paths import scratch
from .registry import Tables, query


@query("r001_delimited_strings", (1, 2, 4), "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS id, s_name, CASE WHEN s_suppkey % 9 <> 0 THEN s_acctbal END AS v, s_nationkey FROM supplier")
def _(t: Tables):
    path = scratch(t.spark, "csv")
    v = F.when(F.col("s_suppkey") % 9 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string"))
    rows = t.supplier.select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("id"), "s_name", v.alias("v"), "s_nationkey")
    rows.write.option("header", True).option("sep", ";").option("compression", "gzip").csv(path)
    return R.typed(R.strings(t.spark, path, ["id", "s_name", "v", "s_nationkey"], ";"), {"v": "double", "s_nationkey": "int"})


@query("r005_timetable", (5, 16, 81), """
    SELECT l_orderkey % 50 AS trip, count(*) AS n, CAST(max(l_linenumber * 3600) AS BIGINT) AS last FROM lineitem WHERE l_orderkey % 50 IN (SELECT o_orderkey % 50 FROM orders WHERE o_orderkey % 50 < 20) GROUP BY 1""")
def _(t: Tables):
    path = scratch(t.spark, "gtfs")
    clock = F.concat(F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(":00:00"))
    t.lineitem.select((F.col("l_orderkey") % 50).alias(" trip_id"), F.col("l_suppkey").alias("stop_id "), F.col("l_linenumber").alias("stop_sequence"), clock.alias("departure_time")).write.option("header", True).csv(f"{path}/stop_times.txt")
    st = R.timetable(t.spark, path, "stop_times")
    keep = t.orders.select((F.col("o_orderkey") % 50).cast("string").alias("trip_id")).where(F.col("trip_id").cast("int") < 20).distinct()
    assert R.timetable(t.spark, path, "frequencies") is None
    g = st.join(F.broadcast(keep), "trip_id", "left_semi").groupBy(F.col("trip_id").cast("long").alias("trip"))
    return g.agg(F.count("*").alias("n"), F.max(N.clock_seconds(F.col("departure_time"))).alias("last"))


@query("r006_geoparquet_bbox", (6, 8, 25), "SELECT c_custkey FROM customer WHERE c_custkey * 17 % 530 BETWEEN 100 AND 200 AND c_custkey * 29 % 530 BETWEEN 50 AND 300")
def _(t: Tables):
    path = scratch(t.spark, "geo")
    x, y = (F.col("c_custkey") * 17 % 530).cast("double"), (F.col("c_custkey") * 29 % 530).cast("double")
    rows = t.customer.select("c_custkey", F.struct(x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax")).alias("bbox"))
    W.parquet(rows.sortWithinPartitions("bbox.xmin"), path)
    return R.boxed(t.spark, path, 100, 50, 200, 300).select("c_custkey")


@query("r009_catalogue_pruning", (9,), """
    SELECT 'tile-' || n_nationkey AS href FROM nation WHERE n_nationkey % 5 <= 2.5 AND n_nationkey % 5 + 1 >= 1.5 AND n_nationkey // 5 <= 3.2 AND n_nationkey // 5 + 1 >= 1.5""")
def _(t: Tables):
    x, y = (F.col("n_nationkey") % 5).cast("double"), F.floor(F.col("n_nationkey") / 5).cast("double")
    items = t.nation.select(F.concat(F.lit("tile-"), F.col("n_nationkey").cast("string")).alias("href"), x.alias("west"), y.alias("south"), (x + 1).alias("east"), (y + 1).alias("north"))
    return t.spark.createDataFrame([(h,) for h in R.items_in_box(items, 1.5, 1.5, 2.5, 3.2)], "href string")


@query("r011_geojson", (11, 28, 110), "SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(4 AS DOUBLE) AS area FROM nation")
def _(t: Tables):
    path = scratch(t.spark, "geojson")
    ring = "concat('{\"type\":\"Polygon\",\"coordinates\":[[[', k, ',0],[', k + 2, ',0],[', k + 2, ',2],[', k, ',2],[', k, ',0]]]}')"
    rows = t.nation.selectExpr("CAST(n_nationkey AS STRING) AS id", "n_nationkey AS k").select("id", F.expr(ring).alias("g"))
    one = rows.select(F.concat(F.lit('{"type":"Feature","geometry":'), "g", F.lit(',"properties":{"id":"'), "id", F.lit('"}}')).alias("f")).agg(F.concat(F.lit('{"features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    one.write.text(path)  # a collection is one document
    g = R.geojson(t.spark, path)
    return g.select(F.col("properties")["id"].alias("id"), S.area_of("geometry").alias("area"))


@query("r017_placed_ways", (18,), "SELECT l_orderkey AS id, round(avg(l_suppkey * 0.5), 6) AS lat, round(avg(l_suppkey * 0.25), 6) AS lon FROM lineitem GROUP BY 1")
def _(t: Tables):
    nodes = t.supplier.selectExpr("s_suppkey AS id", "s_suppkey * 0.5D AS lat", "s_suppkey * 0.25D AS lon")
    ways = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_suppkey").alias("refs"))
    return R.placed_ways(nodes, ways).select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("r018_osm_segments", (18,), "SELECT k AS way, CAST(k AS BIGINT) AS a, CAST(k + 100 AS BIGINT) AS b FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation) UNION ALL SELECT k, k + 100, k + 200 FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation)")
def _(t: Tables):
    path = scratch(t.spark, "osm")
    k = F.col("n_nationkey").cast("long")
    e = F.struct(F.lit("way").alias("type"), k.alias("id"), F.array(k, k + 100, k + 200).alias("nodes"), F.create_map(F.lit("highway"), F.lit("service")).alias("tags"))
    t.nation.select(F.array(e).alias("elements")).write.json(path)
    one = t.spark.read.text(path).agg(F.concat(F.lit('{"elements":['), F.array_join(F.transform(F.collect_list("value"), lambda v: F.substr(v, F.lit(14), F.length(v) - 15)), ","), F.lit("]}")).alias("value"))
    one.write.text(f"{path}-doc")
    return R.osm_json(t.spark, f"{path}-doc")[1].select("way", "a", "b")


@query("r023_session_fixes", (23,), "SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6, 3) AS t FROM events")
def _(t: Tables):
    from ..operators.trajectory import fixes

    raw = t.events.select("event_id", F.col("ts").cast("timestamp").alias("timestamp"))
    return fixes(raw, F.lit("2024-01-01").cast("timestamp")).select("event_id", F.round("t", 3).alias("t"))


@query("r288_footprints", (288,), "SELECT CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS height, count(*) AS n FROM part GROUP BY 1")
def _(t: Tables):
    path = scratch(t.spark, "prints")
    h = F.when(F.col("p_size") % 4 == 0, -1.0).otherwise(F.col("p_size").cast("double"))
    g = F.lit('{"type":"Point","coordinates":[0,0]}')
    t.part.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.from_json(g, "type string, coordinates array<double>").alias("geometry"), F.struct(h.alias("height"), F.lit(-1.0).alias("confidence")).alias("properties"))).alias("value")).write.option("compression", "gzip").text(path)
    return R.footprints(t.spark, path).where("confidence is null").groupBy("height").agg(F.count("*").alias("n"))


@query("r030_validated_publish", (30,), "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1")
def _(t: Tables):
    rows = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return W.publish(rows, scratch(t.spark, "published"), {"has rows": F.count("*") > 0, "no null": F.count_if(F.col("n").isNull()) == 0})


@query("r031_fingerprint_stage", (31, 32, 34), "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(t: Tables):
    path, nation = scratch(t.spark, "stage"), t.nation
    signature = W.content_hash(nation)
    build = lambda: W.accepted(nation, signature).groupBy("n_regionkey").agg(F.count("*").alias("n"))
    W.stage(t.spark, path, signature, build)
    return W.stage(t.spark, path, signature, lambda: (_ for _ in ()).throw(AssertionError("rebuilt")))


@query("r135_reprojection", (135,), """
    WITH k AS (SELECT 1 / 298.257222101 AS f), n AS (SELECT f / (2 - f) AS n FROM k),
    s AS (SELECT n, 2 * sqrt(n) / (1 + n) AS c, 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS big, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3 FROM n),
    p AS (SELECT n_nationkey, radians(n_nationkey / 10 - 46.5 + 45) AS lam, sin(radians(-23.5 + n_regionkey / 10)) AS sp FROM nation),
    t AS (SELECT *, sinh(atanh(sp) - c * atanh(c * sp)) AS t FROM p, s),
    e AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
    SELECT n_nationkey, round(500000 + 0.9996 * big * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS x,
        round(0.9996 * big * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) + 1e7, 3) AS y FROM e""")
def _(t: Tables):
    @F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
    def project(lon: pd.Series, lat: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip("xy", utm(lon.to_numpy(), lat.to_numpy(), 23, True))))

    return t.nation.select("n_nationkey", project(F.col("n_nationkey") / 10 - 46.5, -23.5 + F.col("n_regionkey") / 10).alias("p")).select("n_nationkey", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))
