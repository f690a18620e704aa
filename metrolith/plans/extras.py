"""Extensions beyond the inventory: grouping sets, approximate aggregates, event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import windows as W
from .registry import Tables, portable, query

portable("x_rollup", (), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
portable("x_cube", (), "SELECT c_mktsegment, c_nationkey % 3 AS g, count(*) AS n FROM {customer} GROUP BY CUBE (c_mktsegment, c_nationkey % 3)")
portable("x_intersect", (), "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
portable("x_except", (), "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}")


@query("x_approximate")
def _(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_quantity", 0.5, 10_000).alias("q50"))


@query("x_tumbling_windows", (), """
    SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def _(t: Tables):
    out = W.tumbling(t.events, "1 hour")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("x_gap_sessions", (), """
    WITH g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 4 HOUR > ts THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def _(t: Tables):
    out = W.gap_sessions(t.events, "4 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
