"""Queries of filters, joins, set operations, windows and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import Tables, portable, query

portable("r066_class_filter", (66, 67), """
    SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem}
    WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F' AND l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.06""")


@query("r068_check_ledger", (68, 73), """
    SELECT 'prices are positive' AS name, bool_and(o_totalprice > 0) AS pass, NULL AS detail FROM orders
    UNION ALL SELECT 'status is known', bool_and(o_orderstatus IN ('O', 'F', 'P')), CAST(count(DISTINCT o_orderstatus) AS VARCHAR) FROM orders
    UNION ALL SELECT 'all are urgent', bool_and(o_orderpriority = '1-URGENT'), NULL FROM orders
    UNION ALL SELECT 'wider holds narrower', bool_and(o_totalprice >= o_totalprice / 2), NULL FROM orders""")
def _(t: Tables):
    p = F.col("o_totalprice")
    return R.ledger(
        t.orders,
        {
            "prices are positive": F.bool_and(p > 0),
            "status is known": F.bool_and(F.col("o_orderstatus").isin("O", "F", "P")),
            "all are urgent": F.bool_and(F.col("o_orderpriority") == "1-URGENT"),
            "wider holds narrower": F.bool_and(p >= p / 2),
        },
        {"status is known": F.count_distinct("o_orderstatus")},
    )


_TIMES = """
    SELECT l_orderkey AS trip_id, l_suppkey AS stop_id, l_linenumber AS stop_sequence, CASE WHEN l_quantity = 13 THEN NULL ELSE CAST(l_quantity * 60 + l_linenumber * 600 AS BIGINT) END AS sec
    FROM lineitem"""


@query("r069_integrity_rejection", (69, 171), f"""
    WITH st AS ({_TIMES}), tr AS (SELECT o_orderkey AS trip_id, o_custkey AS route_id, o_orderstatus AS service_id FROM orders),
    l AS (SELECT *, lag(sec) OVER w AS before, lag(stop_sequence) OVER w AS same FROM st WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence, sec NULLS FIRST, stop_id))
    SELECT DISTINCT trip_id, 'unknown route' AS reason FROM tr WHERE route_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)
    UNION ALL SELECT DISTINCT trip_id, 'unknown service' FROM tr WHERE service_id NOT IN ('O', 'F')
    UNION ALL SELECT DISTINCT trip_id, 'unknown stop' FROM st WHERE stop_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey > 4)
    UNION ALL SELECT DISTINCT trip_id, 'no stop times' FROM tr WHERE trip_id NOT IN (SELECT trip_id FROM st)
    UNION ALL SELECT DISTINCT trip_id, 'invalid time' FROM st WHERE sec IS NULL
    UNION ALL SELECT DISTINCT trip_id, 'duplicate sequence' FROM l WHERE stop_sequence = same""")
def _(t: Tables):
    st = t.lineitem.selectExpr("l_orderkey AS trip_id", "l_suppkey AS stop_id", "l_linenumber AS stop_sequence", "CASE WHEN l_quantity = 13 THEN NULL ELSE CAST(l_quantity * 60 + l_linenumber * 600 AS BIGINT) END AS sec")
    trips = t.orders.selectExpr("o_orderkey AS trip_id", "o_custkey AS route_id", "o_orderstatus AS service_id")
    services = t.spark.sql("SELECT * FROM VALUES ('O'), ('F') AS s(service_id)")
    out = R.rejected_trips(trips, st, t.customer.where("c_nationkey <> 3").selectExpr("c_custkey AS route_id"), services, t.supplier.where("s_suppkey > 4").selectExpr("s_suppkey AS stop_id"))
    return out.where("reason <> 'time runs back'")


@query("r070_contract_validation", (70, 84), """
    SELECT n_nationkey, round(a, 4) AS a, round(b, 4) AS b FROM (
        SELECT c_nationkey AS n_nationkey, sum(c_acctbal) AS a FROM customer GROUP BY 1) FULL JOIN (
        SELECT s_nationkey AS n_nationkey, sum(s_acctbal) AS b FROM supplier GROUP BY 1) USING (n_nationkey)
    WHERE a IS NULL OR b IS NULL OR abs(a - b) > 0.01 + 0.5 * abs(b)""")
def _(t: Tables):
    a = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("c_acctbal").alias("v"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum("s_acctbal").alias("v"))
    return R.same_within(a, b, "n_nationkey", ["v"], 0.01, 0.5).select("n_nationkey", F.round("a_v", 4).alias("a"), F.round("b_v", 4).alias("b"))


portable("r071_missing_by_coverage", (71, 75), """
    SELECT n_nationkey, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= 5 THEN round(s, 4) END AS share FROM {nation} AS k LEFT JOIN (
        SELECT s_nationkey, count(*) AS n, avg(CASE WHEN s_acctbal > 5000 THEN 1.0D ELSE 0.0D END) AS s FROM {supplier} GROUP BY s_nationkey) AS a ON s_nationkey = n_nationkey""",
    """SELECT n_nationkey, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= 5 THEN round(s, 4) END AS share FROM nation LEFT JOIN (
        SELECT s_nationkey, count(*) AS n, avg(CASE WHEN s_acctbal > 5000 THEN 1.0 ELSE 0.0 END) AS s FROM supplier GROUP BY s_nationkey) ON s_nationkey = n_nationkey""")

portable("r072_immateriality", (72, 167), """
    SELECT k, a, b, abs(a - b) <= 0.05 * b AS near_value, abs(ra - rb) < 5 AS near_rank FROM (
        SELECT k, a, b, rank() OVER (PARTITION BY g ORDER BY a DESC) AS ra, rank() OVER (PARTITION BY g ORDER BY b DESC) AS rb FROM (
            SELECT c_nationkey AS k, c_nationkey % 5 AS g, count(*) AS a, sum(CASE WHEN c_acctbal > 500 THEN 1 ELSE 0 END) AS b FROM {customer} GROUP BY c_nationkey) AS x) AS y""",
    """SELECT k, a, CAST(b AS BIGINT) AS b, abs(a - b) <= 0.05 * b AS near_value, abs(ra - rb) < 5 AS near_rank FROM (
        SELECT k, a, b, rank() OVER (PARTITION BY g ORDER BY a DESC) AS ra, rank() OVER (PARTITION BY g ORDER BY b DESC) AS rb FROM (
            SELECT c_nationkey AS k, c_nationkey % 5 AS g, count(*) AS a, sum(CASE WHEN c_acctbal > 500 THEN 1 ELSE 0 END) AS b FROM customer GROUP BY c_nationkey) AS x) AS y""")


@query("r074_checked_join", (74, 83), "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def _(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    j = R.checked_join(t.orders.select("o_orderkey", "o_custkey"), c, ["o_custkey"], validate="many_to_one")
    return R.star_merge(j, [t.nation.select("n_nationkey", "n_name")], "n_nationkey").select("o_orderkey", "c_mktsegment", "n_name")


portable("r076_precedence_join", (76,), """
    SELECT c_custkey, CASE WHEN n_open > 0 THEN 'open' WHEN n_done > 0 THEN 'done' ELSE 'none' END AS status, coalesce(n_open, 0) AS n_open, coalesce(n_done, 0) AS n_done
    FROM {customer} AS c LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_open FROM {orders} WHERE o_orderstatus = 'O' GROUP BY o_custkey) AS a USING (c_custkey)
    LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_done FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey) AS b USING (c_custkey)""")


@query("r077_unique_match", (77,), "SELECT o_custkey, CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS o_orderkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey")
def _(t: Tables):
    return R.only_match(t.orders.where("o_orderpriority = '1-URGENT'"), ["o_custkey"], "o_orderkey")


@query("r078_key_fallback", (78,), """
    WITH a AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier), b AS (SELECT s_nationkey AS g, max(s_acctbal) AS v FROM supplier GROUP BY s_nationkey)
    SELECT c_custkey, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'exact' WHEN b.v IS NOT NULL THEN 'fallback' ELSE 'none' END AS source,
        coalesce(a.v <> b.v, false) AS disagree FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.g = c_nationkey""")
def _(t: Tables):
    a = t.supplier.selectExpr("s_suppkey AS c_custkey", "s_acctbal AS v")
    b = t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("v"))
    return R.key_or_fallback(t.customer.select("c_custkey", "c_nationkey"), a, b, "c_custkey", "c_nationkey", "v").drop("c_nationkey")


portable("r079_exists_self_join", (79,), """
    SELECT p_partkey FROM {part} AS a WHERE EXISTS (SELECT 1 FROM {part} AS b WHERE b.p_name = a.p_name AND b.p_brand = a.p_brand AND b.p_partkey <> a.p_partkey)""")
portable("r080_anti_join", (80,), "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_custkey IS NOT NULL)")
portable("r081_semi_join", (81,), "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0)")
portable("r082_outer_concat", (82, 290), """
    SELECT k, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT c_nationkey AS k, count(*) AS a FROM {customer} WHERE c_nationkey > 3 GROUP BY c_nationkey) AS x
    FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS b FROM {supplier} WHERE s_nationkey < 20 GROUP BY s_nationkey) AS y USING (k)""")


@query("r090_nearest_first", (90, 191), """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount, l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1""")
def _(t: Tables):
    return R.first_by(t.lineitem, ["l_suppkey"], *map(F.col, ("l_discount", "l_orderkey", "l_linenumber", "l_partkey"))).select("l_suppkey", "l_orderkey", "l_linenumber", "l_discount")


portable("r161_top_n_exclusion", (161, 190), """
    SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM {orders} WHERE o_orderkey NOT IN (
        SELECT o_orderkey FROM (SELECT o_orderkey FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) AS x) GROUP BY o_orderpriority""")
portable("r168_average_rank", (168, 169), """
    SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY v DESC) + (count(*) OVER (PARTITION BY c_nationkey, v) - 1) / 2.0D AS r
    FROM (SELECT c_custkey, c_nationkey, floor(c_acctbal / 100) AS v FROM {customer}) AS x""",
    """SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY v DESC) + (count(*) OVER (PARTITION BY c_nationkey, v) - 1) / 2 AS r
    FROM (SELECT c_custkey, c_nationkey, floor(c_acctbal / 100) AS v FROM customer) AS x""")
portable("r170_dense_rank", (170,), "SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) AS letter, chr(64 + dense_rank() OVER (ORDER BY p_type)) AS name FROM {part}",
    "SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) AS letter, chr(CAST(64 + dense_rank() OVER (ORDER BY p_type) AS INTEGER)) AS name FROM part")
portable("r172_lead_edges", (172, 175, 176), """
    SELECT user_id, event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
        count(*) OVER (PARTITION BY user_id) AS size FROM {events}""")
portable("r173_running_max", (173,), """
    SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, value FROM {events}""")
portable("r174_running_sum", (174,), """
    SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS total FROM {events}""")
portable("r177_group_share", (177, 178), """
    SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(l_tax / nullif(sum(l_tax) OVER w, 0), 0), 6) AS area_first,
        round(CASE WHEN sum(l_tax) OVER w > 0 THEN l_tax / sum(l_tax) OVER w WHEN sum(l_quantity) OVER w > 0 THEN l_quantity / sum(l_quantity) OVER w ELSE 0 END, 6) AS with_fallback,
        round(1 / CAST(count(*) OVER w AS DOUBLE), 6) AS equal_share FROM {lineitem} WINDOW w AS (PARTITION BY l_orderkey)""")
portable("r179_within_group_z", (179, 58), """
    SELECT c_custkey, round(greatest(least((c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w, 3), -3), 5) AS z,
        round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 5) AS z_all FROM {customer} WINDOW w AS (PARTITION BY c_nationkey)""")
portable("r189_top_bottom", (189,), """
    SELECT g, sum(CASE WHEN r <= 20 THEN 1 ELSE 0 END) AS top, sum(CASE WHEN r > n - 20 THEN 1 ELSE 0 END) AS bottom FROM (
        SELECT c_nationkey % 5 AS g, rank() OVER (ORDER BY c_acctbal DESC) AS r, count(*) OVER () AS n FROM {customer}) AS x GROUP BY g""",
    """SELECT g, CAST(sum(CASE WHEN r <= 20 THEN 1 ELSE 0 END) AS BIGINT) AS top, CAST(sum(CASE WHEN r > n - 20 THEN 1 ELSE 0 END) AS BIGINT) AS bottom FROM (
        SELECT c_nationkey % 5 AS g, rank() OVER (ORDER BY c_acctbal DESC) AS r, count(*) OVER () AS n FROM customer) AS x GROUP BY g""")
portable("r192_union_all", (192,), "SELECT c_custkey AS k, c_acctbal AS v, 'c' AS kind FROM {customer} UNION ALL SELECT s_suppkey, s_acctbal, 's' FROM {supplier}")


@query("r193_set_overlap", (193,), """
    WITH s AS (SELECT o_orderpriority AS p, list(DISTINCT o_custkey) AS c FROM orders GROUP BY 1)
    SELECT a.p AS a, b.p AS b, CAST(len(list_intersect(a.c, b.c)) AS BIGINT) AS common, round(len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))), 6) AS jaccard
    FROM s a JOIN s b ON a.p < b.p WHERE len(list_intersect(a.c, b.c)) > 0""")
def _(t: Tables):
    """Pairs of sets with members in common: the pairs of each member are counted, no set is collected."""
    s = t.orders.select(F.col("o_orderpriority").alias("p"), F.col("o_custkey").alias("k")).distinct()
    size = s.groupBy("p").agg(F.count("*").alias("n"))
    both = s.select(F.col("p").alias("a"), "k").join(s.select(F.col("p").alias("b"), "k"), "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    both = both.join(size.select(F.col("p").alias("a"), F.col("n").alias("x")), "a").join(size.select(F.col("p").alias("b"), F.col("n").alias("y")), "b")
    return both.select("a", "b", "common", F.round(F.col("common") / (F.col("x") + F.col("y") - F.col("common")), 6).alias("jaccard"))


portable("r194_explode", (194,), "SELECT vec_id, i, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, posexplode(embedding) AS (i, x) FROM {embeddings}) AS e",
    "SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")


@query("r195_pivot", (195, 196, 138), """
    SELECT l_suppkey, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS A, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS N,
        CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS R FROM lineitem GROUP BY l_suppkey""")
def _(t: Tables):
    return t.lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)


@query("r279_unpivot", (279,), "SELECT c_custkey, 'c_acctbal' AS slot, c_acctbal AS v FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey")).unpivot("c_custkey", ["c_acctbal", "c_nationkey"], "slot", "v")


@query("r199_hash_order_sample", (199,), """
    SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256(concat(CAST(c_custkey AS VARCHAR), ':7'))) AS n FROM customer) WHERE n <= 3""")
def _(t: Tables):
    order = F.sha2(F.concat(F.col("c_custkey").cast("string"), F.lit(":7")), 256)
    w = Window.partitionBy("c_nationkey").orderBy(order)
    return t.customer.withColumn("n", F.row_number().over(w)).where("n <= 3").select("c_nationkey", "c_custkey")


@query("r273_merge_duplicates", (273,), """
    SELECT p_name, CASE WHEN count(DISTINCT p_type) <= 1 THEN max(p_type) END AS p_type, CASE WHEN count(DISTINCT p_size) <= 1 THEN max(p_size) END AS p_size
    FROM (SELECT p_name || p_brand AS p_name, p_type, p_size FROM part) GROUP BY p_name""")
def _(t: Tables):
    return R.merge_duplicates(t.part.select(F.concat("p_name", "p_brand").alias("p_name"), "p_type", "p_size"), "p_name")


@query("r274_exact_duplicates", (274,), "SELECT sha256(html) AS h, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1")
def _(t: Tables):
    return t.pages.groupBy(F.sha2("html", 256).alias("h")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


portable("r283_ordered_string_agg", (283,), """
    SELECT c_nationkey, array_join(transform(array_sort(collect_list(struct(-c_acctbal AS o, c_custkey AS k))), x -> CAST(x.k AS STRING)), ';') AS ids
    FROM {customer} WHERE c_acctbal > 9000 GROUP BY c_nationkey""",
    "SELECT c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), ';' ORDER BY c_acctbal DESC, c_custkey) AS ids FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey")


@query("r292_unavailable_rows", (292,), """
    SELECT 'N' || n_nationkey AS unit_id, 'f1' AS feature, CAST(n_regionkey AS DOUBLE) AS value, 'ok' AS status, NULL AS reason FROM nation
    UNION ALL SELECT 'N' || n_nationkey, 'f2', NULL, 'unavailable', 'no source' FROM nation""")
def _(t: Tables):
    u = t.nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("unit_id"), "n_regionkey")
    long = u.select("unit_id", F.lit("f1").alias("feature"), F.col("n_regionkey").cast("double").alias("value"), F.lit("ok").alias("status"))
    return R.with_unavailable(u, long, {"f2": "no source"})
