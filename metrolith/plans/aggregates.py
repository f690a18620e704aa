"""Queries of aggregates and index factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from .registry import Tables, portable, query


@query("r139_zero_fill", (139, 273), "SELECT n_nationkey, CAST(coalesce(sum(s_acctbal), 0) AS DOUBLE) AS v FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000 GROUP BY 1")
def _(t: Tables):
    from ..operators.relational import left_or_zero

    s = t.supplier.where("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum("s_acctbal").alias("v"))
    return left_or_zero(t.nation.select("n_nationkey"), s, ["n_nationkey"])


portable("r140_max_then_sum", (140, 141), """
    SELECT k, sum(m) AS v, sum(m_late) AS v_late FROM (SELECT l_suppkey AS k, l_returnflag, max(l_quantity) AS m, coalesce(max(CASE WHEN l_discount > 0.05 THEN l_quantity END), 0) AS m_late
        FROM {lineitem} GROUP BY l_suppkey, l_returnflag) AS x GROUP BY k""")


@query("r143_weighted_mean", (143, 144), """
    SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean, round(sum(CASE WHEN l_tax > 0.04 THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS share
    FROM lineitem GROUP BY l_returnflag""")
def _(t: Tables):
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(S.weighted_mean(F.col("l_discount"), q), 6).alias("mean"), F.round(S.weighted_share(F.col("l_tax") > 0.04, q), 6).alias("share"))


portable("r145_filter_aggregates", (145, 146, 148, 289), """
    SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS r, round(coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0), 2) AS f, count(DISTINCT l_partkey) AS parts,
        bool_or(l_tax = 0) AS untaxed, min(CASE WHEN l_quantity > 40 THEN l_orderkey END) AS first_large, count(DISTINCT l_linenumber) FILTER (WHERE l_discount > 0) AS lines,
        round(sum(CASE WHEN l_returnflag = 'A' THEN greatest(l_quantity - 25, 0) ELSE 0 END), 2) AS floored FROM {lineitem} GROUP BY l_suppkey""")
portable("r147_group_by_all", (147,), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS q FROM {lineitem} GROUP BY ALL")
portable("r149_majority_class", (149,), """
    SELECT l_orderkey, max_by(f, w) AS class, bool_or(f = 'A') AND bool_or(f = 'R') AS mixed FROM (
        SELECT l_orderkey, l_returnflag AS f, round(sum(l_quantity), 2) + 1e-6 * count(*) + 1e-9 * ascii(l_returnflag) AS w FROM {lineitem} GROUP BY l_orderkey, l_returnflag) AS x GROUP BY l_orderkey""")
portable("r150_median_nunique", (150, 164, 287), """
    SELECT o_orderpriority, round(median(o_totalprice), 4) AS med, max(o_totalprice) AS hi, min(o_totalprice) AS lo, count(DISTINCT o_custkey) AS customers, count(*) AS n FROM {orders} GROUP BY o_orderpriority""")
portable("r151_quantiles", (151, 164), """
    SELECT c_nationkey, round(percentile(c_acctbal, 0.25), 5) AS p25, round(percentile(c_acctbal, 0.5), 5) AS p50, round(percentile(c_acctbal, 0.75), 5) AS p75, round(percentile(c_acctbal, 0.9), 5) AS p90
    FROM {customer} GROUP BY c_nationkey""",
    """SELECT c_nationkey, round(quantile_cont(c_acctbal, 0.25), 5) AS p25, round(quantile_cont(c_acctbal, 0.5), 5) AS p50, round(quantile_cont(c_acctbal, 0.75), 5) AS p75, round(quantile_cont(c_acctbal, 0.9), 5) AS p90
    FROM customer GROUP BY c_nationkey""")

_WQ = """
    WITH v AS (SELECT p_type AS g, p_retailprice AS v, sum(CAST(p_size AS DOUBLE)) AS w FROM part GROUP BY 1, 2),
    c AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY v) - {off} * w AS pos, sum(w) OVER (PARTITION BY g) AS tot FROM v),
    n AS (SELECT *, lag(pos) OVER o AS ppos, lag(v) OVER o AS pv, lead(v) OVER o IS NULL AS lst FROM c WINDOW o AS (PARTITION BY g ORDER BY v)),
    a AS (SELECT *, p, p * tot AS x FROM n, (VALUES (0.1), (0.25), (0.5), (0.9)) AS q(p))
    SELECT g, CAST(p AS DOUBLE) AS p, round(CASE WHEN x >= pos OR ppos IS NULL THEN v ELSE pv + (v - pv) * (x - ppos) / (pos - ppos) END, 4) AS q
    FROM a WHERE (ppos IS NULL OR x > ppos) AND (x <= pos OR lst)"""
for _name, _row, _rule, _off in (("r152_weighted_quantile_midpoint", 152, "midpoint", "0.5"), ("r153_weighted_quantile_right", 153, "right", "0")):

    @query(_name, (_row,), _WQ.replace("{off}", _off))
    def _(t: Tables, rule=_rule):
        p = t.part.groupBy(F.col("p_type").alias("g"), "p_retailprice").agg(F.sum(F.col("p_size").cast("double")).alias("w"))
        out = S.weighted_quantiles(p, ["g"], "p_retailprice", "w", [0.1, 0.25, 0.5, 0.9], rule)
        return out.select("g", "p", F.round("q", 4).alias("q"))


@query("r154_entropy", (154,), """
    WITH m AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), s AS (SELECT l_suppkey, sum(q) AS t FROM m GROUP BY 1)
    SELECT l_suppkey, round(sum(-(q / t) * ln(q / t)) / ln(3), 6) AS h FROM m JOIN s USING (l_suppkey) GROUP BY 1""")
def _(t: Tables):
    wide = t.lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return wide.select("l_suppkey", F.round(S.normalized_entropy([F.col(c) for c in "ANR"], 3), 6).alias("h"))


@query("r156_clr", (156,), """
    WITH c AS (SELECT l_suppkey, l_suppkey % 3 AS g, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
    l AS (SELECT *, (ln(a + 0.5) + ln(n + 0.5) + ln(r + 0.5)) / 3 AS m FROM c)
    SELECT l_suppkey, round(ln(a + 0.5) - m - avg(ln(a + 0.5) - m) OVER (PARTITION BY g), 6) AS clr_a, round(ln(n + 0.5) - m - avg(ln(n + 0.5) - m) OVER (PARTITION BY g), 6) AS clr_n,
        round(ln(r + 0.5) - m - avg(ln(r + 0.5) - m) OVER (PARTITION BY g), 6) AS clr_r FROM l""")
def _(t: Tables):
    wide = t.lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)
    wide = wide.select("l_suppkey", (F.col("l_suppkey") % 3).alias("g"), F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))
    out = S.centred_log_ratios(wide, ["a", "n", "r"], "g")
    return out.select("l_suppkey", *[F.round(f"clr_{c}", 6).alias(f"clr_{c}") for c in "anr"])


#: the smallest path from additive components to an index
portable("r158_additive_index", (157, 158, 159), """
    WITH comp AS (SELECT n_nationkey AS unit, count(*) AS orders_n, sum(o_totalprice) AS price_sum, count(DISTINCT c_custkey) AS cust_n
                  FROM {orders} AS o JOIN {customer} AS c ON o_custkey = c_custkey JOIN {nation} AS n ON c_nationkey = n_nationkey GROUP BY n_nationkey),
    raw AS (SELECT unit, orders_n / CAST(cust_n AS DOUBLE) AS f1, price_sum / orders_n AS f2 FROM comp),
    sc AS (SELECT unit, (f1 - min(f1) OVER ()) / (max(f1) OVER () - min(f1) OVER ()) AS s1, (f2 - min(f2) OVER ()) / (max(f2) OVER () - min(f2) OVER ()) AS s2 FROM raw)
    SELECT unit, round(s1 + s2, 6) AS idx, rank() OVER (ORDER BY round(s1 + s2, 6) DESC) AS rk FROM sc""")
portable("r160_modal_crosswalk", (160,), """
    SELECT c_mktsegment, max_by(k, n * 1000 - k) AS unit FROM (SELECT c_mktsegment, c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY c_mktsegment, c_nationkey) AS x GROUP BY c_mktsegment""")
portable("r162_survey_error", (162, 163), """
    SELECT l_returnflag, round(sum(l_quantity), 4) AS est, round(sqrt(sum(l_quantity * l_quantity)) / sum(l_quantity), 8) AS se, round(sqrt(sum(power(l_quantity * l_tax, 2))), 6) AS moe,
        round(sqrt(sum(power(l_quantity * l_tax, 2))) / 1.645 / sum(l_quantity), 8) AS cv FROM {lineitem} GROUP BY l_returnflag""")
portable("r165_linear_fit", (165,), "SELECT p_type, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS icept FROM {part} GROUP BY p_type")


@query("r229_spearman", (229, 230, 231), """
    WITH r AS (SELECT c_nationkey AS g, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2 AS a,
        rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 17) + (count(*) OVER (PARTITION BY c_nationkey, c_custkey % 17) - 1) / 2 AS b FROM customer)
    SELECT g, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY g""")
def _(t: Tables):
    c = t.customer.select(F.col("c_nationkey").alias("g"), "c_acctbal", (F.col("c_custkey") % 17).alias("m"))
    return S.spearman(c, "c_acctbal", "m", "g").select("g", F.round("rho", 6).alias("rho"), "n")
