"""Queries of the similarity layer, with nations as reporting units."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matrix as M
from ..operators import similarity as S
from .registry import Tables, query

FAMILIES = {"use": ["orders_n", "price_mean"], "form": ["balance"], "mix": ["machinery"]}
BUDGETS = {"use": 0.5, "form": 0.25, "mix": 0.25}

_UNITS = """
    o AS (SELECT c_nationkey AS unit, count(*) AS orders_n, avg(o_totalprice) AS price_mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    c AS (SELECT c_nationkey AS unit, avg(c_acctbal) AS balance, avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 ELSE 0.0 END) AS machinery FROM customer GROUP BY 1),
    u AS (SELECT n_nationkey AS unit, n_regionkey AS city, orders_n, price_mean, balance, CASE WHEN n_nationkey % 6 <> 0 THEN machinery END AS machinery
        FROM nation LEFT JOIN o ON o.unit = n_nationkey LEFT JOIN c ON c.unit = n_nationkey)"""
_LONG = _UNITS + """,
    l AS (SELECT unit, city, 'use' AS family, 'orders_n' AS block, CAST(orders_n AS DOUBLE) AS v FROM u UNION ALL SELECT unit, city, 'use', 'price_mean', price_mean FROM u
        UNION ALL SELECT unit, city, 'form', 'balance', balance FROM u UNION ALL SELECT unit, city, 'mix', 'machinery', machinery FROM u),
    z AS (SELECT unit, city, family, block, greatest(least((v - avg(v) OVER w) / stddev_pop(v) OVER w, 3), -3) AS v FROM l WINDOW w AS (PARTITION BY block)),
    p AS (SELECT a.unit AS i, b.unit AS j, a.family, a.block, power(a.v - b.v, 2) AS m FROM z a JOIN z b ON a.block = b.block AND a.unit < b.unit),
    k AS (SELECT block, median(m) FILTER (WHERE m > 0) AS beta FROM p GROUP BY block),
    q AS (SELECT i, j, p.family, p.block, m / beta AS m, CASE p.family WHEN 'use' THEN 0.25 ELSE 0.25 END AS w FROM p JOIN k ON p.block = k.block),
    d AS (SELECT i, j, sqrt(sum(w * m) / sum(w)) AS d FROM q WHERE m IS NOT NULL GROUP BY i, j),
    b AS (SELECT i, j, d FROM d UNION ALL SELECT j, i, d FROM d)"""


def compare_sql(budgets: dict[str, float], base: dict[str, float]) -> str:
    """SQL for one row: Spearman's rho over pairs, and the share of common 5 nearest."""

    def distance(name: str, share: dict[str, float]) -> str:
        per = {f: b / len(FAMILIES[f]) for f, b in share.items()}
        w = "CASE family " + " ".join(f"WHEN '{f}' THEN {x!r}" for f, x in per.items()) + " END"
        return f"""{name} AS (SELECT i, j, sqrt(sum({w} * m) / sum({w})) AS d FROM q WHERE m IS NOT NULL AND {w} > 0 GROUP BY i, j),
    {name}n AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM (SELECT i, j, d FROM {name} UNION ALL SELECT j, i, d FROM {name}))"""

    return f"""WITH {_LONG}, {distance("one", budgets)}, {distance("two", base)},
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS y
        FROM (SELECT one.d AS x, two.d AS y FROM one JOIN two USING (i, j))),
    shared AS (SELECT count(*) AS n FROM onen JOIN twon USING (i, j) WHERE onen.n <= 5 AND twon.n <= 5)
    SELECT round((SELECT corr(x, y) FROM r), 6) AS rho, round((SELECT n FROM shared) / 5 / (SELECT count(DISTINCT i) FROM onen), 6) AS overlap"""


def units(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("orders_n"), F.avg("o_totalprice").alias("price_mean"))
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("balance"), F.avg((F.col("c_mktsegment") == "MACHINERY").cast("double")).alias("machinery"))
    u = t.nation.join(o, "n_nationkey", "left").join(c, "n_nationkey", "left")
    return u.select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("city"), "orders_n", "price_mean", "balance", F.when(F.col("unit") % 6 != 0, F.col("machinery")).alias("machinery"))


def pairs(t: Tables) -> DataFrame:
    return S.calibrated(S.pair_table(S.scaled(S.to_long(units(t), "unit", FAMILIES, "city"))))


@query("flagship_unit_similarity", (178, 186, 207, 209, 210), f"""
    WITH {_LONG} SELECT i, j, round(d, 5) AS d, n FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM b) WHERE n <= 5""")
def _(t: Tables):
    return S.neighbours(S.distances(pairs(t), BUDGETS)).select("i", "j", F.round("d", 5).alias("d"), "n")


@query("r167_rank_target", (167, 187), f"WITH {_LONG} SELECT j, round(d, 5) AS d, rank() OVER (ORDER BY d) AS rank FROM b WHERE i = 3")
def _(t: Tables):
    return S.rank_target(S.distances(pairs(t), BUDGETS), 3).select("j", F.round("d", 5).alias("d"), "rank")


@query("r166_contribution_shares", (166,), f"""
    WITH {_LONG}, f AS (SELECT i, j, family, sum(w * m) AS wm, sum(w) AS w FROM q WHERE m IS NOT NULL GROUP BY 1, 2, 3), t AS (SELECT i, j, sum(wm) AS t FROM f GROUP BY 1, 2)
    SELECT family, round(avg(wm / t), 5) AS mean, round(median(wm / t), 5) AS median, CAST(count(*) FILTER (WHERE wm / t > 0.5) AS BIGINT) AS dominant FROM f JOIN t USING (i, j) GROUP BY family""")
def _(t: Tables):
    c = S.contribution_shares(S.distances(pairs(t), BUDGETS))
    return c.select("family", F.round("mean", 5).alias("mean"), F.round("median", 5).alias("median"), "dominant")


@query("r203_robust_scale", (203, 204), f"""
    WITH {_UNITS}, s AS (SELECT quantile_cont(balance, 0.5) AS m, quantile_cont(balance, 0.75) - quantile_cont(balance, 0.25) AS iqr FROM u)
    SELECT unit, round((balance - m) / iqr, 5) AS v FROM u, s""")
def _(t: Tables):
    return S.scaled(S.to_long(units(t), "unit", {"form": ["balance"]}), method="robust").select("unit", F.round("value", 5).alias("v"))


@query("r205_hellinger", (205,), """
    WITH c AS (SELECT c_nationkey AS unit, c_mktsegment AS k, count(*) AS n FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING') GROUP BY 1, 2)
    SELECT unit, k AS "column", round(sqrt(n / sum(n) OVER (PARTITION BY unit)), 6) AS v FROM c""")
def _(t: Tables):
    c = t.customer.where(F.col("c_mktsegment").isin("MACHINERY", "BUILDING")).groupBy(F.col("c_nationkey").alias("unit")).pivot("c_mktsegment", ["MACHINERY", "BUILDING"]).count()
    long = S.to_long(c, "unit", {"mix": ["MACHINERY", "BUILDING"]}, blocks={"mix": "mix"})
    return S.scaled(long, method="hellinger").where("value is not null").select("unit", "column", F.round("value", 6).alias("v"))


@query("r220_compare_distances", (220, 212, 213), compare_sql({"use": 0.5, "form": 0.25, "mix": 0.25}, {"use": 0.25, "mix": 0.25, "form": 0.5}))
def _(t: Tables):
    p = pairs(t)
    c = S.compare(S.distances(p, S.domain_budgets({"use": "a", "form": "b", "mix": "b"})), S.distances(p, S.equal_budgets(list(FAMILIES), [["use", "mix"]])))
    return c.select(F.round("rho", 6).alias("rho"), F.round("overlap", 6).alias("overlap"))


def _draws_sql(draws: int = 500, seed: int = 20261006) -> str:
    names = sorted(BUDGETS)
    u = np.random.default_rng(seed).uniform(0.5, 1.5, (draws, len(names)))
    return ", ".join(f"({d}, '{f}', {float(u[d, k] * BUDGETS[f])!r})" for d in range(draws) for k, f in enumerate(names))


@query("r221_weight_stability", (221, 201), f"""
    WITH {_LONG}, draw(draw, family, u) AS (VALUES {_draws_sql()}), f AS (SELECT i, j, family, sum(m * v) AS wm, sum(v) AS w FROM (SELECT *, CASE family WHEN 'use' THEN 0.5 ELSE 1.0 END AS v FROM q WHERE m IS NOT NULL) GROUP BY 1, 2, 3),
    e AS (SELECT draw, i, j, sum(u * wm) / sum(u * w) AS d FROM f JOIN draw USING (family) GROUP BY 1, 2, 3), y AS (SELECT draw, i, j, d FROM e UNION ALL SELECT draw, j, i, d FROM e),
    n AS (SELECT *, row_number() OVER (PARTITION BY draw, i ORDER BY d, j) AS n FROM y), h AS (SELECT i, j, count(*) / 500 AS kept FROM n WHERE n <= 5 GROUP BY 1, 2),
    base AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM b) WHERE n <= 5)
    SELECT base.i, base.j, coalesce(kept, 0) AS kept, coalesce(kept, 0) >= 0.8 AS stable FROM base LEFT JOIN h ON h.i = base.i AND h.j = base.j""")
def _(t: Tables):
    return S.stability(pairs(t), BUDGETS)


@query("r223_other_city_share", (223,), f"""
    WITH {_LONG}, n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM b)
    SELECT i, count(*) FILTER (WHERE x.n_regionkey <> y.n_regionkey) / 5 AS share FROM n JOIN nation x ON x.n_nationkey = i JOIN nation y ON y.n_nationkey = j WHERE n <= 5 GROUP BY i""")
def _(t: Tables):
    return S.other_city_share(S.distances(pairs(t), BUDGETS), t.nation.select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("city")))


@query("r284_unusualness", (284,), f"""
    WITH {_LONG}, f AS (SELECT i, j, family, avg(m) AS m FROM q WHERE m IS NOT NULL GROUP BY 1, 2, 3), e AS (SELECT i, j, family, m FROM f UNION ALL SELECT j, i, family, m FROM f),
    g AS (SELECT x.n_regionkey AS c, i, family, avg(m) AS gap FROM e JOIN nation x ON x.n_nationkey = i JOIN nation y ON y.n_nationkey = j AND y.n_regionkey = x.n_regionkey GROUP BY 1, 2, 3)
    SELECT i, family, round(gap, 5) AS gap, rank() OVER (PARTITION BY c, family ORDER BY gap DESC) AS rank FROM g""")
def _(t: Tables):
    u = S.unusualness(pairs(t), t.nation.select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("city")))
    return u.select("i", "family", F.round("gap", 5).alias("gap"), "rank")


@query("r225_index_gap", (225,), """
    WITH f AS (SELECT c_nationkey AS u, avg(c_acctbal) AS a, count(*) AS n FROM customer GROUP BY 1),
    s AS (SELECT u, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS x, (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) AS y FROM f)
    SELECT a.u AS i, b.u AS j, round(abs(a.x + a.y - b.x - b.y), 6) AS gap, round(sqrt(0.5 * power(a.x - b.x, 2) + 0.5 * power(a.y - b.y, 2)), 6) AS profile FROM s a JOIN s b ON a.u < b.u""")
def _(t: Tables):
    from ..functions.stats import min_max

    f = t.customer.groupBy(F.col("c_nationkey").alias("u")).agg(F.avg("c_acctbal").alias("a"), F.count("*").alias("n"))
    s = f.select("u", min_max("a").alias("x"), min_max("n").alias("y"), F.lit(1).alias("k"))
    a, b = s.select(F.col("u").alias("i"), F.col("x").alias("x1"), F.col("y").alias("y1"), "k"), s.select(F.col("u").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), "k")
    gap = F.abs(F.col("x1") + F.col("y1") - F.col("x2") - F.col("y2"))
    return a.join(b, "k").where("i < j").select("i", "j", F.round(gap, 6).alias("gap"), F.round(F.sqrt(0.5 * F.pow(F.col("x1") - F.col("x2"), 2) + 0.5 * F.pow(F.col("y1") - F.col("y2"), 2)), 6).alias("profile"))


@query("r226_ward_clusters", (226, 217))
def _(t: Tables):
    ids, d = M.square(S.distances(pairs(t), BUDGETS))
    _, labels = M.best_clusters(d)
    axes = M.principal_coordinates(d)[0]
    return t.spark.createDataFrame([(int(u), int(c), float(round(x, 6))) for u, c, x in zip(ids, labels, axes[:, 0])], "unit int, cluster int, axis1 double")


@query("r216_prune_columns", (216,))
def _(t: Tables):
    rows = units(t).orderBy("unit").na.fill(0.0).collect()
    names = ["orders_n", "price_mean", "balance", "machinery"]
    x = np.array([[float(r[c]) for c in names] for r in rows])
    rho = M.spearman_matrix(x)
    return t.spark.createDataFrame([(c, c in M.prune(names, rho, 0.3), float(round(M.rank_r2(x[:, k], np.delete(x, k, 1)), 6))) for k, c in enumerate(names)], "name string, kept boolean, rank_r2 double")


@query("r188_pool_neighbours", (188, 206), f"""
    WITH {_LONG}, n AS (SELECT b.*, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM b JOIN nation x ON x.n_nationkey = i JOIN nation y ON y.n_nationkey = j WHERE x.n_regionkey <> y.n_regionkey)
    SELECT i, j, round(d, 5) AS d, n FROM n WHERE n <= 3""")
def _(t: Tables):
    budgets = S.normalized_weights([("use", 2.0), ("form", 1.0), ("mix", 1.0)])
    cities = t.nation.select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("city"))
    return S.pool_neighbours(S.distances(pairs(t), budgets), cities, 3).select("i", "j", F.round("d", 5).alias("d"), "n")
