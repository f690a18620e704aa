"""Calibrated, missing-aware family distances between units.

Values are long: (unit, city, family, block, column, value). A block's raw
distance is the mean squared difference over its columns; it is divided by the
median positive raw distance (``beta``) and combined over families by budgets,
using only the blocks that both units of a pair have. Pairs come from an
equi-join on the column, so the table has (units^2 x columns) rows and the plan
no cross join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import average_rank


def to_long(wide: DataFrame, unit: str, families: dict[str, list[str]], city: str | None = None, blocks: dict[str, str] | None = None) -> DataFrame:
    """Long table of a wide one; columns of one block (by default each its own, a
    family given in ``blocks`` shares one) are averaged together."""
    rows = [F.struct(F.lit(f).alias("family"), F.lit((blocks or {}).get(f, c)).alias("block"), F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for f, cs in families.items() for c in cs]
    out = wide.select(F.col(unit).alias("unit"), (F.col(city) if city else F.lit("")).alias("city"), F.explode(F.array(*rows)).alias("r")).select("unit", "city", "r.*")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def scaled(long: DataFrame, cap: float = 3.0, method: str = "standard", within_city: list[str] = ()) -> DataFrame:
    """Values scaled by column, over all units or within the city for the columns
    named: standard (mean, population SD, capped), robust (median, IQR, SD where
    the IQR is 0) or hellinger (square root of the share of its block)."""
    if method == "hellinger":
        total = F.sum("value").over(Window.partitionBy("unit", "family", "block"))
        return long.withColumn("value", F.sqrt(F.try_divide("value", total)))
    key = F.when(F.col("column").isin(list(within_city)), F.col("city")).otherwise(F.lit("")) if within_city else F.lit("")
    w = Window.partitionBy("column", "_k")
    x = long.withColumn("_k", key)
    if method == "robust":
        q = x.groupBy("column", "_k").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.stddev_pop("value").alias("sd"), F.max(F.abs("value")).alias("top"))
        iqr = F.col("q")[2] - F.col("q")[0]
        q = q.select("column", "_k", F.col("q")[1].alias("center"), F.when(iqr > 1e-12 * F.greatest(F.lit(1.0), F.col("top")), iqr).otherwise(F.col("sd")).alias("spread"))
        return x.join(F.broadcast(q), ["column", "_k"]).withColumn("value", F.try_divide(F.col("value") - F.col("center"), F.col("spread"))).select(*long.columns)
    z = F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w))
    return x.withColumn("value", F.greatest(F.least(z, F.lit(cap)), F.lit(-cap))).select(*long.columns)


def pair_table(long: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """i, j, family, block, m for i < j: mean squared difference of a block's columns
    (weighted by ``weights(column, w)``), null if a column is missing."""
    x = long if weights is None else long.join(F.broadcast(weights), "column", "left")
    w = F.lit(1.0) if weights is None else F.coalesce("w", F.lit(1.0))
    #: one row per unit and column, read by both sides of the join and by the calibration
    x = x.withColumn("_w", w).persist()
    a = x.select("family", "block", "column", F.col("unit").alias("i"), F.col("value").alias("a"), "_w")
    b = x.select("family", "block", "column", F.col("unit").alias("j"), F.col("value").alias("b"))
    d = a.join(b, ["family", "block", "column"]).where("i < j").withColumn("_d", F.pow(F.col("a") - F.col("b"), 2))
    m = F.when(F.count("_d") == F.count("*"), F.sum(F.col("_d") * F.col("_w")) / F.sum("_w"))
    return d.groupBy("i", "j", "family", "block").agg(m.alias("m"))


def calibrated(pairs: DataFrame, how: str = "median") -> DataFrame:
    """m over beta, the median (or mean) of the block's positive distances."""
    pairs = pairs.persist()  # read for beta, for the budgets and for the distances
    positive = F.when(F.col("m") > 0, F.col("m"))
    beta = pairs.groupBy("family", "block").agg((F.median(positive) if how == "median" else F.avg(positive)).alias("beta"))
    return pairs.join(F.broadcast(beta), ["family", "block"]).withColumn("m", F.try_divide("m", "beta"))


def equal_budgets(families: list[str], groups: list[list[str]] = ()) -> dict[str, float]:
    """1 over the number of families; a merged group shares the budget of one."""
    merged = {f: k for k, g in enumerate(groups) for f in g}
    slots = len(groups) + sum(f not in merged for f in families)
    return {f: 1 / slots / (len(groups[merged[f]]) if f in merged else 1) for f in families}


def domain_budgets(families: dict[str, str]) -> dict[str, float]:
    """Each domain has the same budget, shared by its families."""
    domains = list(families.values())
    return {f: 1 / len(set(domains)) / domains.count(d) for f, d in families.items()}


def _budget_table(pairs: DataFrame, budgets: dict[str, float]) -> DataFrame:
    share = 1 / F.size(F.collect_set("block").over(Window.partitionBy("family")))
    names = F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv])
    blocks = pairs.select("family", "block").distinct()
    return blocks.withColumn("w", names[F.col("family")] * share)


def distances(pairs: DataFrame, budgets: dict[str, float]) -> DataFrame:
    """i, j, d and parts (map family -> its part of d^2): available-case distance,
    sqrt(sum w m / sum w) over the blocks that both have."""
    x = pairs.join(F.broadcast(_budget_table(pairs, budgets)), ["family", "block"]).where(F.col("m").isNotNull() & (F.col("w") > 0))
    f = x.groupBy("i", "j", "family").agg(F.sum(F.col("w") * F.col("m")).alias("wm"), F.sum("w").alias("w"))
    return f.groupBy("i", "j").agg(
        F.sqrt(F.sum("wm") / F.sum("w")).alias("d"),
        F.map_from_entries(F.collect_list(F.struct("family", "wm"))).alias("parts"),
        F.sum("w").alias("weight"),
    ).withColumn("parts", F.transform_values("parts", lambda k, v: v / F.col("weight"))).drop("weight")


def both_ways(d: DataFrame) -> DataFrame:
    return d.select("i", "j", "d").unionByName(d.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def rank_target(d: DataFrame, target) -> DataFrame:
    """j, d, rank of all units by distance to one; ties share the smaller rank."""
    return both_ways(d).where(F.col("i") == target).select("j", "d", F.rank().over(Window.orderBy("d")).alias("rank"))


def neighbours(d: DataFrame, k: int = 5) -> DataFrame:
    """i, j, d, n: the k nearest of each unit, ties to the smaller id."""
    w = Window.partitionBy("i").orderBy("d", "j")
    return both_ways(d).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)


def contribution_shares(d: DataFrame) -> DataFrame:
    """family, mean, median, p90 of its share of d^2, and pairs where it is over half."""
    s = d.select("d", F.explode("parts").alias("family", "part")).withColumn("share", F.try_divide("part", F.pow("d", 2)))
    return s.groupBy("family").agg(F.avg("share").alias("mean"), F.median("share").alias("median"), F.percentile("share", 0.9).alias("p90"), F.count_if(F.col("share") > 0.5).alias("dominant"))


def compare(d: DataFrame, base: DataFrame, k: int = 5) -> DataFrame:
    """One row: Spearman's rho over pairs, and the mean share of common k nearest."""
    j = d.select("i", "j", F.col("d").alias("x")).join(base.select("i", "j", F.col("d").alias("y")), ["i", "j"])
    rho = j.select(average_rank(F.col("x")).alias("x"), average_rank(F.col("y")).alias("y")).agg(F.corr("x", "y").alias("rho"))
    a = neighbours(d, k).groupBy("i").agg(F.collect_set("j").alias("a"))
    b = neighbours(base, k).groupBy("i").agg(F.collect_set("j").alias("b"))
    common = a.join(b, "i").agg((F.avg(F.size(F.array_intersect("a", "b"))) / k).alias("overlap"))
    return rho.join(F.broadcast(common))  # one row each


def stability(pairs: DataFrame, budgets: dict[str, float], draws: int = 500, seed: int = 20261006, k: int = 5, stable: float = 0.8) -> DataFrame:
    """i, j, kept, stable: the share of weight draws (each budget times U(0.5, 1.5))
    that keep a baseline neighbour.

    Draws are a small table joined by family; ranks are taken within (draw, i)."""
    spark = pairs.sparkSession
    names = sorted(budgets)
    u = np.random.default_rng(seed).uniform(0.5, 1.5, (draws, len(names)))
    table = spark.createDataFrame([(d, f, float(u[d, k_] * budgets[f])) for d in range(draws) for k_, f in enumerate(names)], "draw int, family string, u double")
    x = pairs.join(F.broadcast(_budget_table(pairs, {f: 1.0 for f in names})), ["family", "block"]).where("m is not null")
    f = x.groupBy("i", "j", "family").agg(F.sum(F.col("w") * F.col("m")).alias("wm"), F.sum("w").alias("w"))
    d = f.join(F.broadcast(table), "family").groupBy("draw", "i", "j").agg((F.sum(F.col("u") * F.col("wm")) / F.sum(F.col("u") * F.col("w"))).alias("d"))
    both = d.unionByName(d.select("draw", F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    top = both.withColumn("n", F.row_number().over(Window.partitionBy("draw", "i").orderBy("d", "j"))).where(F.col("n") <= k)
    kept = top.groupBy("i", "j").agg((F.count("*") / draws).alias("kept"))
    base = neighbours(distances(pairs, budgets), k).select("i", "j")
    return base.join(kept, ["i", "j"], "left").na.fill(0.0, ["kept"]).withColumn("stable", F.col("kept") >= stable)


def other_city_share(d: DataFrame, cities: DataFrame, k: int = 5) -> DataFrame:
    """i, share: how many of the k nearest lie in another city."""
    c = cities.select(F.col("unit").alias("i"), F.col("city").alias("ci"))
    e = cities.select(F.col("unit").alias("j"), F.col("city").alias("cj"))
    return neighbours(d, k).join(F.broadcast(c), "i").join(F.broadcast(e), "j").groupBy("i").agg((F.count_if(F.col("ci") != F.col("cj")) / k).alias("share"))


def unusualness(pairs: DataFrame, cities: DataFrame) -> DataFrame:
    """i, family, gap, rank: mean calibrated distance of a unit to others of its
    city, and its rank there from the largest."""
    f = pairs.where("m is not null").groupBy("i", "j", "family").agg(F.avg("m").alias("m"))
    both = f.unionByName(f.select(F.col("j").alias("i"), F.col("i").alias("j"), "family", "m"))
    c, e = cities.select(F.col("unit").alias("i"), F.col("city").alias("c")), cities.select(F.col("unit").alias("j"), F.col("city").alias("c"))
    g = both.join(F.broadcast(c), "i").join(F.broadcast(e), ["j", "c"]).groupBy("c", "i", "family").agg(F.avg("m").alias("gap"))
    return g.withColumn("rank", F.rank().over(Window.partitionBy("c", "family").orderBy(F.col("gap").desc()))).drop("c")


def pool_neighbours(d: DataFrame, cities: DataFrame, k: int = 5) -> DataFrame:
    """i, j, d, n: the k nearest of each unit among those of other cities, ties to the
    smaller id."""
    c = cities.select(F.col("unit").alias("i"), F.col("city").alias("ci"))
    e = cities.select(F.col("unit").alias("j"), F.col("city").alias("cj"))
    pool = both_ways(d).join(F.broadcast(c), "i").join(F.broadcast(e), "j").where("ci <> cj")
    return pool.withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("n") <= k).select("i", "j", "d", "n")


def normalized_weights(weights: list[tuple[str, float]]) -> dict[str, float]:
    """Weights that sum to 1; a repeated column, a weight that is negative or not finite,
    or a sum of 0 is an error."""
    names = [c for c, _ in weights]
    if len(set(names)) < len(names):
        raise ValueError("a column has several weights")
    w = np.array([x for _, x in weights], float)
    if not np.isfinite(w).all() or (w < 0).any() or w.sum() <= 0:
        raise ValueError("weights must be finite, not negative, and of a positive sum")
    return dict(zip(names, (w / w.sum()).tolist()))
