"""Aggregates: weighted quantiles, entropy, log-ratios, scaling, rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, probabilities: list[float], rule: str = "midpoint") -> DataFrame:
    """keys, p, q: quantiles by linear interpolation over cumulative weights.

    ``midpoint`` puts a value at its cumulative weight less half its own,
    ``right`` at its cumulative weight; outside the first and last position the
    end values hold. Rows without value, or without positive weight, are left out.
    Equal values are merged first, so a heavy tie is one row per group."""
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"), F.min(weight).alias("_f"), F.max(weight).alias("_l"))
    order = Window.partitionBy(*keys).orderBy("_v")
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("_c", F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum("_w").over(whole))
    #: a tie spans from its first to its last position
    first = F.col("_c") - F.col("_w") + F.col("_f") * (0.5 if rule == "midpoint" else 1.0)
    last = F.col("_c") - (F.col("_l") * 0.5 if rule == "midpoint" else F.lit(0.0))
    rows = rows.withColumn("_a", first).withColumn("_b", F.when(F.col("_n") > 1, last).otherwise(first))
    rows = rows.withColumn("_pb", F.lag("_b").over(order)).withColumn("_pv", F.lag("_v").over(order)).withColumn("_last", F.lead("_v").over(order).isNull())
    asked = rows.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))).withColumn("_x", F.col("p") * F.col("_t"))
    after = F.col("_pb").isNull() | (F.col("_x") > F.col("_pb"))
    here = (after & (F.col("_x") <= F.col("_b"))) | (after & F.col("_last"))
    q = F.when((F.col("_x") >= F.col("_a")) | F.col("_pb").isNull(), F.col("_v")).otherwise(F.col("_pv") + (F.col("_v") - F.col("_pv")) * (F.col("_x") - F.col("_pb")) / (F.col("_a") - F.col("_pb")))
    return asked.where(here).select(*keys, "p", q.alias("q"))


def normalized_entropy(masses: list[Column], categories: int) -> Column:
    """Shannon entropy over ln(categories): 1 if even, 0 if single; no mass is
    null; a negative, infinite or undefined mass is an error."""
    total = sum((F.coalesce(m, F.lit(0.0)) for m in masses), F.lit(0.0))
    bad = F.exists(F.array(*masses), lambda m: F.coalesce((m < 0) | F.isnan(m.cast("double")) | (m == float("inf")), F.lit(False)))
    parts = sum((F.when(F.coalesce(m, F.lit(0.0)) > 0, -(m / total) * F.ln(m / total)).otherwise(0.0) for m in masses), F.lit(0.0))
    value = F.when(total > 0, parts / F.ln(F.lit(float(categories))))
    return F.when(bad, F.raise_error(F.lit("a mass is negative or not finite")).cast("double")).otherwise(value)


def centred_log_ratios(df: DataFrame, counts: list[str], within: str | None = None, add: float = 0.5) -> DataFrame:
    """clr_<count> for each row; with ``within``, less the mean of its group."""
    logs = [F.ln(F.col(c) + add) for c in counts]
    mean = sum(logs, F.lit(0.0)) / len(counts)
    out = df.withColumns({f"clr_{c}": x - mean for c, x in zip(counts, logs)})
    if within:
        w = Window.partitionBy(within)
        out = out.withColumns({f"clr_{c}": F.col(f"clr_{c}") - F.avg(f"clr_{c}").over(w) for c in counts})
    return out


def min_max(c: str, *keys: str) -> Column:
    """Scaled to 0..1 in its group; null where all are equal."""
    w = Window.partitionBy(*keys)
    return F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w))


def average_rank(c: Column, *keys: str) -> Column:
    """Rank in which ties share their mean."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2


def spearman(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """rho of the rows in which both are present, for each group."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = rows.select(*keys, average_rank(F.col(a), *keys).alias("_a"), average_rank(F.col(b), *keys).alias("_b"))
    return (ranked.groupBy(*keys) if keys else ranked).agg(F.corr("_a", "_b").alias("rho"), F.count("*").alias("n"))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def weighted_share(test: Column, w: Column) -> Column:
    return F.try_divide(F.sum(F.when(test, w).otherwise(0.0)), F.sum(w))


def gated(value: Column, coverage: Column, least: float) -> Column:
    """The value where the covered share is ``least`` or more, else null."""
    return F.when(coverage >= least, value)
