"""Joins and windows over time: as-of, intervals, interpolation, sessions, runs.

Interval joins are equi-joins on time buckets, never nested loops: an interval
is exploded to the buckets that it covers and exact bounds are tested after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, columns: list[str], bucket: float, strict: bool = False) -> DataFrame:
    """Each left row with the columns of the latest right row of its key at or
    before its time (before it, if ``strict``); null where there is none. Of
    several at one time that is the one of the largest ``columns``.

    Rows meet in time buckets of ``bucket`` units, so a hot key is spread over
    as many tasks as it has buckets; what a bucket ends with is carried on to
    the next ones over one small row per key and bucket."""
    b = F.floor(F.col(t) / bucket).alias("_b")
    r = right.select(*keys, F.col(t).alias("_t"), b, F.struct(F.col(t).alias("_at"), *columns).alias("_r"))
    rank = F.lit(0 if not strict else 1)
    l = left.withColumn("_b", b).withColumn("_t", F.col(t)).withColumn("_l", F.struct(*left.columns)).select(*keys, "_t", "_b", "_l", (F.lit(1) - rank).alias("_o"))
    both = l.unionByName(r.select(*keys, "_t", "_b", "_r", rank.alias("_o")), allowMissingColumns=True)
    inner = Window.partitionBy(*keys, "_b").orderBy("_t", "_o", "_r").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_in", F.last("_r", ignorenulls=True).over(inner)).where(F.col("_l").isNotNull())
    ends = both.groupBy(*keys, "_b").agg(F.max("_r").alias("_end"))
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "_b", "_carry")
    out = found.join(carried, [*keys, "_b"], "left").withColumn("_r", F.coalesce("_in", "_carry"))
    return out.select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in columns])


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, width: float, how: str = "inner", closed: str = "both", start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Points with the intervals of their key that hold them: [start, end] if
    ``closed`` is both, [start, end) if left. ``how``: inner, left_semi, left_anti."""
    spans = intervals.withColumn("_b", _buckets(F.col(start), F.col(end), width))
    p = points.withColumn("_b", F.floor(F.col(t) / width)).alias("p")
    s = spans.alias("s")
    on = F.col("p._b") == F.col("s._b")
    for k in keys:
        on = on & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    late = F.col(f"p.{t}") <= F.col(f"s.{end}") if closed == "both" else F.col(f"p.{t}") < F.col(f"s.{end}")
    on = on & (F.col(f"p.{t}") >= F.col(f"s.{start}")) & late
    out = p.join(s, on, how)
    mine = [F.col(f"p.{c}") for c in points.columns]
    return out.select(*mine) if how != "inner" else out.select(*mine, *[F.col(f"s.{c}") for c in intervals.columns if c not in keys])


def overlap_length(a: DataFrame, b: DataFrame, keys: list[str], width: float, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """``a`` with ``overlap``: the summed length that intervals of ``b`` cover of each.

    A pair is counted in the bucket in which its overlap begins only."""
    x = a.withColumn("_id", F.struct(*a.columns)).withColumn("_b", _buckets(F.col(start), F.col(end), width)).select(*keys, "_id", "_b", F.col(start).alias("_s"), F.col(end).alias("_e"))
    y = b.withColumn("_b", _buckets(F.col(start), F.col(end), width)).select(*keys, "_b", F.col(start).alias("_s2"), F.col(end).alias("_e2"))
    lo, hi = F.greatest("_s", "_s2"), F.least("_e", "_e2")
    pairs = x.join(y, [*keys, "_b"]).where((hi > lo) & (F.floor(lo / width) == F.col("_b")))
    total = pairs.groupBy("_id").agg(F.sum(hi - lo).alias("overlap"))
    return a.withColumn("_id", F.struct(*a.columns)).join(total, "_id", "left").drop("_id").na.fill(0.0, ["overlap"])


def interpolate(points: DataFrame, track: DataFrame, keys: list[str], t: str, values: list[str]) -> DataFrame:
    """Points with the track's values at their time, linear between samples and
    constant beyond the ends."""
    s = track.select(*keys, F.col(t).alias("_t"), F.struct(F.col(t).alias("_t"), *values).alias("_s"), F.lit(0).alias("_o"))
    p = points.withColumn("_p", F.struct(*points.columns)).select(*keys, F.col(t).alias("_t"), "_p", F.lit(1).alias("_o"))
    w = Window.partitionBy(*keys).orderBy("_t", "_o")
    both = s.unionByName(p, allowMissingColumns=True)
    both = both.withColumn("_a", F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_z", F.first("_s", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    share = F.coalesce(F.try_divide(F.col("_t") - F.col("_a._t"), F.col("_z._t") - F.col("_a._t")), F.lit(0.0))
    at = lambda v: F.coalesce(F.col(f"_a.{v}") + share * (F.col(f"_z.{v}") - F.col(f"_a.{v}")), F.col(f"_a.{v}"), F.col(f"_z.{v}"))
    return both.where(F.col("_p").isNotNull()).select("_p.*", *[at(v).alias(v) for v in values])


def sessions(df: DataFrame, keys: list[str], t: str, gap: float, *tie: str) -> DataFrame:
    """``df`` with ``session``: a new one begins where more than ``gap`` has passed."""
    w = Window.partitionBy(*keys).orderBy(t, *tie)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def session_intervals(df: DataFrame, keys: list[str], t: str, gap: float, least: int = 2, widen: float = 0.0) -> DataFrame:
    """start_s, end_s, n of sessions with ``least`` rows or more, widened on both sides."""
    g = sessions(df, keys, t, gap).groupBy(*keys, "session").agg((F.min(t) - widen).alias("start_s"), (F.max(t) + widen).alias("end_s"), F.count("*").alias("n"))
    return g.where(F.col("n") >= least)


def runs_of(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """first, last, n of maximal runs of consecutive rows with a true flag."""
    w = Window.partitionBy(*keys).orderBy(order)
    r = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_n", F.row_number().over(w))
    r = r.where("_f").withColumn("_g", F.col("_n") - F.row_number().over(w))
    return r.groupBy(*keys, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_g")


def coverage_gaps(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """gap_from, gap_to: what no interval covers between the first and the last."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    r = df.withColumn("_top", F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead(lo).over(w))
    return r.where(F.col("_next") > F.col("_top")).select(*keys, F.col("_top").alias("gap_from"), F.col("_next").alias("gap_to"))


def state_around(df: DataFrame, keys: list[str], t: str, state: Column) -> DataFrame:
    """``df`` with the last known state before each row, else the next one after it,
    and whether both are known and differ."""
    w = Window.partitionBy(*keys).orderBy(t)
    d = df.withColumn("_s", state)
    before, after = F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first("_s", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    d = d.withColumn("_b", before).withColumn("_a", after)
    return d.withColumn("state", F.coalesce("_b", "_a")).withColumn("conflict", F.coalesce(F.col("_b") != F.col("_a"), F.lit(False))).drop("_s", "_b", "_a")


def median_step(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Median time between consecutive rows of each key."""
    w = Window.partitionBy(*keys).orderBy(t)
    return df.withColumn("_d", F.col(t) - F.lag(t).over(w)).groupBy(*keys).agg(F.median("_d").alias("step"), F.count("*").alias("n"))
