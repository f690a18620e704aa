"""Joins with declared cardinality, key fallbacks, integrity rules and check ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _unique_or_fail(df: DataFrame, on: list[str], side: str) -> DataFrame:
    """Rows of ``df``; a key that occurs twice is an error when rows are read."""
    n = F.count("*").over(Window.partitionBy(*on))
    fault = F.raise_error(F.lit(f"keys of the {side} side are not unique: {', '.join(on)}")).cast("boolean")
    return df.withColumn("_n", n).where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(fault)).drop("_n")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """Equi-join that fails where the declared cardinality does not hold.

    The check shares the partitioning that the join needs anyway."""
    one_left, one_right = validate.startswith("one"), validate.endswith("one")
    left = _unique_or_fail(left, on, "left") if one_left else left
    right = _unique_or_fail(right, on, "right") if one_right else right
    return left.join(right, on, how)


def left_or_zero(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which a missing row means zero in every numeric column."""
    out = left.join(right, on, "left")
    new = [f.name for f in right.schema.fields if f.name not in on and f.dataType.typeName() in ("integer", "long", "double", "float", "short")]
    return out.na.fill(0, new)


def only_match(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, value: the value where a key has exactly one row, else null; and n."""
    return df.groupBy(*key).agg(F.when(F.count("*") == 1, F.min(value)).alias(value), F.count("*").alias("n"))


def key_or_fallback(left: DataFrame, exact: DataFrame, fallback: DataFrame, key: str, other: str, value: str) -> DataFrame:
    """``value`` by ``key``, else by ``other``; ``source`` says which one it was and
    ``disagree`` is true where both exist and differ."""
    out = left.join(exact.select(key, F.col(value).alias("_a")), key, "left").join(fallback.select(other, F.col(value).alias("_b")), other, "left")
    source = F.when(F.col("_a").isNotNull(), "exact").when(F.col("_b").isNotNull(), "fallback").otherwise("none")
    return out.select(*left.columns, F.coalesce("_a", "_b").alias(value), source.alias("source"), F.coalesce(F.col("_a") != F.col("_b"), F.lit(False)).alias("disagree"))


def star_merge(base: DataFrame, factors: list[DataFrame], on: str) -> DataFrame:
    """Left joins of tables with one row per unit; the row count cannot change."""
    return reduce(lambda a, b: checked_join(a, b, [on], "left", "many_to_one"), factors, base)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a full order; ties are the caller's to break."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def without_top(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Rows without those of the n largest values (ties to the smaller key)."""
    top = df.orderBy(F.col(value).desc(), key).limit(n).select(key)
    return df.join(F.broadcast(top), key, "left_anti")


def merge_duplicates(df: DataFrame, key: str) -> DataFrame:
    """One row per key; an attribute whose values differ becomes null."""
    return df.groupBy(key).agg(*[F.when(F.count_distinct(c) <= 1, F.max(c)).alias(c) for c in df.columns if c != key])


def ledger(df: DataFrame, checks: dict[str, Column], detail: dict[str, Column] | None = None) -> DataFrame:
    """name, pass, detail: each check is an aggregate over ``df``; all are evaluated
    in one pass and failures are kept, not raised."""
    detail = detail or {}
    one = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(checks.values())], *[c.cast("string").alias(f"d{i}") for i, c in enumerate(detail.get(k, F.lit(None)) if not isinstance(detail.get(k), str) else F.lit(detail[k]) for k in checks)])
    rows = [F.struct(F.lit(k).alias("name"), F.coalesce(F.col(f"c{i}"), F.lit(False)).alias("pass"), F.col(f"d{i}").alias("detail")) for i, k in enumerate(checks)]
    return one.select(F.inline(F.array(*rows)))


def raise_unless(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df`` unchanged; reading a row that fails the condition is an error."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def rejected_trips(trips: DataFrame, stop_times: DataFrame, routes: DataFrame, services: DataFrame, stops: DataFrame) -> DataFrame:
    """trip_id, reason for every referential or timing fault of a timetable."""
    say = lambda df, reason: df.select("trip_id", F.lit(reason).alias("reason")).distinct()
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    timed = stop_times.withColumn("before", F.lag("sec").over(w)).withColumn("same", F.lag("stop_sequence").over(w))
    return reduce(
        DataFrame.unionByName,
        [
            say(trips.join(routes, "route_id", "left_anti"), "unknown route"),
            say(trips.join(services, "service_id", "left_anti"), "unknown service"),
            say(stop_times.join(stops, "stop_id", "left_anti"), "unknown stop"),
            say(trips.join(stop_times.select("trip_id").distinct(), "trip_id", "left_anti"), "no stop times"),
            say(timed.where("sec is null"), "invalid time"),
            say(timed.where("sec < before"), "time runs back"),
            say(timed.where("stop_sequence = same"), "duplicate sequence"),
        ],
    )


def same_within(a: DataFrame, b: DataFrame, key: str, columns: list[str], atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """Rows in which two tables differ: a missing key or a value that is not close."""
    j = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("in_a")).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("in_b")), key, "full_outer")
    far = reduce(lambda x, y: x | y, [F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > atol + rtol * F.abs(f"b_{c}"), F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull()) for c in columns])
    return j.where(F.col("in_a").isNull() | F.col("in_b").isNull() | far)


def with_unavailable(units: DataFrame, long: DataFrame, features: dict[str, str]) -> DataFrame:
    """The long table with a row for every unit and unavailable feature: no value,
    status 'unavailable' and the reason."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.lit(v).alias("reason")) for k, v in features.items()]))
    gone = units.select("unit_id", rows.alias("f")).select("unit_id", "f.feature", F.lit(None).cast("double").alias("value"), F.lit("unavailable").alias("status"), "f.reason")
    return long.unionByName(gone, allowMissingColumns=True)


def stratified_pick(df: DataFrame, strata: list[str], key: str, value: str, threshold: float, n: int, seed: int = 7) -> DataFrame:
    """strata, key, reason: of each stratum ``n`` rows in the order of a hash of their key,
    the ``n`` of the largest value and the ``n`` nearest to a threshold; a row
    may be picked for several reasons."""
    random = F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), 256)
    orders = {"random": [random], "largest": [F.col(value).desc()], "near": [F.abs(F.col(value) - threshold)]}
    ranked = df.select(*strata, key, *[F.row_number().over(Window.partitionBy(*strata).orderBy(*o, F.col(key))).alias(k) for k, o in orders.items()])
    reason = F.explode(F.filter(F.array(*[F.when(F.col(k) <= n, F.lit(k)) for k in orders]), lambda x: x.isNotNull()))
    return ranked.where(F.least(*orders) <= n).select(*strata, key, reason.alias("reason"))
