"""Sinks, fingerprints and checkpoints by content."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, partition: list[str] = (), mode: str = "errorifexists") -> None:
    """Zstandard Parquet; with partitions, only those present are overwritten."""
    w = df.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def twins(df: DataFrame, path: str) -> None:
    """The same table as CSV and Parquet; CSV is read off the Parquet, so the plan
    runs once."""
    parquet(df, f"{path}.parquet")
    df.sparkSession.read.parquet(f"{path}.parquet").write.csv(f"{path}.csv", header=True)


def dump(path: str, value) -> None:
    """JSON by a temporary file and a rename; NaN is an error."""
    with open(f"{path}.part", "w") as f:
        json.dump(value, f, indent=1, sort_keys=True, allow_nan=False)
    os.replace(f"{path}.part", path)


def geojson_lines(df: DataFrame, geometry: str, path: str) -> None:
    """One GeoJSON feature a line: ``geometry`` is GeoJSON text, the rest properties."""
    rest = [c for c in df.columns if c != geometry]
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), F.col(geometry), F.lit(',"properties":'), F.to_json(F.struct(*rest)), F.lit("}"))
    df.select(feature.alias("value")).write.text(path)


def gpx(points: DataFrame, track: str, order: str) -> str:
    """A GPX document with a track for each value of ``track``: (lat, lon) in order."""
    rows = points.orderBy(track, order).select(track, "lat", "lon").collect()
    out, now = ['<?xml version="1.0"?>\n<gpx version="1.1" creator="metrolith" xmlns="http://www.topografix.com/GPX/1/1">'], None
    for t, lat, lon in rows:
        if t != now:
            out += ["</trkseg></trk>"] * (now is not None) + [f"<trk><name>{t}</name><trkseg>"]
            now = t
        out.append(f'<trkpt lat="{lat:.7f}" lon="{lon:.7f}"/>')
    return "\n".join([*out, *["</trkseg></trk>"] * (now is not None), "</gpx>"])


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of files."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def content_hash(df: DataFrame) -> str:
    """A digest of a table that does not depend on the order of its rows."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    n, a, b = df.select(row.alias("h")).agg(F.count("*"), F.sum(F.pmod("h", F.lit(1 << 31))), F.bit_xor("h")).first()
    return f"{n}:{a}:{b}"


def accepted(df: DataFrame, expected: str) -> DataFrame:
    """``df`` if its content hash is the one recorded at acceptance, else an error."""
    got = content_hash(df)
    if got != expected:
        raise ValueError(f"a table changed since it was accepted: {got}, expected {expected}")
    return df


def stage(spark: SparkSession, path: str, signature: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage's table, rebuilt only if its inputs' signature is another than before.

    The manifest is written last, beside the data: a broken run leaves none."""
    manifest = f"{path}/_stage"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop) and spark.read.text(manifest).first()[0] == signature:
        return spark.read.parquet(f"{path}/data")
    build().write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/data")
    spark.createDataFrame([(signature,)], "value string").coalesce(1).write.mode("overwrite").text(manifest)
    return spark.read.parquet(f"{path}/data")


def stage_units(spark: SparkSession, path: str, rows: DataFrame, unit: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A table of units, of which only those are built again whose input rows have another
    digest than at the last run; units that are gone stay in the table's history."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    now = rows.groupBy(unit).agg(F.concat_ws(":", F.count("*"), F.sum(row), F.bit_xor(row.cast("long"))).alias("_signature"))
    try:
        before = spark.read.parquet(f"{path}/signatures").select(unit, F.col("_signature").alias("_before"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        before = spark.createDataFrame([], now.select(unit, F.col("_signature").alias("_before")).schema)
    changed = now.join(before, unit, "left").where(F.col("_before").isNull() | (F.col("_before") != F.col("_signature"))).select(unit, "_signature")
    todo = f"{path}/todo"
    changed.write.mode("overwrite").parquet(todo)
    changed = spark.read.parquet(todo)
    built = build(rows.join(changed.select(unit), unit, "left_semi"))
    parquet(built, f"{path}/units", [unit], "overwrite")
    parquet(changed, f"{path}/signatures", [unit], "overwrite")
    return spark.read.schema(built.schema).parquet(f"{path}/units").join(now.select(unit), unit, "left_semi").select(*built.columns)


def publish(df: DataFrame, path: str, checks: dict[str, Column]) -> DataFrame:
    """Write beside ``path``, test the written rows with aggregate conditions, and
    rename; on failure nothing appears at ``path``."""
    spark, part = df.sparkSession, f"{path}.part"
    df.write.mode("overwrite").option("compression", "zstd").parquet(part)
    row = spark.read.parquet(part).agg(*[c.alias(f"c{k}") for k, c in enumerate(checks.values())]).first()
    failed = [name for name, ok in zip(checks, row) if not ok]
    if failed:
        raise ValueError(f"not published: {', '.join(failed)}")
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (part, path))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"could not rename {part}")
    return spark.read.parquet(path)
