"""Readers: typed text tables, timetables, vector, raster and point-cloud files.

Tables are read by Spark's own sources with explicit schemas; other formats are
decoded from ``binaryFile`` rows in Arrow batches, so they open on any file system
that Spark knows and files are spread over executors.
"""

from __future__ import annotations

import json
import sqlite3
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from io import BytesIO
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import line_wkb, polygon_wkb


def strings(spark: SparkSession, path: str, columns: list[str], sep: str = ",", strict: bool = True) -> DataFrame:
    """A delimited table (gzip or not) with every column a string; ids keep their
    leading zeros. A row that does not fit is an error if ``strict``."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, sep=sep, header=True, mode="FAILFAST" if strict else "PERMISSIVE", enforceSchema=False)


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns cast with ``try_cast``: what does not parse is null, and NaN too."""
    out = {c: F.col(c).try_cast(k) for c, k in kinds.items()}
    return df.withColumns({c: F.when(~F.isnan(v), v) if kinds[c] == "double" else v for c, v in out.items()})


def by_extension(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.csv(path, header=True) if path.split(".gz")[0].endswith(".csv") else spark.read.parquet(path)
    return df.select(*columns) if columns else df


def view(spark: SparkSession, glob: str, name: str) -> DataFrame:
    df = spark.read.parquet(glob)
    df.createOrReplaceTempView(name)
    return df


def boxed(spark: SparkSession, paths: list[str] | str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows whose ``bbox`` struct meets a box; the nested bounds reach the Parquet
    scan, so row groups outside are skipped."""
    b = F.col("bbox")
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths)).where((b["xmin"] <= east) & (b["xmax"] >= west) & (b["ymin"] <= north) & (b["ymax"] >= south))


def items_in_box(items: DataFrame, west: float, south: float, east: float, north: float) -> list[str]:
    """Files of a catalogue (href, west, south, east, north) that meet a box: one
    row a file, so the list is small."""
    return [r[0] for r in items.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)).select("href").distinct().sort("href").collect()]


#: Columns of the timetable tables, all strings.
GTFS = {
    "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
    "routes": ["route_id", "route_type"],
    "trips": ["route_id", "service_id", "trip_id", "direction_id"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon", "parent_station"],
    "stop_times": ["trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time", "pickup_type"],
    "frequencies": ["trip_id", "start_time", "end_time", "headway_secs", "exact_times"],
}


def timetable(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A feed's table with trimmed names and the known columns (null where absent);
    None where the feed does not have the file."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.csv(f"{folder}/{name}.txt", header=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition()):
            return None
        raise
    df = df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])
    return df.select(*[F.trim(F.col(c)).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in GTFS[name]])


def fixes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("timestamp timestamp, latitude double, longitude double, accuracy double").csv(path, header=True)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """geometry (WKB) and properties (map) of the features of GeoJSON files."""
    f = spark.read.schema("features array<struct<geometry:string,properties:map<string,string>>>").json(path, multiLine=True)
    return f.select(F.explode("features").alias("f")).select(_geojson_wkb("f.geometry").alias("geometry"), "f.properties")


def geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """geometry (WKB) and properties (map) of files with one GeoJSON feature a line."""
    f = spark.read.schema("geometry string, properties map<string,string>").json(path)
    return f.select(_geojson_wkb("geometry").alias("geometry"), "properties")


@F.pandas_udf(T.BinaryType())
def _geojson_wkb(text: pd.Series) -> pd.Series:
    def one(g):
        kind, c = g["type"], g["coordinates"]
        if kind == "Point":
            return struct.pack("<BIdd", 1, 1, *c[:2])
        if kind == "LineString":
            return line_wkb(np.array(c, float)[:, :2])
        if kind == "Polygon":
            return polygon_wkb([np.array(r, float)[:, :2] for r in c])
        inner = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}[kind]
        return struct.pack("<BII", 1, {"MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}[kind], len(c)) + b"".join(one({"type": inner, "coordinates": x}) for x in c)

    return text.map(lambda t: None if t is None else one(json.loads(t)))


def osm_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lat, lon, tags) and segments (way, tags, a, b): consecutive nodes of
    each way of Overpass JSON."""
    e = spark.read.schema("elements array<struct<type:string,id:long,lat:double,lon:double,nodes:array<long>,tags:map<string,string>>>").json(path, multiLine=True)
    e = e.select(F.explode("elements").alias("e")).select("e.*")
    ways = e.where("type = 'way' and size(nodes) > 1")
    pairs = F.explode(F.arrays_zip(F.slice("nodes", 1, F.size("nodes") - 1).alias("a"), F.slice("nodes", 2, F.size("nodes") - 1).alias("b")))
    return e.where("type = 'node'").select("id", "lat", "lon", "tags"), ways.select(F.col("id").alias("way"), "tags", pairs.alias("p")).select("way", "tags", "p.a", "p.b")


def placed_ways(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Ways (id, refs) at the mean place of their nodes (id, lat, lon)."""
    refs = ways.select(F.col("id").alias("way"), F.explode("refs").alias("id"))
    return refs.join(nodes.select("id", "lat", "lon"), "id").groupBy("way").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).withColumnRenamed("way", "id")


def footprints(spark: SparkSession, path: str) -> DataFrame:
    """Building footprints in JSON lines: height and confidence of -1 are null."""
    d = spark.read.schema("geometry string, properties struct<height:double,confidence:double>").json(path)
    nothing = lambda c: F.nullif(F.col(f"properties.{c}"), F.lit(-1.0)).alias(c)
    return d.select(_geojson_wkb("geometry").alias("geometry"), nothing("height"), nothing("confidence"))


def decoded(spark: SparkSession, path: str, decode: Callable[[bytes], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Rows that ``decode`` yields for the content of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for content in df.content:
                yield from decode(bytes(content))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def _las(content: bytes, chunk: int = 500_000) -> Iterator[pd.DataFrame]:
    if content[:4] != b"LASF":
        raise ValueError("not a LAS file")
    start, kind, size, count = struct.unpack_from("<IxxxxBHI", content, 96)
    if content[25] >= 4 and not count:
        count = struct.unpack_from("<Q", content, 247)[0]
    scale, offset = struct.unpack_from("<3d", content, 131), struct.unpack_from("<3d", content, 155)
    at = 15 if kind < 6 else 16
    raw = np.frombuffer(content, np.uint8, count * size, start).reshape(count, size)
    for s in range(0, count, chunk):
        p = raw[s : s + chunk]
        xyz = np.ascontiguousarray(p[:, :12]).view("<i4") * np.array(scale) + np.array(offset)
        yield pd.DataFrame({"x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "class": (p[:, at] & (31 if kind < 6 else 255)).astype("int32")})


def las(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark, path, _las, "x double, y double, z double, class int")


def geopackage(spark: SparkSession, path: str, layer: str, columns: list[str], where: str = "1 = 1", geometry: str = "geom") -> DataFrame:
    """geometry (WKB) and columns (strings) of a GeoPackage layer, in batches."""
    names = ", ".join(f'"{c}"' for c in columns)

    def read(content: bytes) -> Iterator[pd.DataFrame]:
        db = sqlite3.connect(":memory:")
        db.deserialize(content)
        rows = db.execute(f'SELECT "{geometry}"{", " + names if columns else ""} FROM "{layer}" WHERE {where}')
        while part := rows.fetchmany(25_000):
            wkb = [None if r[0] is None else r[0][8 + (0, 32, 48, 48, 64)[r[0][3] >> 1 & 7] :] for r in part]
            yield pd.DataFrame({"geometry": wkb, **{c: [None if r[k + 1] is None else str(r[k + 1]) for r in part] for k, c in enumerate(columns)}})

    return decoded(spark, path, read, ", ".join(["geometry binary", *[f"`{c}` string" for c in columns]]))


def _shapes(content: bytes) -> Iterator[pd.DataFrame]:
    at, out, n = 100, [], 0
    while at < len(content):
        number, words = struct.unpack_from(">II", content, at)
        body = content[at + 8 : at + 8 + 2 * words]
        kind = struct.unpack_from("<I", body)[0] % 10
        if kind == 1:
            g = struct.pack("<BI", 1, 1) + body[4:20]
        elif kind in (3, 5):
            parts, points = struct.unpack_from("<II", body, 36)
            cuts = [*struct.unpack_from(f"<{parts}I", body, 44), points]
            xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
            rings = [xy[a:b] for a, b in zip(cuts, cuts[1:])]
            if kind == 3:
                g = struct.pack("<BII", 1, 5, len(rings)) + b"".join(map(line_wkb, rings))
            else:  # an outer ring runs clockwise and is followed by its holes
                groups: list[list[np.ndarray]] = []
                for r in rings:
                    area = float(r[:-1, 0] @ r[1:, 1] - r[1:, 0] @ r[:-1, 1])
                    if area <= 0 or not groups:
                        groups.append([r])
                    else:
                        groups[-1].append(r)
                g = struct.pack("<BII", 1, 6, len(groups)) + b"".join(map(polygon_wkb, groups))
        else:
            g = None
        out.append((number, g))
        at += 8 + 2 * words
    yield pd.DataFrame(out, columns=["number", "geometry"])


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """number and geometry (WKB) of .shp files; attributes come from their .dbf."""
    return decoded(spark, path, _shapes, "number int, geometry binary")


def _tiff(content: bytes, window: tuple[int, int, int, int] | None) -> Iterator[pd.DataFrame]:
    e = "<" if content[:2] == b"II" else ">"
    at = struct.unpack_from(e + "I", content, 4)[0]
    size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8}
    tags = {}
    for k in range(struct.unpack_from(e + "H", content, at)[0]):
        tag, kind, n = struct.unpack_from(e + "HHI", content, at + 2 + 12 * k)
        where = at + 10 + 12 * k
        if n * size.get(kind, 1) > 4:
            where = struct.unpack_from(e + "I", content, where)[0]
        tags[tag] = content[where : where + n].rstrip(b"\0").decode() if kind == 2 else struct.unpack_from(f"{e}{n}{ {1: 'B', 3: 'H', 4: 'I', 11: 'f', 12: 'd'}.get(kind, 'B') }", content, where)
    width, height, bits = tags[256][0], tags[257][0], tags[258][0]
    dtype = np.dtype({1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]] + str(bits // 8)).newbyteorder(e)
    per = tags.get(278, (height,))[0]
    deflate = tags.get(259, (1,))[0]
    if deflate not in (1, 8, 32946) or 322 in tags:
        raise ValueError("only striped rasters, plain or deflated, are read")
    nodata = float(tags[42113]) if 42113 in tags else None
    x0, y0, dx, dy = 0.0, 0.0, 1.0, -1.0
    if 33922 in tags:
        x0, y0, dx, dy = tags[33922][3], tags[33922][4], tags[33550][0], -tags[33550][1]
    r0, c0, r1, c1 = window or (0, 0, height, width)
    for k, (o, n) in enumerate(zip(tags[273], tags[279])):
        lo, hi = k * per, min(height, (k + 1) * per)
        if hi <= r0 or lo >= r1:
            continue
        data = content[o : o + n]
        v = np.frombuffer(zlib.decompress(data) if deflate != 1 else data, dtype, (hi - lo) * width).reshape(-1, width)
        rows, cols = np.arange(max(lo, r0), min(hi, r1)), np.arange(c0, min(c1, width))
        v = v[rows - lo][:, cols].astype(float)
        r, c = np.meshgrid(rows, cols, indexing="ij")
        good = np.isfinite(v) & (v != nodata if nodata is not None else True)
        yield pd.DataFrame({"row": r.ravel(), "col": c.ravel(), "x": (x0 + (c + 0.5) * dx).ravel(), "y": (y0 + (r + 0.5) * dy).ravel(), "value": np.where(good, v, np.nan).ravel(), "valid": good.ravel()})


def raster(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Cells (row, col, x, y, value, valid) of a GeoTIFF window; nodata is null and
    not valid, never zero."""
    d = decoded(spark, path, lambda c: _tiff(c, window), "row long, col long, x double, y double, value double, valid boolean")
    return d.withColumn("value", F.when(F.col("valid"), F.col("value")))


def spreadsheet(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """Rows of a sheet as strings c0, c1, ...; a sheet is small and read on the driver."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    z = zipfile.ZipFile(BytesIO(bytes(content)))
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", ns)) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", ns)] if "xl/sharedStrings.xml" in z.namelist() else []
    rows = []
    for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iterfind(".//m:row", ns):
        cells = {}
        for c in row.iterfind("m:c", ns):
            letters, k = "".join(x for x in c.get("r") if x.isalpha()), 0
            for x in letters:
                k = k * 26 + ord(x) - 64
            v, inline = c.find("m:v", ns), c.find("m:is", ns)
            text = "".join(t.text or "" for t in inline.iterfind(".//m:t", ns)) if inline is not None else None if v is None else v.text
            cells[k - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
        rows.append(cells)
    width = max((max(r) + 1 for r in rows if r), default=1)
    return spark.createDataFrame([tuple(r.get(k) for k in range(width)) for r in rows], ", ".join(f"c{k} string" for k in range(width)))
