"""Readers on small files made here, sinks, checkpoints and streams."""

import sqlite3
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrolith.functions import geometry as G
from metrolith.sources import readers as R
from metrolith.sources import writers as W
from metrolith.streaming import windows


def test_las(spark, tmp_path):
    n = 5
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = b"\x01\x02"
    struct.pack_into("<IxxxxBHI", head, 96, 227, 0, 20, n)
    struct.pack_into("<3d3d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    points = b"".join(struct.pack("<iiiHBBbBH", 100 * k, 200 * k, 300 * k, 0, 0, 2 if k % 2 else 6, 0, 0, 0) for k in range(n))
    (tmp_path / "a.las").write_bytes(bytes(head) + points)
    got = R.las(spark, str(tmp_path / "a.las")).orderBy("x").collect()
    assert [(round(r.x, 2), round(r.z, 2), r["class"]) for r in got] == [(100 + k, 3.0 * k, 2 if k % 2 else 6) for k in range(n)]


@pytest.mark.parametrize("deflate", [False, True])
def test_raster_window(spark, tmp_path, deflate):
    v = np.arange(12, dtype="<f4").reshape(3, 4)
    v[1, 1] = -9
    data = zlib.compress(v.tobytes()) if deflate else v.tobytes()
    tags = [(256, 3, [4]), (257, 3, [3]), (258, 3, [32]), (259, 3, [8 if deflate else 1]), (273, 4, [8]), (278, 3, [3]), (279, 4, [len(data)]), (339, 3, [3]), (33550, 12, [10.0, 10.0, 0.0]), (33922, 12, [0, 0, 0, 500.0, 900.0, 0.0]), (42113, 2, b"-9\0")]
    at = 8 + len(data)
    extra_at, extra, entries = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, values in tags:
        raw = values if kind == 2 else struct.pack(f"<{len(values)}" + {3: "H", 4: "I", 12: "d"}[kind], *values)
        count = len(raw) if kind == 2 else len(values)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, kind, count, extra_at + len(extra))
            extra += raw
        else:
            entries += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
    (tmp_path / "a.tif").write_bytes(b"II" + struct.pack("<HI", 42, at) + data + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + extra)
    got = {(r.row, r.col): r for r in R.raster(spark, str(tmp_path / "a.tif"), (1, 0, 3, 2)).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (2, 1)}
    assert got[1, 1]["value"] is None and not got[1, 1].valid and got[2, 1]["value"] == 9.0 and (got[2, 0].x, got[2, 0].y) == (505.0, 875.0)


def test_geopackage(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.gpkg")
    db.execute("CREATE TABLE lots (geom BLOB, code TEXT)")
    db.execute("INSERT INTO lots VALUES (?, '007')", (b"GP\0\x01" + struct.pack("<I", 31983) + G.box(0, 0, 2, 3),))
    db.execute("INSERT INTO lots VALUES (?, '008')", (b"GP\0\x03" + struct.pack("<I", 31983) + struct.pack("<4d", 0, 1, 0, 1) + G.box(0, 0, 1, 1),))
    db.commit()
    db.close()
    got = R.geopackage(spark, str(tmp_path / "a.gpkg"), "lots", ["code"]).orderBy("code").collect()
    assert [(r.code, G.area(G.parts(bytes(r.geometry)))) for r in got] == [("007", 6.0), ("008", 1.0)]


def test_shapefile(spark, tmp_path):
    ring = np.array([[0, 0], [0, 3], [2, 3], [2, 0], [0, 0]], "<f8")
    body = struct.pack("<I4d", 5, 0, 0, 2, 3) + struct.pack("<II", 1, len(ring)) + struct.pack("<I", 0) + ring.tobytes()
    (tmp_path / "a.shp").write_bytes(bytes(100) + struct.pack(">II", 1, len(body) // 2) + body)
    r = R.shapefile(spark, str(tmp_path / "a.shp")).first()
    assert r.number == 1 and G.area(G.parts(bytes(r.geometry))) == 6.0


def test_spreadsheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>')
    assert tuple(R.spreadsheet(spark, str(tmp_path / "a.xlsx")).first()) == ("name", None, "7")


def test_strict_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;v\n007;1,5\n")
    r = R.strings(spark, str(tmp_path / "a.csv"), ["id", "v"], ";").first()
    assert tuple(r) == ("007", "1,5")
    (tmp_path / "b.csv").write_text("id;v\n1;2;3\n")
    with pytest.raises(Exception):
        R.strings(spark, str(tmp_path / "b.csv"), ["id", "v"], ";").collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "k long, v double")
    W.twins(df, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t.csv"), header=True).count() == spark.read.parquet(str(tmp_path / "t.parquet")).count() == 2
    with pytest.raises(ValueError):
        W.dump(str(tmp_path / "x.json"), {"a": float("nan")})
    with pytest.raises(ValueError, match="not published: complete"):
        W.publish(df, str(tmp_path / "p"), {"complete": F.count("v") == 2})
    assert not (tmp_path / "p").exists()
    assert W.content_hash(df) == W.content_hash(df.orderBy(F.col("k").desc())) != W.content_hash(df.limit(1))
    with pytest.raises(ValueError, match="changed"):
        W.accepted(df.limit(1), W.content_hash(df))
    track = spark.createDataFrame([("a", 1, 2.0, 3.0), ("a", 0, 1.0, 3.0), ("b", 0, 5.0, 6.0)], "s string, n int, lat double, lon double")
    assert W.gpx(track, "s", "n").count("<trk>") == 2


def test_stage_rebuilds_only_on_change(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(3)
    for signature in ("a", "a", "b"):
        assert W.stage(spark, str(tmp_path / "s"), signature, build).count() == 3
    assert len(built) == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, f"2024-01-01 0{k % 4}:{k % 60:02d}:00", k % 3, "view" if k % 2 else "click", float(k)) for k in range(120)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = windows.drained(spark, windows.tumbling(stream, "1 hour", "0 seconds"), str(tmp_path / "c"), str(tmp_path / "o"))
    want = {tuple(r) for r in windows.tumbling(df, "1 hour").collect()}
    got = {tuple(r) for r in out.collect()}
    assert got <= want and len(got) >= len(want) - 2  # the last window is still open
