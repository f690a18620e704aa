"""Spatial joins and allocation.

Every join goes through a grid: both sides are dealt to the cells that their
boxes touch, meet by cell in an equi-join, and are refined by an exact test.
A pair is kept in one cell only, the one that holds the lower corner of the
boxes' intersection, so no distinct is needed. Geometry is WKB; kernels run over
Arrow batches of candidate pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from .relational import first_by

#: Type objects, not text: text is parsed by a session, and modules are imported without one.
_numbers = lambda *names: T.StructType([T.StructField(n, T.DoubleType()) for n in names])
_BOX = _numbers("x0", "y0", "x1", "y1")


@F.pandas_udf(_BOX)
def bounds_of(wkb: pd.Series) -> pd.DataFrame:
    known, box = G.rectangles(wkb.tolist())
    if known.all():
        return pd.DataFrame(box, columns=["x0", "y0", "x1", "y1"])
    return pd.DataFrame([tuple(r) if k else G.bounds(b) if b is not None else (None,) * 4 for k, r, b in zip(known, box.tolist(), wkb)], columns=["x0", "y0", "x1", "y1"])


@F.pandas_udf(T.BinaryType())
def box_of(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    return pd.Series([G.box(*v) for v in zip(x0, y0, x1, y1)])


@F.pandas_udf(T.DoubleType())
def area_of(wkb: pd.Series) -> pd.Series:
    known, box = G.rectangles(wkb.tolist())
    out = pd.Series((box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1]))
    for i in np.flatnonzero(~known):
        out[i] = np.nan if wkb.iloc[i] is None else G.area(G.parts(wkb.iloc[i]))
    return out


@F.pandas_udf(_numbers("area", "ln_area", "compactness", "elongation", "min_width"))
def shape_of(wkb: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([G.shape(G.parts(b)) for b in wkb])


@F.pandas_udf(T.DoubleType())
def overlap_of(a: pd.Series, b: pd.Series) -> pd.Series:
    (known, p), (other, q) = G.rectangles(a.tolist()), G.rectangles(b.tolist())
    out = np.maximum(np.minimum(p[:, 2:], q[:, 2:]) - np.maximum(p[:, :2], q[:, :2]), 0).prod(axis=1)
    for i in np.flatnonzero(~(known & other)):
        out[i] = G.overlap_area(G.parts(a.iloc[i]), G.parts(b.iloc[i]))
    return pd.Series(out)


@F.pandas_udf(T.IntegerType())
def side_of(x: pd.Series, y: pd.Series, wkb: pd.Series) -> pd.Series:
    """1 inside, 0 on the boundary, -1 outside; points of one polygon go together."""
    out = np.empty(len(x), int)
    for b, at in wkb.groupby(wkb).indices.items():
        out[at] = G.locate(np.stack([x.to_numpy()[at], y.to_numpy()[at]], axis=1), G.parts(b))
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def length_inside(line: pd.Series, polygon: pd.Series) -> pd.Series:
    return pd.Series([G.clipped_length(G.parts(a), G.parts(b)) for a, b in zip(line, polygon)], dtype=float)


def _cells(df: DataFrame, box: str, cell: float) -> DataFrame:
    along = lambda lo, hi: F.sequence(F.floor(F.col(f"{box}.{lo}") / cell), F.floor(F.col(f"{box}.{hi}") / cell))
    return df.withColumn("_cx", F.explode(along("x0", "x1"))).withColumn("_cy", F.explode(along("y0", "y1")))


def candidates(left: DataFrame, right: DataFrame, cell: float, geometry: str = "geometry") -> DataFrame:
    """Pairs whose boxes meet: all columns, the right geometry as ``geometry_r``.

    ``cell`` should be about the size of the larger objects; AQE splits a cell
    that holds very many."""
    a = _cells(left.withColumn("_l", bounds_of(geometry)), "_l", cell)
    b = _cells(right.withColumnRenamed(geometry, "geometry_r").withColumn("_r", bounds_of("geometry_r")), "_r", cell)
    j = a.join(b, ["_cx", "_cy"])
    x, y = F.greatest("_l.x0", "_r.x0"), F.greatest("_l.y0", "_r.y0")
    meet = (x <= F.least("_l.x1", "_r.x1")) & (y <= F.least("_l.y1", "_r.y1"))
    return j.where(meet & (F.floor(x / cell) == F.col("_cx")) & (F.floor(y / cell) == F.col("_cy"))).drop("_cx", "_cy", "_l", "_r")


def points_in(points: DataFrame, polygons: DataFrame, cell: float, x: str = "x", y: str = "y", geometry: str = "geometry", boundary: bool = True) -> DataFrame:
    """Points with each polygon that holds them (on the boundary too, unless not)."""
    p = points.withColumn("_cx", F.floor(F.col(x) / cell)).withColumn("_cy", F.floor(F.col(y) / cell))
    b = _cells(polygons.withColumn("_r", bounds_of(geometry)), "_r", cell)
    j = p.join(b, ["_cx", "_cy"]).where(F.col(x).between(F.col("_r.x0"), F.col("_r.x1")) & F.col(y).between(F.col("_r.y0"), F.col("_r.y1")))
    j = j.withColumn("_side", side_of(F.col(x).cast("double"), F.col(y).cast("double"), F.col(geometry)))
    return j.where(F.col("_side") >= (0 if boundary else 1)).drop("_cx", "_cy", "_r", "_side", geometry)


def assign_points(points: DataFrame, key: str, polygons: DataFrame, unit: str, cell: float, nearest_m: float | None = None) -> DataFrame:
    """Each point with the lowest unit that holds it, null outside; with
    ``nearest_m``, outside points take the nearest unit within that distance."""
    inside = points_in(points.select(key, "x", "y"), polygons.select(unit, "geometry"), cell).groupBy(key).agg(F.min(unit).alias(unit))
    out = points.join(inside, key, "left")
    if nearest_m is None:
        return out
    lost = out.where(F.col(unit).isNull()).drop(unit)
    grown = polygons.select(unit, "geometry").withColumn("_r", bounds_of("geometry"))
    grown = grown.withColumn("_r", F.struct((F.col("_r.x0") - nearest_m).alias("x0"), (F.col("_r.y0") - nearest_m).alias("y0"), (F.col("_r.x1") + nearest_m).alias("x1"), (F.col("_r.y1") + nearest_m).alias("y1")))
    near = lost.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell)).join(_cells(grown, "_r", cell), ["_cx", "_cy"])
    near = near.withColumn("_d", distance_to(F.col("x").cast("double"), F.col("y").cast("double"), F.col("geometry"))).where(F.col("_d") <= nearest_m)
    found = first_by(near.select(key, unit, "_d"), [key], F.col("_d"), F.col(unit)).select(key, unit)
    return out.where(F.col(unit).isNotNull()).unionByName(lost.join(found, key, "left"))


@F.pandas_udf(T.DoubleType())
def distance_to(x: pd.Series, y: pd.Series, wkb: pd.Series) -> pd.Series:
    """Distance to the boundary or line of a geometry."""
    out = []
    for px, py, b in zip(x, y, wkb):
        a, z = G.edges(G.parts(b))
        v, m = z - a, np.array([px, py]) - a
        t = np.clip(np.einsum("ij,ij->i", v, m) / np.maximum(np.einsum("ij,ij->i", v, v), G.EPS), 0, 1)
        out.append(float(np.hypot(*(m - t[:, None] * v).T).min()))
    return pd.Series(out)


def within(a: DataFrame, b: DataFrame, radius: float, ax: str = "x", ay: str = "y", bx: str = "x2", by: str = "y2") -> DataFrame:
    """Pairs of points at most ``radius`` apart, with ``dist``: ``b`` is dealt to the
    nine cells around each of its points."""
    p = a.withColumn("_cx", F.floor(F.col(ax) / radius)).withColumn("_cy", F.floor(F.col(ay) / radius))
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    q = b.withColumn("_cx", F.explode(F.transform(near, lambda i: F.floor(F.col(bx) / radius) + i))).withColumn("_cy", F.explode(F.transform(near, lambda i: F.floor(F.col(by) / radius) + i)))
    return p.join(q, ["_cx", "_cy"]).withColumn("dist", F.hypot(F.col(ax) - F.col(bx), F.col(ay) - F.col(by))).where(F.col("dist") <= radius).drop("_cx", "_cy")


def match_at_radii(pairs: DataFrame, key: str, same_name: Column, radii: list[float]) -> DataFrame:
    """any_<d> and named_<d>: has a candidate, or one of the same name, within d."""
    aggregates = [F.bool_or(F.col("dist") <= d).alias(f"any_{d:g}") for d in radii] + [F.bool_or((F.col("dist") <= d) & same_name).alias(f"named_{d:g}") for d in radii]
    return pairs.groupBy(key).agg(*aggregates)


def largest_overlap(objects: DataFrame, key: str, districts: DataFrame, unit: str, cell: float, tie: float = 0.0) -> DataFrame:
    """key, unit, inside (area), share of the object, candidates, tied: the district
    with the largest part of each object; within ``tie`` of it, the smallest id."""
    d = candidates(objects.select(key, "geometry"), districts.select(unit, "geometry"), cell)
    d = d.withColumn("inside", overlap_of("geometry", "geometry_r")).where("inside > 0").withColumn("share", F.col("inside") / area_of("geometry"))
    w = Window.partitionBy(key)
    d = d.withColumn("_top", F.max("inside").over(w)).withColumn("candidates", F.count("*").over(w))
    d = d.where(F.col("inside") >= F.col("_top") - tie).withColumn("tied", F.count("*").over(w) > 1)
    best = first_by(d, [key], F.col(unit)).select(key, unit, "inside", "share", "candidates", "tied")
    return objects.select(key).join(best, key, "left").na.fill(0.0, ["inside"])


def allocate(blocks: DataFrame, block: str, districts: DataFrame, unit: str, masses: list[str], cell: float) -> DataFrame:
    """block, unit, weight and masses by share of the block's area; what no district
    covers stays outside. Weights of a block above 1 (districts that overlap) are
    an error."""
    pieces = candidates(blocks.select(block, "geometry", *masses), districts.select(unit, "geometry"), cell)
    pieces = pieces.withColumn("weight", overlap_of("geometry", "geometry_r") / area_of("geometry")).where("weight > 0")
    total = F.sum("weight").over(Window.partitionBy(block))
    pieces = pieces.withColumn("_total", total)
    ok = F.when(F.col("_total") <= 1 + 1e-8, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("allocation above 1 for block "), F.col(block).cast("string"))).cast("boolean"))
    return pieces.where(ok).select(block, unit, "weight", *[(F.col(m) * F.col("weight")).alias(m) for m in masses])


def allocate_jobs(pieces: DataFrame, block: str, jobs: str, support: str, area: str, epsilon: float = 1e-6) -> DataFrame:
    """Jobs of a block shared by support, or by area where the support is empty; the
    sum over a block is its jobs. Negative jobs are an error."""
    w = Window.partitionBy(block)
    checked = F.when(F.col(jobs) >= 0, F.col(jobs)).otherwise(F.raise_error(F.lit("jobs are negative")).cast("double"))
    p = pieces.withColumn("_s", F.sum(support).over(w)).withColumn("_a", F.sum(area).over(w)).withColumn("fallback", F.col("_s") <= epsilon)
    denominator = F.when(F.col("fallback"), F.col("_a")).otherwise(F.col("_s"))
    share = F.when(F.col("fallback"), F.col(area)).otherwise(F.col(support)) / denominator
    return p.withColumn("denominator", denominator).withColumn("allocated", checked * share).drop("_s", "_a")


def clip_lengths(lines: DataFrame, keys: list[str], units: DataFrame, unit: str, cell: float) -> DataFrame:
    """Length of lines inside each unit, by keys; stretches on a shared boundary
    count in both units."""
    d = candidates(lines.select(*keys, "geometry"), units.select(unit, "geometry"), cell)
    return d.withColumn("_m", length_inside("geometry", "geometry_r")).where("_m > 0").groupBy(unit, *keys).agg(F.sum("_m").alias("length_m"))


def tiled(df: DataFrame, tile: float | None) -> DataFrame:
    """Rows at each tile (_cx, _cy) that their geometry's box touches; all at one without a size."""
    if tile is None:
        return df.withColumn("_cx", F.lit(0)).withColumn("_cy", F.lit(0))
    return _cells(df.withColumn("_l", bounds_of("geometry")), "_l", tile).drop("_l")


def tile_box(key: tuple, tile: float | None) -> tuple[float, float, float, float] | None:
    """The box of a tile, from a key that ends with _cx and _cy."""
    x, y = key[-2:]
    return None if tile is None else (x * tile, y * tile, (x + 1) * tile, (y + 1) * tile)


def union_coverage(buildings: DataFrame, units: DataFrame, unit: str, tile: float, land: DataFrame | None = None) -> DataFrame:
    """covered_m2 and summed_m2 of footprints by unit, tile by tile: what lies in a tile and
    a unit is united, so no union is larger than what a tile holds; equal footprints go
    as one row and their number. Units that no footprint's box enters have no row. With
    ``land`` (unit, geometry; polygons that don't overlap) also on_land_m2."""
    b = buildings.groupBy("geometry").agg(F.count("*").alias("_n"))
    b = candidates(b, units.select(unit, "geometry", bounds_of("geometry").alias("_u")), tile)
    b = _cells(b.withColumn("_l", bounds_of("geometry")), "_l", tile)
    enters = lambda lo, hi, c: F.greatest(f"_l.{lo}", f"_u.{lo}", F.col(c) * tile) < F.least(f"_l.{hi}", f"_u.{hi}", (F.col(c) + 1) * tile)
    b = b.where(enters("x0", "x1", "_cx") & enters("y0", "y1", "_cy")).drop("_l", "_u").withColumn("_land", F.lit(False))
    if land is not None:
        #: land meets the buildings in the tiles that hold some
        own = land.select(unit, "geometry").join(units.select(unit, F.col("geometry").alias("geometry_r")), unit).withColumn("_n", F.lit(1).cast("long"))
        own = tiled(own, tile).withColumn("_land", F.lit(True))
        own = own.join(b.select(unit, "_cx", "_cy").distinct(), [unit, "_cx", "_cy"], "left_semi")
        b = b.unionByName(own)

    def unite(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at, (plain, ub) = tile_box(key, tile), G.rectangles([rows.geometry_r.iloc[0]])
        ub = ub[0].tolist() if plain[0] else G.bounds(rows.geometry_r.iloc[0])
        box = (max(at[0], ub[0]), max(at[1], ub[1]), min(at[2], ub[2]), min(at[3], ub[3]))
        ground, n = rows._land.to_numpy(bool), rows._n.to_numpy()
        known, r = G.rectangles(rows.geometry.tolist())
        #: buildings are 1, land is 2, the unit is 4, unless it's a rectangle, which the box is cut to
        wkbs, owners = rows.geometry.tolist(), np.where(ground, 2, 1)
        if not plain[0]:
            known[:] = False
            whole = G.parts(rows.geometry_r.iloc[0])
            wkbs, owners = [*wkbs, rows.geometry_r.iloc[0]], np.append(owners, 4)
        i = known & ~ground
        summed = float((np.maximum(np.minimum(r[i, 2:], box[2:]) - np.maximum(r[i, :2], box[:2]), 0).prod(axis=1) * n[i]).sum())
        for k in np.flatnonzero(~known & ~ground):
            p = G.parts(wkbs[k])
            if plain[0]:
                part = G.area([c for c in (G.clip_to_box(c, *box) for c in p) if len(c) > 3])
            else:
                c = G.bounds(wkbs[k])
                area, both, _ = G.cover([p, whole], np.arange(2), (max(box[0], c[0]), max(box[1], c[1]), min(box[2], c[2]), min(box[3], c[3])))
                part = area[both == 2].sum()
            summed += n[k] * float(part)
        area, _, ids = G.cover_edges(*G.edge_table(wkbs), owners, box)
        if not plain[0]:
            area, ids = area[ids >= 4], ids[ids >= 4] - 4
        return pd.DataFrame({unit: [key[0]], "covered_m2": [area[(ids == 1) | (ids == 3)].sum()], "summed_m2": [summed], "on_land_m2": [area[ids == 3].sum()]})

    kind = units.schema[unit].dataType.simpleString()
    sums = [F.sum(c).alias(c) for c in ("covered_m2", "summed_m2", *(["on_land_m2"] if land is not None else []))]
    return b.groupBy(unit, "_cx", "_cy").applyInPandas(unite, f"{unit} {kind}, covered_m2 double, summed_m2 double, on_land_m2 double").groupBy(unit).agg(*sums)


def grid_population(pieces: DataFrame, key: str, mass: str, step: float) -> DataFrame:
    """key, cx, cy, x, y, weight: the mass of each piece over grid cells, by area, at
    the cell's part's middle; the weights of a piece sum to its mass."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for k, m, wkb in zip(df[key], df[mass], df.geometry):
                rings = G.parts(wkb)
                total = G.area(rings)
                x0, y0, x1, y1 = G.bounds(wkb)
                for cx in range(int(x0 // step), int(-(-x1 // step))):
                    for cy in range(int(y0 // step), int(-(-y1 // step))):
                        part = [c for c in (G.clip_to_box(r, cx * step, cy * step, (cx + 1) * step, (cy + 1) * step) for r in rings) if len(c) > 3]
                        a = G.area(part)
                        if a > G.EPS:
                            mid = np.concatenate([c[:-1] for c in part]).mean(axis=0)
                            rows.append((k, cx, cy, mid[0], mid[1], m * a / total))
            yield pd.DataFrame(rows, columns=[key, "cx", "cy", "x", "y", "weight"])

    kind = pieces.schema[key].dataType.simpleString()
    return pieces.select(key, mass, "geometry").mapInPandas(cut, f"{key} {kind}, cx long, cy long, x double, y double, weight double")


def raster_summary(cells: DataFrame, unit: str, extensive: bool) -> DataFrame:
    """Unit totals of (value, valid, overlap_m2, cell_area_m2, support_area_m2):
    mass of valid cells by overlapped share (extensive) or mean by overlap; nodata
    is never zero, and a total is withheld where support is incomplete."""
    v, o = F.col("value"), F.col("overlap_m2")
    ok = (o >= 0) & (o <= F.col("cell_area_m2") + 1e-6) & (F.col("support_area_m2") > 0) & (~F.col("valid") | ~F.isnan(v))
    c = cells.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a raster cell is inconsistent")).cast("boolean")))
    use = F.col("valid")
    g = c.groupBy(unit).agg(
        F.sum(F.when(use, v * o / F.col("cell_area_m2"))).alias("mass"),
        F.sum(F.when(use, v * o)).alias("_vo"),
        F.coalesce(F.sum(F.when(use, o)), F.lit(0.0)).alias("valid_m2"),
        F.coalesce(F.sum(F.when(~use, o)), F.lit(0.0)).alias("nodata_m2"),
        F.coalesce(F.sum(F.when(use & (v == 0), o)), F.lit(0.0)).alias("zero_m2"),
        F.sum(o).alias("_all"),
        F.max("support_area_m2").alias("support_m2"),
    )
    g = g.where(F.when(F.col("_all") <= F.col("support_m2") * (1 + 1e-9), F.lit(True)).otherwise(F.raise_error(F.lit("overlap exceeds the support")).cast("boolean")))
    mean = F.try_divide(F.col("_vo"), F.col("valid_m2"))
    complete = F.col("valid_m2") >= F.col("support_m2") * (1 - 1e-9)
    return g.select(unit, (F.when(complete, F.col("mass")) if extensive else mean).alias("value"), "mass", "valid_m2", "nodata_m2", "zero_m2", (F.col("support_m2") - F.col("_all")).alias("outside_m2"), (F.col("valid_m2") / F.col("support_m2")).alias("valid_fraction"))


def by_group(df: DataFrame, keys: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A geometry kernel over the rows of each key (a block, a tile, a unit)."""
    return df.groupBy(*keys).applyInPandas(kernel, schema)


def exclusive_category_areas(polygons: DataFrame, unit: str, category: str, land: DataFrame | None = None, tile: float | None = None) -> DataFrame:
    """unit, category, area: the area that a category alone covers (on ``land(unit,
    geometry)``, if given); what two or more contest is under '(contested)'. With
    ``tile`` a unit's polygons are dealt to tiles of that size, so no kernel holds more
    than a tile; equal polygons of a category go once."""
    polygons = polygons.select(unit, category, "geometry", F.lit(False).alias("_land"))
    on_land = land is not None
    if on_land:
        polygons = polygons.where(F.col(category).isNotNull()).unionByName(land.select(unit, F.lit(None).cast("string").alias(category), "geometry", F.lit(True).alias("_land")))

    def kernel(key, df: pd.DataFrame) -> pd.DataFrame:
        df = df[df._land | df[category].notna()]
        owner, names = pd.factorize(df[category])  # land is -1
        ground = len(names)
        area, n, ids = G.cover([G.parts(g) for g in df.geometry], np.where(owner < 0, ground << 32, owner), tile_box(key, tile))
        if on_land:
            on = ids >= ground << 32 if ground else np.zeros(len(ids), bool)
            area, n, ids = area[on], n[on] - 1, ids[on] - (ground << 32)
        alone = np.bincount(ids[n == 1], area[n == 1], minlength=ground)
        rows = [(key[0], c, a) for c, a in zip(names, alone.tolist())] + [(key[0], "(contested)", float(area[n > 1].sum()))]
        return pd.DataFrame(rows, columns=[unit, category, "area"])

    kind = polygons.schema[unit].dataType.simpleString()
    parts = by_group(tiled(polygons.distinct(), tile), [unit, "_cx", "_cy"], kernel, f"{unit} {kind}, {category} string, area double")
    return parts.groupBy(unit, category).agg(F.sum("area").alias("area"))


def near_fraction(lines: DataFrame, key: str, others: DataFrame, spacing: float, distances: list[float]) -> DataFrame:
    """key, near_<d>: length-weighted share of each line within d of the others. A sample
    is named by its line (of a key that occurs once), part and place."""

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = [pd.DataFrame({key: k, "_p": n, "_i": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "m": m}) for k, g in zip(df[key], df.geometry) for n, (p, m) in enumerate(G.sample_line(line, spacing) for line in G.parts(g))]
            yield pd.concat(out) if out else pd.DataFrame({key: [], "_p": [], "_i": [], "x": [], "y": [], "m": []})

    kind = lines.schema[key].dataType.simpleString()
    top = max(distances)
    s = lines.select(key, "geometry").mapInPandas(sample, f"{key} {kind}, _p int, _i int, x double, y double, m double")
    grown = others.select("geometry").withColumn("_r", bounds_of("geometry"))
    grown = grown.withColumn("_r", F.struct(*[(F.col(f"_r.{c}") + (top if c[1] == "1" else -top)).alias(c) for c in ("x0", "y0", "x1", "y1")]))
    cell = top * 4
    near = s.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell)).join(_cells(grown, "_r", cell), ["_cx", "_cy"], "left")
    near = near.withColumn("_d", F.when(F.col("geometry").isNotNull(), distance_to("x", "y", F.coalesce("geometry", F.lit(G.box(0, 0, 1, 1))))))
    best = near.groupBy(key, "_p", "_i", "m").agg(F.min("_d").alias("_d"))
    return best.groupBy(key).agg(*[(F.sum(F.when(F.col("_d") <= d, F.col("m")).otherwise(0.0)) / F.sum("m")).alias(f"near_{d:g}") for d in distances])
