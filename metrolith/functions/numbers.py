"""Number expressions: clocks, angles, frames, guarded transforms, headways."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"^(\d+):([0-5]\d):([0-5]\d)$"


def clock_seconds(c: Column, strict: bool = True) -> Column:
    """Seconds of HH:MM:SS, with hours beyond 24 as they are; another form is an
    error, or null if not ``strict``."""
    part = lambda i: F.split_part(c, F.lit(":"), F.lit(i)).try_cast("long")
    value = part(1) * 3600 + part(2) * 60 + part(3)
    bad = F.raise_error(F.concat(F.lit("not a clock time: "), c)).cast("long") if strict else F.lit(None).cast("long")
    return F.when(c.isNull(), F.lit(None).cast("long")).when(c.rlike(_CLOCK), value).otherwise(bad)


def guarded(c: Column, kind: str) -> Column:
    """log, log1p or identity; values outside the domain and non-finite ones are errors."""
    finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
    if kind == "log":
        return F.when(c.isNull(), None).when(finite & (c > 0), F.log(c)).otherwise(F.raise_error(F.lit("log of a value that isn't positive")).cast("double"))
    if kind == "log1p":
        return F.when(c.isNull(), None).when(finite & (c > -1), F.log1p(c)).otherwise(F.raise_error(F.lit("log1p of a value below -1")).cast("double"))
    if kind == "identity":
        return F.when(c.isNull(), None).when(finite, c.cast("double")).otherwise(F.raise_error(F.lit("a value isn't finite")).cast("double"))
    raise ValueError(f"no transform is named {kind}")


def clip(c: Column, cap: float = 3.0) -> Column:
    return F.greatest(F.least(c, F.lit(cap)), F.lit(-cap))


def angle_difference(a: Column, b: Column) -> Column:
    """a - b in [-180, 180)."""
    return F.pmod(a - b + 180, F.lit(360.0)) - 180


def bearing(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Great-circle bearing clockwise from north, in [0, 360)."""
    d = F.radians(lon1 - lon0)
    a, b = F.radians(lat0), F.radians(lat1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


class Frame:
    """A street's frame: u along its axis, v to the right of it."""

    def __init__(self, x0: float, y0: float, axis_deg: float):
        self.x0, self.y0 = x0, y0
        self.e, self.n = math.sin(math.radians(axis_deg)), math.cos(math.radians(axis_deg))

    def to_uv(self, x: Column, y: Column) -> tuple[Column, Column]:
        dx, dy = x - self.x0, y - self.y0
        return dx * self.e + dy * self.n, dx * self.n - dy * self.e

    def to_xy(self, u: Column, v: Column) -> tuple[Column, Column]:
        return self.x0 + u * self.e + v * self.n, self.y0 + u * self.n - v * self.e


#: Walking speed in metres a minute, and minutes of reliability allowance by mode.
WALK_M_PER_MIN = 80.0
RELIABILITY_MIN = {"bus": 2.0, "rail": 0.75, "metro": 0.75, "tram": 0.75}


def edf(distance_m: Column, per_hour: Column, mode: Column) -> Column:
    """Equivalent doorstep frequency: 30 over minutes of walk, wait and allowance."""
    allowance = F.create_map(*[F.lit(x) for kv in RELIABILITY_MIN.items() for x in kv])[mode]
    return 30.0 / (distance_m / WALK_M_PER_MIN + 30.0 / per_hour + allowance)


def banded(c: Column, edges: list[float], right: bool = True) -> Column:
    """Number of edges below the value (right-closed) or at and below it."""
    return sum((F.when(c > e if right else c >= e, 1).otherwise(0) for e in edges), F.lit(0))


def ranges_compatible(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Do [a, b] and [c, d] overlap, in either direction? An end of 0 is unknown
    and compatible with anything."""
    unknown = (a == 0) | (b == 0) | (c == 0) | (d == 0)
    return unknown | ((F.least(a, b) <= F.greatest(c, d)) & (F.least(c, d) <= F.greatest(a, b)))


def expected_departures(start: Column, end: Column, headway: Column, offset: Column, lo: Column, hi: Column) -> Column:
    """Continuous departures in [lo, hi) of a service that leaves every ``headway``
    seconds from start to end, seen ``offset`` seconds downstream."""
    return F.greatest(F.least(end + offset, hi) - F.greatest(start + offset, lo), F.lit(0)) / headway


def exact_departures(start: Column, end: Column, headway: Column, offset: Column, lo: Column, hi: Column) -> Column:
    """Number of k >= 0 with start + k * headway < end that pass in [lo, hi)."""
    first = F.greatest(F.ceil((lo - offset - start) / headway), F.lit(0))
    last = F.least(F.ceil((hi - offset - start) / headway), F.ceil((end - start) / headway))
    return F.greatest(last - first, F.lit(0)).cast("long")


def sensor_clock(t: Column, start: float, drift: float) -> Column:
    return t + start + t * drift


def quadkey_bounds(key: Column) -> Column:
    """struct(west, south, east, north) in degrees of a quadkey tile."""
    n = F.length(key)
    digit = lambda i: F.substr(key, i, F.lit(1)).cast("int")
    fold = lambda bit: F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("long"), lambda acc, i: acc * 2 + F.floor(digit(i) / bit) % 2)
    x, y, size = fold(1), fold(2), F.pow(F.lit(2.0), n)
    lat = lambda row: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * row / size))))
    return F.struct((x / size * 360 - 180).alias("west"), lat(y + 1).alias("south"), ((x + 1) / size * 360 - 180).alias("east"), lat(y).alias("north"))
