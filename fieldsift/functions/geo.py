"""Geometry, cell and scoring expressions on columns; no UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth diameter of the haversine, metres per degree of the local frame, metres per mile, cell size.
DIAMETER = 12_742_000.0
METRES_LON, METRES_LAT = 111_320.0, 110_540.0
MILE = 1609.344
CELL = 0.2
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def half_up(value: Column, digits: int = 3) -> Column:
    """Rounds half toward plus infinity."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / F.lit(scale)


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle metres between two points; null where a coordinate is (least alone would skip it)."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.when((lon1 + lat1 + lon2 + lat2).isNotNull(), DIAMETER * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Initial bearing in degrees, 0 to below 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def compass(degrees: Column) -> Column:
    """One of eight compass points."""
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.floor(degrees / 45.0 + 0.5) % 8 + 1).cast("int"))


def radius_bounds(lon: float, lat: float, miles: float) -> tuple[float, float, float, float]:
    """West, south, east and north of the box around a circle."""
    metres = miles * MILE
    dy, dx = metres / METRES_LAT, metres / (METRES_LON * math.cos(math.radians(lat)))
    return lon - dx, lat - dy, lon + dx, lat + dy


def overlaps(west: Column, south: Column, east: Column, north: Column, box) -> Column:
    """The rows whose bounds meet the box; four comparisons that reach the Parquet scan."""
    w, s, e, n = (F.lit(x) if not isinstance(x, Column) else x for x in box)
    return (west <= e) & (east >= w) & (south <= n) & (north >= s)


def inside(west: Column, south: Column, east: Column, north: Column, box) -> Column:
    """The rows whose bounds lie in the box."""
    w, s, e, n = (F.lit(x) if not isinstance(x, Column) else x for x in box)
    return (west >= w) & (east <= e) & (south >= s) & (north <= n)


def padded(west: Column, south: Column, east: Column, north: Column, metres: float) -> tuple[Column, Column, Column, Column]:
    """Bounds widened by metres and a tenth, aware of latitude."""
    wide = metres * 1.1
    dy = wide / 110_000.0
    dx = wide / (METRES_LON * F.greatest(F.cos(F.radians((south + north) / 2)), F.lit(0.1)))
    return west - dx, south - dy, east + dx, north + dy


def cell_index(value: Column, size: float = CELL) -> Column:
    return F.floor(value / size).cast("long")


def cells(west: Column, south: Column, east: Column, north: Column, size: float = CELL) -> Column:
    """Array of (x, y) of the grid cells that the bounds meet."""
    xs, ys = F.sequence(cell_index(west, size), cell_index(east, size)), F.sequence(cell_index(south, size), cell_index(north, size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def cell_id(x: Column, y: Column) -> Column:
    return F.concat(x.cast("string"), F.lit("_"), y.cast("string"))


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:5070 metres of lon/lat: Albers equal-area conic on GRS80."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def q(s):
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m(p):
        return math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)

    p1, p2, p0, l0 = (math.radians(x) for x in (29.5, 45.5, 23.0, -96.0))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(math.sin(p2)) - q(math.sin(p1)))
    c = m(p1) ** 2 + n * q(math.sin(p1))
    rho0 = a * math.sqrt(c - n * q(math.sin(p0))) / n
    s = F.sin(F.radians(lat))
    qs = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = a * F.sqrt(c - n * qs) / n
    theta = n * (F.radians(lon) - l0)
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def albers_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Lon and lat of EPSG:5070 metres: latitude from the authalic series, then one Newton step."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) + math.atanh(e * s) / e)
    m2 = lambda s: (1 - s * s) / (1 - e2 * s * s)
    south, north, origin = (math.sin(math.radians(d)) for d in (29.5, 45.5, 23.0))
    n = (m2(south) - m2(north)) / (q(north) - q(south))
    c = m2(south) + n * q(south)
    down = F.lit(a * math.sqrt(c - n * q(origin)) / n) - y
    authalic = (c - F.pow(F.sqrt(x * x + down * down) * n / a, F.lit(2))) / n
    b = F.asin(authalic / q(1.0))
    series = b + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * b) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * b) + 761 * e2**3 / 45360 * F.sin(6 * b)
    s = F.sin(series)
    rest = authalic / (1 - e2) - s / (1 - e2 * s * s) + F.log((1 - e * s) / (1 + e * s)) / (2 * e)
    lat = series + F.pow(1 - e2 * s * s, F.lit(2)) / (2 * F.cos(series)) * rest
    return F.degrees(F.atan2(x, down) / n) - 96.0, F.degrees(lat)


def saturate(value: Column, scale: float) -> Column:
    """0 at 0, toward 1 as the value grows past scale."""
    return value / (value + scale)


def proximity(metres: Column, reach: float) -> Column:
    """1 at no distance, 0 from reach on and where the distance is missing."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - metres / reach), F.lit(0.0))


def name_key(name: Column) -> Column:
    """Lower-cased words of a road name, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
