"""Earth-centred coordinates, feeds by place, and round numbers for display."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the WGS84 ellipsoid
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563

# fixed values: boxes (west, south, east, north) of the continental detection feeds, the first one that holds a place serves it
FEEDS = (
    ("SouthEast_Asia", 90, -12, 145, 30),
    ("South_Asia", 60, 0, 92, 40),
    ("Australia_NewZealand", 110, -50, 180, -10),
    ("Europe", -25, 34, 45, 72),
    ("Africa", -20, -36, 55, 38),
    ("South_America", -82, -57, -34, 13),
    ("Central_America", -118, 7, -58, 33),
    ("North_America", -170, 14, -50, 80),
    ("Russia_Asia", 45, 40, 180, 78),
)


def geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Longitude, latitude (degrees) and height (metres) of a point in earth-centred metres, by one step of Bowring's method."""
    a, b = SEMI_MAJOR, SEMI_MAJOR * (1 - FLATTENING)
    e2, ep2 = 1 - (b / a) ** 2, (a / b) ** 2 - 1
    p = F.hypot(x, y)
    theta = F.atan2(z * a, p * b)
    s, c = F.sin(theta), F.cos(theta)
    lat = F.atan2(z + s * s * s * (ep2 * b), p - c * c * c * (e2 * a))
    n = a / F.sqrt(1 - F.sin(lat) * F.sin(lat) * e2)
    return F.degrees(F.atan2(y, x)), F.degrees(lat), p / F.cos(lat) - n


def earth_radius(lat: Column) -> Column:
    """Distance from the earth's centre to the ellipsoid at a latitude, in metres."""
    a, b = SEMI_MAJOR, SEMI_MAJOR * (1 - FLATTENING)
    c, s = F.cos(F.radians(lat)), F.sin(F.radians(lat))
    top = c * c * a**4 + s * s * b**4
    return F.sqrt(top / (c * c * a**2 + s * s * b**2))


def feed(lon: Column, lat: Column, feeds: Sequence[tuple[str, float, float, float, float]] = FEEDS) -> Column:
    """Name of the first feed whose box holds a place; NULL if none does."""
    out = None
    for name, w, s, e, n in feeds:
        inside = lon.between(w, e) & lat.between(s, n)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def nice_step(span: Column, most: int) -> Column:
    """A step of 1, 2 or 5 times a power of ten that cuts a span into at most `most` parts."""
    raw = span / most
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    part = raw / power
    return F.when(part <= 1, power).when(part <= 2, power * 2).when(part <= 5, power * 5).otherwise(power * 10)


def next_pass(newest: Column, today: Column, repeat: int) -> Column:
    """First pass after today, in whole repeats from the newest scene; that scene's own day if it is still to come."""
    steps = F.when(newest > today, 0).otherwise(F.floor(F.datediff(today, newest) / repeat).cast("int") + 1)
    return F.date_add(newest, steps * repeat)
