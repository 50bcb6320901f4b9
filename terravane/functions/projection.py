"""Transverse Mercator both ways as column expressions, by series in the third flattening that are exact to far below a millimetre within some thousand
kilometres of the central meridian; national grids and UTM are its parameters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import FLATTENING, SEMI_MAJOR

# fixed values: coefficients of powers of the third flattening n, from the lowest power that each term has; row j is the term of the angle 2 * j
FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
INVERSE = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)
#: From the conformal latitude to the geographic one.
LATITUDE = (
    (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675),
    (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945),
    (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    (4279 / 630, -332 / 35, -399572 / 14175),
    (4174 / 315, -144838 / 6237),
    (601676 / 22275,),
)


@dataclass(frozen=True)
class TransverseMercator:
    """Origin (degrees), scale at the central meridian, false easting and northing (metres), and the ellipsoid."""

    lon: float
    lat: float = 0.0
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0
    axis: float = SEMI_MAJOR
    flattening: float = FLATTENING

    @property
    def n(self) -> float:
        return self.flattening / (2 - self.flattening)

    @property
    def radius(self) -> float:
        """Of the circle with a meridian's length, scaled."""
        n2 = self.n * self.n
        return self.scale * self.axis / (1 + self.n) * (1 + n2 / 4 + n2 * n2 / 64 + n2**3 / 256)

    def series(self, table: Sequence[Sequence[float]]) -> list[float]:
        return [sum(c * self.n ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(table, 1)]

    @property
    def origin(self) -> float:
        """Northing of the origin's latitude before the false northing."""
        e = math.sqrt(self.flattening * (2 - self.flattening))
        s = math.sin(math.radians(self.lat))
        chi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
        return self.radius * (chi + sum(a * math.sin(2 * j * chi) for j, a in enumerate(self.series(FORWARD), 1)))

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Easting and northing in metres of a place in degrees."""
        e = math.sqrt(self.flattening * (2 - self.flattening))
        s, away = F.sin(F.radians(lat)), F.radians(lon - self.lon)
        t = F.sinh(F.atanh(s) - F.atanh(s * e) * e)  # tangent of the conformal latitude
        u, v = F.atan2(t, F.cos(away)), F.asinh(F.sin(away) / F.hypot(t, F.cos(away)))
        y, x = u, v
        for j, a in enumerate(self.series(FORWARD), 1):
            y, x = y + F.sin(u * (2 * j)) * F.cosh(v * (2 * j)) * a, x + F.cos(u * (2 * j)) * F.sinh(v * (2 * j)) * a
        return x * self.radius + self.east, y * self.radius + (self.north - self.origin)

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude in degrees of an easting and northing."""
        u, v = (y - (self.north - self.origin)) / self.radius, (x - self.east) / self.radius
        p, q = u, v
        for j, b in enumerate(self.series(INVERSE), 1):
            p, q = p - F.sin(u * (2 * j)) * F.cosh(v * (2 * j)) * b, q - F.cos(u * (2 * j)) * F.sinh(v * (2 * j)) * b
        chi = F.asin(F.sin(p) / F.cosh(q))
        # sin(2 j chi) by repeated turning, so that chi is worked out a few times only
        lat = chi
        for j, d in enumerate(self.series(LATITUDE), 1):
            lat = lat + F.sin(chi * (2 * j)) * d
        return F.degrees(F.atan2(F.sinh(q), F.cos(p))) + self.lon, F.degrees(lat)


def utm(zone: int, south: bool = False) -> TransverseMercator:
    """A zone of UTM on WGS84."""
    if not 1 <= zone <= 60:
        raise ValueError(f"UTM has zones 1 to 60, not {zone}")
    return TransverseMercator(lon=6.0 * zone - 183, north=10_000_000.0 if south else 0.0)


def utm_zone(lon: Column) -> Column:
    """The zone of UTM that a longitude lies in, without the exceptions around Norway."""
    return F.least(F.floor((lon + 180) / 6).cast("int") + 1, F.lit(60))
