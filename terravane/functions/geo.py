"""Distances, projections, areas and planar predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the earth's radius in km, and km in a degree, by convention
EARTH_KM = {"street": 6371.0, "coast": 6371.0088}
DEGREE_KM = {"sphere": (111.19508, 111.19508), "ellipsoid": (111.320, 110.574), "local": (111.32, 110.57)}


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_KM["street"]) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def local_km(lon: Column, lat: Column, lon0: float, lat0: float, scale: str = "local") -> tuple[Column, Column]:
    """East and north of a point, on a plane through (lon0, lat0)."""
    east, north = DEGREE_KM[scale]
    return (lon - lon0) * east * F.cos(F.radians(F.lit(lat0))), (lat - lat0) * north


def cell_area_ha(lat: Column, dx: float, dy: float, scale: str = "ellipsoid") -> Column:
    """Hectares of a cell of dx by dy degrees."""
    east, north = DEGREE_KM[scale]
    return dx * east * F.cos(F.radians(lat)) * dy * north * 100


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan(F.radians(lat) / 2 + F.pi() / 4))


def tile_xy(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Slippy-map tile of a point."""
    n = float(2**zoom)
    return F.floor((lon + 180) / 360 * n).cast("int"), F.floor((1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2 * n).cast("int")


def terrarium_m(red: Column, green: Column, blue: Column) -> Column:
    return red * 256 + green + blue / 256 - 32768


def line_of_sight(east: Column, north: Column, up: Column, heading: float, incidence: float) -> Column:
    """Displacement away from a right-looking radar; angles in degrees."""
    h, i = F.radians(F.lit(heading)), F.radians(F.lit(incidence))
    return -(up * F.cos(i) - F.sin(i) * (east * F.cos(h) - north * F.sin(h)))


def up_east(los_a: Column, los_b: Column, a: tuple[float, float], b: tuple[float, float]) -> tuple[Column, Column]:
    """Up and east motion from two tracks; a and b: weights (up, east) of each track's line of sight."""
    det = a[0] * b[1] - a[1] * b[0]
    return (los_a * b[1] - los_b * a[1]) / det, (los_b * a[0] - los_a * b[0]) / det


def in_polygon(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule over edges array<struct<x1,y1,x2,y2>>; the half-open test in y counts no vertex twice."""

    def crosses(e: Column) -> Column:
        spans = (e.y1 > y) != (e.y2 > y)
        return spans & (x < (e.x2 - e.x1) * (y - e.y1) / F.when(e.y2 != e.y1, e.y2 - e.y1) + e.x1)

    return F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def segments_cross(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Whether two segments (x1, y1, x2, y2) properly cross or touch."""

    def side(px, py, qx, qy, rx, ry):
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    one = side(ax1, ay1, ax2, ay2, bx1, by1) != side(ax1, ay1, ax2, ay2, bx2, by2)
    other = side(bx1, by1, bx2, by2, ax1, ay1) != side(bx1, by1, bx2, by2, ax2, ay2)
    return one & other


def tile_zoom(span: Column, pixels: int = 3000, low: int = 8, high: int = 14) -> Column:
    """The zoom of map tiles at which a span of degrees has about some pixels, within the zooms that serve."""
    exact = F.log2(F.lit(pixels * 360.0 / 256) / F.greatest(span, F.lit(1e-6)))
    return F.when(span.isNotNull(), F.least(F.greatest(F.bround(exact), F.lit(low)), F.lit(high)).cast("int"))
