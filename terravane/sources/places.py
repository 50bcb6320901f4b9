"""Named sites, street data and footprints."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesy import SEMI_MAJOR

#: Sites that can be asked for by name: longitude, latitude and half the side of their square in km.
SITES: Mapping[str, tuple[float, float, float]] = {"harbour": (110.42, -6.95, 8.0), "peatland": (114.0, -2.3, 25.0), "volcano": (110.446, -7.54, 10.0)}


def site(name: str) -> tuple[float, float, float]:
    found = {k.lower(): v for k, v in SITES.items()}.get(name.strip().lower())
    if found is None:
        raise ValueError(f"no site {name!r}; there are {', '.join(sorted(SITES))}")
    return found


def street_ways(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ways, stops) of street data as JSON, one document a file with `elements`. ways: (way, k, node, lon, lat) of ways that may be walked,
    in order; stops: (node, lon, lat) of nodes that any stop tag marks."""
    element = "struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"elements array<{element}>")["elements"]).alias("e")).select("e.*")
    nodes = raw.where("type = 'node'").select(F.col("id").alias("node"), "lon", "lat", "tags").dropDuplicates(["node"])
    kind = F.col("tags")["highway"]
    ways = raw.where((F.col("type") == "way") & kind.isNotNull() & ~kind.isin("motorway", "motorway_link", "trunk", "trunk_link")).dropDuplicates(["id"])
    order = ways.select(F.col("id").alias("way"), F.posexplode("nodes").alias("k", "node")).join(nodes.drop("tags"), "node")
    stop = (F.col("tags")["highway"] == "bus_stop") | F.col("tags")["public_transport"].isin("platform", "stop_position") | F.col("tags")["railway"].isin("station", "halt", "tram_stop")
    return order.select("way", "k", "node", "lon", "lat"), nodes.where(F.coalesce(stop, F.lit(False))).select("node", "lon", "lat")


def detections_in(detections: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Detections within a box, its borders included, in order of time."""
    w, s, e, n = box
    return detections.where(F.col("lon").between(w, e) & F.col("lat").between(s, n)).orderBy("at", "lon", "lat")


def product_files(spark: SparkSession, path: str) -> DataFrame:
    """(product, name, bytes, band) of a folder of products, one subfolder each; nothing is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))
    part = lambda k: F.element_at(F.split("path", "/"), k)
    return files.select(part(-2).alias("product"), part(-1).alias("name"), "bytes", F.regexp_extract(part(-1), r"_((?:unw_phase|corr|dem|lv_theta|lv_phi|water_mask|amp|vert_disp))\.tif$", 1).alias("band"))


def ground_point(position: tuple[Column, Column, Column], velocity: tuple[Column, Column, Column], slant: Column) -> tuple[Column, Column]:
    """Longitude and latitude, on a sphere, of what a right-looking radar sees at a slant range, from its place and motion (metres, earth-centred)."""
    x, y, z = position
    u, v, w = velocity
    r = F.sqrt(x * x + y * y + z * z)
    up = (x / r, y / r, z / r)
    cross = (v * up[2] - w * up[1], w * up[0] - u * up[2], u * up[1] - v * up[0])
    size = F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2])
    cosine = (r * r + SEMI_MAJOR * SEMI_MAJOR - slant * slant) / (2 * r * SEMI_MAJOR)
    sine = F.sqrt(1 - cosine * cosine)
    px, py, pz = (a * cosine + c / size * sine for a, c in zip(up, cross))
    return F.degrees(F.atan2(py, px)), F.degrees(F.asin(pz))


def footprints(states: DataFrame, key: str, near: float, far: float) -> DataFrame:
    """(key, ring) of scenes: the places seen at the near and the far range at their first and last state (key, t, x, y, z, vx, vy, vz)."""
    ends = states.groupBy(key).agg(*(F.expr(f"{f}_by(struct(x, y, z, vx, vy, vz), t)").alias(n) for n, f in (("a", "min"), ("b", "max"))))

    def corner(end: str, slant: float) -> Column:
        at = tuple(F.col(f"{end}.{k}") for k in "xyz")
        moving = tuple(F.col(f"{end}.v{k}") for k in "xyz")
        lon, lat = ground_point(at, moving, F.lit(slant))
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    ring = [corner("a", near), corner("b", near), corner("b", far), corner("a", far), corner("a", near)]
    return ends.select(key, F.array(*ring).alias("ring"))
