"""Files of radar products: slip models, statistics of pairs with their lists of rejects, and flat rasters with a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_KM
from .files import FlatRaster, located

# fixed values: a header's number of a type, and the type of a cell
ENVI_TYPES = {"2": "i2", "4": "f4", "5": "f8", "12": "u2"}


def subfaults(spark: SparkSession, path: str) -> DataFrame:
    """(feature, lon, lat, depth, strike, dip, length, width, slip, rake) of the patches of a slip model, GeoJSON polygons whose first four corners have a depth in
    metres: kilometres and degrees. The strike is that from which the plane dips to the right. Patches without slip, or without two shallow
    corners and an extent, are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "features array<struct<properties:struct<slip:double,rake:double>,geometry:struct<coordinates:array<array<array<double>>>>>>").alias("j"))
    f = raw.select(F.posexplode("j.features").alias("feature", "f")).select("feature", "f.properties.slip", "f.properties.rake", F.slice(F.col("f.geometry.coordinates")[0], 1, 4).alias("corners"))
    f = f.where((F.col("slip") > 0) & (F.size("corners") == 4))
    mean = lambda points, k: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k]) / F.size(points)
    corners = F.col("corners")
    f = f.withColumns({"lon": mean(corners, 0), "lat": mean(corners, 1), "middle": mean(corners, 2)})
    f = f.withColumns({"top": F.filter("corners", lambda p: p[2] < F.col("middle")), "foot": F.filter("corners", lambda p: p[2] >= F.col("middle"))}).where(F.size("top") == 2)
    east, north = DEGREE_KM["local"]
    kx = F.lit(east) * F.cos(F.radians("lat"))
    top, foot = F.col("top"), F.col("foot")
    edge = (top[1][0] - top[0][0]) * kx, (top[1][1] - top[0][1]) * north
    off = (mean(foot, 0) - mean(top, 0)) * kx, (mean(foot, 1) - mean(top, 1)) * north
    f = f.withColumns({"_ex": edge[0], "_ey": edge[1], "_ox": off[0], "_oy": off[1], "_drop": (mean(foot, 2) - mean(top, 2)) / 1000})
    f = f.withColumns({"length": F.hypot("_ex", "_ey"), "_level": F.hypot("_ox", "_oy")}).where("length > 0 AND _level > 0")
    # to the right of an edge (x, y) lies (y, -x)
    right = F.col("_ey") * F.col("_ox") - F.col("_ex") * F.col("_oy")
    turned: Column = F.degrees(F.atan2("_ex", "_ey")) + F.when(right < 0, 180.0).otherwise(0.0)
    return f.select(
        "feature", "lon", "lat", (F.col("middle") / 1000).alias("depth"), F.pmod(turned + 360, F.lit(360.0)).alias("strike"), F.degrees(F.atan2("_drop", "_level")).alias("dip"),
        "length", F.hypot("_level", "_drop").alias("width"), "slip", "rake",
    )


def geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(feature, name, k, lon, lat): the vertices of a collection's LineStrings in their order, as transects are given in files."""
    shape = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("j")).select(F.posexplode("j.features").alias("feature", "f"))
    lines = f.where(F.col("f.geometry.type") == "LineString").select("feature", F.col("f.properties")["name"].alias("name"), F.from_json("f.geometry.coordinates", "array<array<double>>").alias("c"))
    return lines.select("feature", "name", F.posexplode("c").alias("k", "p")).select("feature", "name", "k", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def pair_stats(lines: DataFrame, text: str = "value") -> DataFrame:
    """(pair, baseline, days, coverage, coherence) from lines of five fields or more, the first one two dates joined by an underscore; comments, shorter lines and
    those with other things than numbers are left out."""
    f = lines.where(~F.trim(text).startswith("#")).select(F.split(F.trim(text), r"\s+").alias("f")).where((F.size("f") >= 5) & F.col("f")[0].contains("_"))
    number = lambda k, name: F.col("f")[k].try_cast("double").alias(name)
    out = f.select(F.col("f")[0].alias("pair"), number(1, "baseline"), number(2, "days").cast("int").alias("days"), number(3, "coverage"), number(4, "coherence"))
    return out.dropna()


def rejects(lines: DataFrame, text: str = "value") -> DataFrame:
    """(pair): the first word of each line of a list of rejected pairs, each once."""
    return lines.where(~F.trim(text).startswith("#") & (F.trim(text) != "")).select(F.split(F.trim(text), r"\s+")[0].alias("pair")).distinct()


def judged(stats: DataFrame, **lists: DataFrame) -> DataFrame:
    """stats with `rejected_by`: the first of the named lists that holds the pair; NULL for one that survived them all."""
    by = F.lit(None).cast("string")
    for name, pairs in reversed(lists.items()):
        stats = stats.join(pairs.select("pair", F.lit(True).alias(f"_{name}")), "pair", "left")
        by = F.when(F.col(f"_{name}"), name).otherwise(by)
    return stats.withColumn("rejected_by", by).drop(*(f"_{n}" for n in lists))


def header_fields(text: str) -> dict[str, str]:
    """Names (small) and values of a header of `name = value` lines."""
    pairs = (line.partition("=") for line in text.splitlines() if "=" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def headed_raster(spark: SparkSession, header: str, band: str = "value") -> DataFrame:
    """(r, c, band) of a flat raster from its header file (.hdr), which tells its size, type and byte order; the cells are beside it (.img)."""
    files, at = located(header)
    with files.open_input_file(at) as f:
        fields = header_fields(f.read().decode("utf-8", "replace"))
    kind = fields.get("data type", "4")
    if kind not in ENVI_TYPES:
        raise ValueError(f"{header}: cells of type {kind}; there are readers for {', '.join(ENVI_TYPES)}")
    width, height = int(fields["samples"]), int(fields["lines"])
    image = header.removesuffix(".hdr") + ".img"
    size, cell = files.get_file_info(at.removesuffix(".hdr") + ".img").size, int(ENVI_TYPES[kind][1])
    if size != width * height * cell:
        raise ValueError(f"{image} has {size} bytes, not those of {height} rows by {width}")
    spark.dataSource.register(FlatRaster)
    order = "big" if fields.get("byte order", "0") == "1" else "little"
    return spark.read.format("flat_raster").options(path=image, width=width, height=height, order=order, bands=band, type=ENVI_TYPES[kind]).load()
