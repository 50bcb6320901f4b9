"""Readers of the field's text and binary files, and sinks for results."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.calendar import stamp, week_of_month


def endpoints(spark: SparkSession, path: str) -> DataFrame:
    """Trajectory endpoint files: (file, direction, traj_id, at, lon, lat, height), one row for each point.

    A file's header gives its own length: a count of grids and one line for each, a count of trajectories with the
    direction and one line for each, and a line of variables. A record has 12 fields or more; years before 70
    belong to this century. A shorter record, or an empty file, is an error.
    """
    lines = F.filter(F.split("content", r"\r?\n"), lambda x: F.trim(x) != "")
    fields = lambda x: F.split(F.trim(x), r"\s+")
    files = spark.read.format("binaryFile").load(path)
    found = [located(unquote(f)) for f in files.inputFiles()]  # a run has few files
    empty = [at for system, at in found if not system.get_file_info(at).size]
    if empty:
        raise ValueError(f"{len(empty)} empty endpoint files in {path}: {', '.join(empty)}")  # Spark passes over files without bytes
    text = files.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("content"))
    text = text.select("file", lines.alias("l")).withColumn("l", F.when(F.size("l") == 0, F.raise_error(F.concat(F.lit("empty endpoint file "), "file"))).otherwise(F.col("l")))
    text = text.withColumn("g", F.get(fields(F.get("l", F.lit(0))), F.lit(0)).cast("int"))
    head = text.withColumn("h", fields(F.get("l", F.col("g") + 1))).withColumn("n", F.get("h", F.lit(0)).cast("int"))
    direction = F.upper(F.coalesce(F.get("h", F.lit(1)), F.lit("FORWARD")))
    body = head.select("file", direction.alias("direction"), F.explode(F.slice("l", F.col("g") + F.col("n") + 4, F.size("l"))).alias("line"))
    p = fields(F.col("line"))
    body = body.withColumn("p", F.when(F.size(p) < 12, F.raise_error(F.concat(F.lit("endpoint record with fewer than 12 fields: "), "line"))).otherwise(p))
    number = lambda k: F.get("p", F.lit(k)).cast("int")
    year = F.when(number(2) < 70, 2000 + number(2)).otherwise(1900 + number(2))
    at = F.make_timestamp(year, number(3), number(4), number(5), number(6), F.lit(0))
    real = lambda k, name: F.get("p", F.lit(k)).cast("double").alias(name)
    return body.select("file", "direction", number(0).alias("traj_id"), at.alias("at"), real(10, "lon"), real(9, "lat"), real(11, "height"))


def weather_weeks(runs: DataFrame, start: str, hours: str, backward: str) -> DataFrame:
    """Weekly archive files (year, month, week) that each run spans, from its start over its hours, either way."""
    move = F.make_interval(hours=F.col(hours))
    low = F.when(F.col(backward), F.col(start) - move).otherwise(F.col(start))
    high = F.when(F.col(backward), F.col(start)).otherwise(F.col(start) + move)
    day = F.explode(F.sequence(F.to_date(low), F.to_date(high))).alias("day")
    return runs.select(*(c for c in runs.columns), day).select(*runs.columns, F.year("day").alias("year"), F.month("day").alias("month"), week_of_month(F.col("day")).alias("week")).distinct()


def detections_csv(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Detections of several satellites with a UTC time from a date and an hhmm number. paths: satellite to path."""
    schema = "latitude double, longitude double, acq_date date, acq_time int, confidence string, frp double"
    parts = [spark.read.csv(path, header=True, schema=schema).withColumn("sat", F.lit(sat)) for sat, path in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("sat", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), stamp(F.col("acq_date"), F.col("acq_time")).alias("at"), "confidence", "frp")


_POINT = "array<double>"


def geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """(feature, name, lon, lat) of every Point, MultiPoint, LineString and MultiLineString vertex of a collection."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>").alias("j"))
    f = raw.select(F.posexplode("j.features").alias("feature", "f")).select("feature", F.col("f.properties")["name"].alias("name"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("at"))
    points = F.when(F.col("type") == "Point", F.array(F.from_json("at", _POINT)))
    points = points.when(F.col("type").isin("MultiPoint", "LineString"), F.from_json("at", f"array<{_POINT}>"))
    points = points.when(F.col("type") == "MultiLineString", F.flatten(F.from_json("at", f"array<array<{_POINT}>>")))
    return f.select("feature", "name", F.explode(points).alias("p")).select("feature", "name", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def geojson_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(zone, name, edges) of every Polygon and MultiPolygon: all rings' edges, so holes need no care."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>").alias("j"))
    f = raw.select(F.posexplode("j.features").alias("zone", "f")).select("zone", F.coalesce(F.col("f.properties")["name"], F.col("f.properties")["Nama"], F.concat(F.lit("zone_"), F.col("zone") + 1)).alias("name"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("at"))
    rings = F.when(F.col("type") == "Polygon", F.from_json("at", f"array<array<{_POINT}>>")).when(F.col("type") == "MultiPolygon", F.flatten(F.from_json("at", f"array<array<array<{_POINT}>>>")))
    edge = lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
    pairs = lambda r: F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), edge)
    return f.where(rings.isNotNull()).select("zone", "name", F.flatten(F.transform(rings, pairs)).alias("edges"))


def located(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI and the path on it. Local paths must be on folders that all executors share."""
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


class FlatRaster(DataSource):
    """Flat binary rasters: options width, height, type (f4 unless given; f8, i2 or u2), order (big or little), bands (names in file order,
    band after band) and rows (of one partition). Columns r, c and one for each band; nodata gives NULL."""

    @classmethod
    def name(cls) -> str:
        return "flat_raster"

    def schema(self) -> str:
        return "r int, c int, " + ", ".join(f"`{b}` double" for b in self.options["bands"].split(","))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FlatRasterReader(self.options)


class _FlatRasterReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.width, self.height = options["path"], int(options["width"]), int(options["height"])
        self.bands = options["bands"].split(",")
        self.type = np.dtype((">" if options.get("order", "little") == "big" else "<") + options.get("type", "f4"))
        self.rows = int(options.get("rows", max(1, (1 << 20) // self.width)))
        self.nodata = float(options["nodata"]) if "nodata" in options else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((a, min(a + self.rows, self.height))) for a in range(0, self.height, self.rows)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        a, b = partition.value
        n, columns = (b - a) * self.width, []
        files, path = located(self.path)
        with files.open_input_file(path) as f:
            for k in range(len(self.bands)):
                size = self.type.itemsize
                v = np.frombuffer(f.read_at(n * size, (k * self.height + a) * self.width * size), self.type).astype(float)
                columns.append(pa.array(v, mask=~np.isfinite(v) | (v == self.nodata if self.nodata is not None else False)))
        r, c = np.divmod(np.arange(n), self.width)
        yield pa.RecordBatch.from_arrays([pa.array((r + a).astype(np.int32)), pa.array(c.astype(np.int32)), *columns], ["r", "c", *self.bands])


class CeosRecords(DataSource):
    """Records of CEOS files, one partition a file: a big-endian header of 12 bytes tells each record's kind and length. Only headers are
    read, and what lies between them is passed over, so a scene's size doesn't matter. Option: path, a file or a folder."""

    @classmethod
    def name(cls) -> str:
        return "ceos_records"

    def schema(self) -> str:
        return "file string, k int, kind string, offset long, size long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _CeosReader(self.options["path"])


class _CeosReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files, path = located(self.path)
        if files.get_file_info(path).type == FileType.Directory:
            found = files.get_file_info(FileSelector(path))
        else:
            found = [files.get_file_info(path)]
        return [InputPartition((f.path, f.size)) for f in found if f.type == FileType.File]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, length = partition.value
        files, _ = located(self.path)
        with files.open_input_file(path) as f:
            at = k = 0
            while at + 12 <= length:
                head = f.read_at(12, at)
                size = int.from_bytes(head[8:], "big")
                if size < 12 or at + size > length:
                    raise ValueError(f"{path}: record {k} at {at} has length {size}")
                yield path, k, head[4:8].hex(), at, size
                at, k = at + size, k + 1


def ceos_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, k, kind, offset, size) of the records of CEOS files."""
    spark.dataSource.register(CeosRecords)
    return spark.read.format("ceos_records").option("path", path).load()


def run_results(spark: SparkSession, path: str) -> DataFrame:
    """Result records of earlier runs, one JSON document a file; unreadable ones are left out."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("result"))
    return text.where("result IS NOT NULL")


def to_geojson(lines: DataFrame, geometry: Column, properties: list[str]) -> DataFrame:
    """One Feature a row, as JSON text. geometry: a struct of type and coordinates."""
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return lines.select(F.to_json(feature).alias("value"))


def control_file(starts: DataFrame, hours: int, top: float, archives: list[str], out: str) -> DataFrame:
    """Text of a trajectory run's control file, one row a start time: (at, value). starts: (at, lat, lon, height)."""
    place = F.concat_ws(" ", F.format_string("%.4f", "lat"), F.format_string("%.4f", "lon"), F.format_string("%.1f", "height"))
    files = [x for a in archives for x in (a.rpartition("/")[0] + "/", a.rpartition("/")[2])]
    tail = [str(hours), "0", f"{top:.1f}", str(len(archives)), *files, out.rpartition("/")[0] + "/", out.rpartition("/")[2]]
    head = F.concat_ws("\n", F.date_format("at", "yy MM dd HH"), F.count("*").cast("string"), F.concat_ws("\n", F.sort_array(F.collect_list(place))))
    return starts.groupBy("at").agg(F.concat_ws("\n", head, *map(F.lit, tail)).alias("value"))


def write_tiles(cells: DataFrame, path: str, size: int = 256) -> None:
    """Cells as Parquet by tile, so that a window reads its own tiles alone."""
    tiled = cells.withColumn("tile_r", F.floor(F.col("r") / size).cast("int")).withColumn("tile_c", F.floor(F.col("c") / size).cast("int"))
    tiled.repartition("tile_r", "tile_c").write.mode("overwrite").partitionBy("tile_r", "tile_c").parquet(path)


def write_results(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def describe(options: dict) -> str:
    """A deterministic text of run options, for names that a later run can find again."""
    return json.dumps(options, sort_keys=True)
