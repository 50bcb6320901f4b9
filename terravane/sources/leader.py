"""Radar scenes of CEOS products: fields of the leader's fixed-width records, lengths of the image file, and where a scene lies."""

from __future__ import annotations

import datetime
import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import located
from .places import ground_point


@dataclass(frozen=True)
class Field:
    """A number written in ASCII at a place of a record (counted after its header of 12 bytes), and its unit's size."""

    record: int
    place: int
    unit: float = 1.0


# fixed values: places of the leader's fields, and of the image file's, as the products have them
FIELDS = {"wavelength": Field(2, 495), "sample_rate": Field(2, 704, 1e6), "pulse": Field(2, 736, 1e-6), "prf": Field(2, 923, 1e-3)}
STATES_RECORD, STATES_START, STATES_STEP, STATES_PLACE = 3, 149, 171, 374
IMAGE_HEADER, LINE_PREFIX, NEAR_PLACE, SAMPLE_BYTES = 720, 544, 104, 8
LIGHT = 299_792_458.0
# fixed values: how the summary record writes the scene, the time of its centre and the ellipsoid's radii in km, and where they stand
SCENE, STAMP, RADIUS, SUMMARY_HEAD = re.compile(r"ALOS2\d+-\d+"), re.compile(r"\d{17}"), re.compile(r"\d{4}\.\d{7}"), 400
EQUATOR, POLE = 6378137.0, 6356752.3141

_NUMBER = re.compile(r"\s*([-+]?\d+(?:\.\d+)?(?:[EeDd][-+]?\d+)?)")
_VECTORS = re.compile(r"[-+]?\d+\.\d+[EeDd][-+]?\d+")
_STATE = "t double, x double, y double, z double, vx double, vy double, vz double"
_COLUMNS = {
    "scene_id": "string", "centre": "timestamp", "equatorial_radius": "double", "polar_radius": "double", **dict.fromkeys(FIELDS, "double"), "states": f"array<struct<{_STATE.replace(' ', ':')}>>".replace(",:", ","),
}


def number_at(record: bytes, place: int) -> float:
    text = record[place : place + 32].decode("ascii", "replace")
    found = _NUMBER.match(text)
    if not found:
        raise ValueError(f"no number at {place} of the record: {text!r}")
    return _float(found[1])


def _float(text: str) -> float:
    return float(text.upper().replace("D", "E"))


def heading(record: bytes) -> dict:
    """Scene, time of its centre (the stamp of the summary is the centre's, not the start's) and radii in metres, from the summary record."""
    text = record[:SUMMARY_HEAD].decode("ascii", "replace")
    scene, stamp, radii = SCENE.search(text), STAMP.search(text), [1e3 * float(x) for x in RADIUS.findall(text)]
    centre = datetime.datetime.strptime(stamp[0] + "000", "%Y%m%d%H%M%S%f").replace(tzinfo=datetime.timezone.utc) if stamp else None
    return {"scene_id": scene and scene[0], "centre": centre, "equatorial_radius": [*radii, EQUATOR][0], "polar_radius": radii[1] if len(radii) > 1 else POLE}


def state_vectors(record: bytes, centre: datetime.datetime | None) -> list[tuple]:
    """(t, x, y, z, vx, vy, vz) of the platform position record, t in seconds from the scene's centre, over midnight too."""
    start, step = number_at(record, STATES_START), number_at(record, STATES_STEP)
    values = [_float(v) for v in _VECTORS.findall(record[STATES_PLACE:].decode("ascii", "replace"))]
    if len(values) < 6:
        raise ValueError("no state vectors in the platform position record")
    middle = centre.hour * 3600 + centre.minute * 60 + centre.second + centre.microsecond / 1e6 if centre else 0.0
    out = []
    for k in range(len(values) // 6):
        t = start + step * k - middle
        out.append((t - 86400 * round(t / 86400), *values[6 * k : 6 * k + 6]))
    return out


class CeosLeaders(DataSource):
    """A row for each leader file (LED-...) of a folder. Options: path; fields, those of the columns that are decoded: records that none of them
    needs aren't read."""

    @classmethod
    def name(cls) -> str:
        return "ceos_leaders"

    def schema(self) -> str:
        return "file string, " + ", ".join(f"{c} {_COLUMNS[c]}" for c in self._fields())

    def _fields(self) -> list[str]:
        wanted = [c for c in self.options.get("fields", "").split(",") if c] or list(_COLUMNS)
        if unknown := [c for c in wanted if c not in _COLUMNS]:
            raise ValueError(f"no field {', '.join(unknown)}; there are {', '.join(_COLUMNS)}")
        return wanted

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LeaderReader(self.options["path"], self._fields())


class _Files(DataSourceReader):
    def __init__(self, path: str, prefix: str):
        self.path, self.prefix = path, prefix

    def partitions(self) -> list[InputPartition]:
        files, path = located(self.path)
        found = files.get_file_info(FileSelector(path)) if files.get_file_info(path).type == FileType.Directory else [files.get_file_info(path)]
        # products lie beside what was derived from them, which ends in a suffix of letters; their own names end in a code such as 1.1__A
        own = [f for f in found if f.type == FileType.File and f.base_name.startswith(self.prefix) and not re.search(r"\.[A-Za-z]\w*$", f.base_name)]
        return [InputPartition((f.path, f.size)) for f in sorted(own, key=lambda f: f.path)] or [InputPartition(None)]


class _LeaderReader(_Files):
    def __init__(self, path: str, fields: Sequence[str]):
        super().__init__(path, "LED-")
        self.fields = fields
        self.records = {FIELDS[f].record if f in FIELDS else 2 for f in fields} | ({STATES_RECORD} if "states" in fields else set())

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        path, length = partition.value
        records: dict[int, bytes] = {}
        files, _ = located(self.path)
        with files.open_input_file(path) as f:
            at = 0
            while at + 12 <= length and len(records) < len(self.records):
                number, _, size = struct.unpack(">III", f.read_at(12, at))
                if size < 12 or at + size > length:
                    raise ValueError(f"{path}: record {number} at {at} has length {size}")
                if number in self.records:
                    records[number] = f.read_at(size - 12, at + 12)
                at += size
        if missing := self.records - records.keys():
            raise ValueError(f"{path} lacks record {', '.join(map(str, sorted(missing)))}")
        head = heading(records[2])
        decoded = {k: v for k, v in head.items() if k in self.fields}
        for f in self.fields:
            if f in FIELDS:
                decoded[f] = number_at(records[FIELDS[f].record], FIELDS[f].place) * FIELDS[f].unit
        if "states" in self.fields:
            decoded["states"] = state_vectors(records[STATES_RECORD], head["centre"])
        yield (path.rpartition("/")[2], *(decoded[f] for f in self.fields))


class CeosImages(DataSource):
    """A row for each image file (IMG-...) of a folder, from its size and the head of its first line. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "ceos_images"

    def schema(self) -> str:
        return "file string, polarisation string, scene string, lines long, bins long, near_range double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ImageReader(self.options["path"], "IMG-")


class _ImageReader(_Files):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        path, length = partition.value
        files, _ = located(self.path)
        with files.open_input_file(path) as f:
            head = f.read_at(12 + LINE_PREFIX, IMAGE_HEADER)
        size = struct.unpack(">I", head[8:12])[0]
        near = struct.unpack_from(">i", head, 12 + NEAR_PLACE)[0]
        name = path.rpartition("/")[2]
        _, polarisation, scene = name.split("-", 2)
        yield name, polarisation, scene, (length - IMAGE_HEADER) // size, (size - LINE_PREFIX) // SAMPLE_BYTES, float(near)


def leaders(spark: SparkSession, path: str, fields: Sequence[str] = ()) -> DataFrame:
    """(file, fields...) of the leaders of a folder; see CeosLeaders. No fields: all."""
    spark.dataSource.register(CeosLeaders)
    return spark.read.format("ceos_leaders").option("path", path).option("fields", ",".join(fields)).load()


def images(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(CeosImages)
    return spark.read.format("ceos_images").option("path", path).load()


def scenes(spark: SparkSession, path: str, polarisation: str = "HH") -> DataFrame:
    """Scenes of a folder that have both files: the fields of both, the duration in seconds, start and end (half of it either side of the centre), and the
    slant ranges of the first and the last sample."""
    own = leaders(spark, path).withColumn("scene", F.substring("file", 5, 1000)).drop("file")
    both = own.join(images(spark, path).where(F.col("polarisation") == polarisation).drop("file"), "scene")
    both = both.withColumn("duration", F.col("lines") / F.col("prf"))
    half = F.make_dt_interval(secs=(F.col("duration") / 2).cast("decimal(18,6)"))
    far = F.col("near_range") + F.col("bins") * LIGHT / (2 * F.col("sample_rate"))
    return both.withColumns({"start": F.col("centre") - half, "end": F.col("centre") + half, "far_range": far})


def _at(t: Column) -> Column:
    """The state at a time, linear between the two vectors around it; NULL outside of them."""
    before, after = F.element_at(F.filter("states", lambda s: s.t <= t), -1), F.get(F.filter("states", lambda s: s.t >= t), F.lit(0))
    part = F.when(after.t == before.t, 0.0).otherwise((t - before.t) / (after.t - before.t))
    return F.struct(*((before[k] + (after[k] - before[k]) * part).alias(k) for k in ("x", "y", "z", "vx", "vy", "vz")))


def scene_footprints(found: DataFrame, places: int = 5) -> DataFrame:
    """(scene_id, ring): the outline of what each scene saw, from its orbit and its ranges at `places` times between its start and end; closed, longitude and
    latitude on a sphere, so good for maps and for choosing scenes."""
    times = [(k / (places - 1) - 0.5) for k in range(places)]
    states = found.select("scene_id", "near_range", "far_range", F.array(*(_at(F.col("duration") * k) for k in times)).alias("s"))

    def place(s: Column, slant: Column) -> Column:
        lon, lat = ground_point((s.x, s.y, s.z), (s.vx, s.vy, s.vz), slant)
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    near, far = F.transform("s", lambda s: place(s, F.col("near_range"))), F.transform("s", lambda s: place(s, F.col("far_range")))
    return states.select("scene_id", F.concat(near, F.reverse(far), F.slice(near, 1, 1)).alias("ring"))
