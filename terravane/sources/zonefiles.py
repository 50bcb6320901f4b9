"""Zones from GeoPackage files: a reader that asks the file's own spatial index for a box and splits what it holds by ranges of ids."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..session import push_filters

_EDGE = pa.struct([(k, pa.float64()) for k in ("x1", "y1", "x2", "y2")])
#: Bound of a box: the index's column. It stores bounds rounded outwards, so it never leaves out what the exact bound keeps.
_INDEXED = {"w": "minx", "e": "maxx", "s": "miny", "n": "maxy"}
_SIGNS = {GreaterThan: ">=", GreaterThanOrEqual: ">=", LessThan: "<=", LessThanOrEqual: "<="}


def rings(blob: bytes) -> list[np.ndarray]:
    """The rings of a geometry: Polygon or MultiPolygon, plain WKB or in a GeoPackage's own header, with Z and M passed over. Other kinds have none."""
    if blob[:2] == b"GP":
        blob = blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :]
    out: list[np.ndarray] = []

    def read(at: int) -> int:
        order = "<" if blob[at] else ">"
        kind, n = struct.unpack_from(f"{order}II", blob, at + 1)
        width = 2 + (kind & 0x80000000 != 0 or kind // 1000 % 10 in (1, 3)) + (kind & 0x40000000 != 0 or kind // 1000 % 10 in (2, 3))
        kind, at = (kind & 0x0FFFFFFF) % 1000, at + 9
        if kind == 6:
            for _ in range(n):
                at = read(at)
        elif kind == 3:
            for _ in range(n):
                (points,) = struct.unpack_from(f"{order}I", blob, at)
                out.append(np.frombuffer(blob, f"{order}f8", points * width, at + 4).reshape(points, width)[:, :2].astype(np.float64))
                at += 4 + 8 * width * points
        return at

    if blob:
        read(0)
    return out


class GeoPackageZones(DataSource):
    """Polygons of a GeoPackage layer. Options: path, on a folder that the driver and all executors share; layer (default: the first one); rows (features
    of one partition). Columns: fid, the attributes, the box w, s, e, n, and edges, all rings' edges, so holes need no care. Comparisons of w, s, e
    and n reach the layer's spatial index."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        return Layer(self.options).schema()

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZoneReader(self.options)


class Layer:
    def __init__(self, options):
        self.path = options["path"].removeprefix("file:")
        with self.open() as db:
            wanted = options.get("layer")
            found = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns WHERE ? IS NULL OR table_name = ? ORDER BY rowid LIMIT 1", (wanted, wanted)).fetchone()
            if found is None:
                raise ValueError(f"{self.path} has no layer {wanted or 'of features'}")
            self.table, self.geometry = found
            columns = db.execute(f"PRAGMA table_info({_quoted(self.table)})").fetchall()
            self.key = next((c[1] for c in columns if c[5]), "rowid")
            self.attributes = [(c[1], _kind(c[2])) for c in columns if c[1] not in (self.key, self.geometry)]
            self.index = f"rtree_{self.table}_{self.geometry}"
            self.indexed = db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (self.index,)).fetchone() is not None

    def open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)

    def schema(self) -> str:
        own = "".join(f"`{n}` {t}, " for n, t in self.attributes)
        return f"fid bigint, {own}w double, s double, e double, n double, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _kind(declared: str) -> str:
    declared = declared.upper()
    return "bigint" if "INT" in declared else "double" if any(k in declared for k in ("REAL", "DOUBLE", "FLOAT")) else "string"


class ZoneReader(DataSourceReader):
    def __init__(self, options):
        self.layer, self.rows = Layer(options), int(options.get("rows", 10_000))
        self.bounds: list[tuple[str, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _SIGNS and len(f.attribute) == 1 and f.attribute[0] in _INDEXED and self.layer.indexed:
                self.bounds.append((f"{_INDEXED[f.attribute[0]]} {_SIGNS[type(f)]} ?", float(f.value)))
            yield f  # Spark compares the exact bounds again

    def _hits(self) -> tuple[str, list[float]]:
        """A query of the ids that the bounds leave, and its values."""
        where = " WHERE " + " AND ".join(b for b, _ in self.bounds) if self.bounds else ""
        source = _quoted(self.layer.index) if self.bounds else _quoted(self.layer.table)
        return f"SELECT {'id' if self.bounds else _quoted(self.layer.key)} AS id FROM {source}{where}", [v for _, v in self.bounds]

    def partitions(self) -> list[InputPartition]:
        hits, values = self._hits()
        with self.layer.open() as db:
            cuts = [r[0] for r in db.execute(f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM ({hits})) WHERE k % ? = 0 ORDER BY id", (*values, self.rows))]
        return [InputPartition((a, b)) for a, b in zip(cuts, [*cuts[1:], None])] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        low, high = partition.value
        hits, values = self._hits()
        own = ", ".join(_quoted(n) for n, _ in self.layer.attributes)
        key = _quoted(self.layer.key)
        until = "" if high is None else " AND id < ?"
        with self.layer.open() as db:
            rows = db.execute(
                f"SELECT {key}, {_quoted(self.layer.geometry)}{', ' + own if own else ''} FROM {_quoted(self.layer.table)} WHERE {key} IN (SELECT id FROM ({hits}) WHERE id >= ?{until}) ORDER BY {key}",
                (*values, low, *([] if high is None else [high])),
            )
            while some := rows.fetchmany(500):
                yield self._batch(some)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        ends, boxes, edges = [0], [], []
        for r in rows:
            own = rings(r[1] or b"")
            edges += [np.hstack((x[:-1], x[1:])) for x in own]
            ends.append(ends[-1] + sum(len(x) - 1 for x in own if len(x)))
            points = np.concatenate(own) if own else np.zeros((0, 2))
            boxes.append((*points.min(0), *points.max(0)) if len(points) else (None,) * 4)
        flat = np.concatenate(edges) if edges else np.zeros((0, 4))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(4)], fields=list(_EDGE)))
        types = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
        columns = [pa.array([r[0] for r in rows], pa.int64())]
        for k, (_, kind) in enumerate(self.layer.attributes):
            values = [r[2 + k] for r in rows]
            columns.append(pa.array([None if v is None else str(v) for v in values] if kind == "string" else values, types[kind]))
        columns += [pa.array([b[k] for b in boxes], pa.float64()) for k in range(4)]
        return pa.RecordBatch.from_arrays([*columns, lists], ["fid", *(n for n, _ in self.layer.attributes), "w", "s", "e", "n", "edges"])


def zones_in(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, layer: str | None = None, rows: int = 10_000) -> DataFrame:
    """The zones of a GeoPackage layer whose box meets `box` (w, s, e, n), borders included; all of them without one."""
    spark.dataSource.register(GeoPackageZones)
    push_filters(spark)
    reader = spark.read.format("geopackage").option("path", path).option("rows", rows)
    zones = (reader if layer is None else reader.option("layer", layer)).load()
    if box is None:
        return zones
    w, s, e, n = map(float, box)
    return zones.where((zones.e >= w) & (zones.w <= e) & (zones.n >= s) & (zones.s <= n))
