"""Rasters as GeoTIFF files: a reader of tiles and strips, and a writer that shows a raster only when all of it is there.

The writer cuts a raster into blocks; each task writes those of its own as tiled GeoTIFF files of float32, or of bytes with a
palette, into a staging folder. Committing moves them in one step and then replaces the raster's index (index.json), which readers go by; a job
that fails leaves the raster as it was, and nothing of its own. Paths lie on a folder that the driver and all executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import push_filters
from .files import located

# fixed values: numbers of tags, their field types and sizes, and sample formats, as the format has them
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR, PALETTE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
_TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
_FORMATS = {1: "u", 2: "i", 3: "f"}


@dataclass(frozen=True)
class Grid:
    """Where cells lie: the corner of cell (0, 0) and the size of a cell, in the units of an EPSG code."""

    west: float = 0.0
    north: float = 0.0
    dx: float = 1.0
    dy: float = 1.0
    epsg: int = 4326


def tiff_bytes(values: np.ndarray, grid: Grid, nodata: float, palette: Mapping[int, tuple[int, int, int]] | None = None, tile: int = 256) -> bytes:
    """A tiled GeoTIFF of float32, or of bytes with a palette {code: (red, green, blue)}; deflate, 256 cells a side of a tile."""
    kind = np.dtype("u1") if palette is not None else np.dtype("<f4")
    rows, columns = values.shape
    whole = np.full((-(-rows // tile) * tile, -(-columns // tile) * tile), nodata, kind)
    whole[:rows, :columns] = values
    tiles = [zlib.compress(np.ascontiguousarray(whole[r : r + tile, c : c + tile]).tobytes()) for r in range(0, rows, tile) for c in range(0, columns, tile)]
    geographic = grid.epsg == 4326
    tags: dict[int, tuple[int, tuple]] = {
        WIDTH: (4, (columns,)), HEIGHT: (4, (rows,)), BITS: (3, (8 * kind.itemsize,)), COMPRESSION: (3, (8,)), PHOTOMETRIC: (3, (3 if palette is not None else 1,)), SAMPLES: (3, (1,)), PLANAR: (3, (1,)),
        TILE_WIDTH: (3, (tile,)), TILE_HEIGHT: (3, (tile,)), TILE_BYTES: (4, tuple(map(len, tiles))), FORMAT: (3, (1 if palette is not None else 3,)),
        SCALE: (12, (grid.dx, grid.dy, 0.0)), TIEPOINT: (12, (0.0, 0.0, 0.0, grid.west, grid.north, 0.0)),
        KEYS: (3, (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, grid.epsg)), NODATA: (2, tuple(bytes([b]) for b in f"{nodata:g}\0".encode())),
    }
    if palette is not None:
        tags[PALETTE] = (3, tuple(257 * palette.get(code, (0, 0, 0))[band] for band in range(3) for code in range(256)))
    tags[TILES] = (4, (0,) * len(tiles))
    at = 8 + 2 + 12 * len(tags) + 4
    sizes = {tag: _TYPES[t][1] * len(v) for tag, (t, v) in tags.items()}
    places = {}
    for tag in sorted(tags):
        if sizes[tag] > 4:
            places[tag] = at
            at += sizes[tag] + sizes[tag] % 2
    starts = np.cumsum([at, *map(len, tiles)])[:-1]
    tags[TILES] = (4, tuple(map(int, starts)))
    head, extra = struct.pack("<2sHIH", b"II", 42, 8, len(tags)), b""
    for tag in sorted(tags):
        t, v = tags[tag]
        raw = struct.pack(f"<{len(v)}{_TYPES[t][0]}", *v)
        if tag in places:
            head += struct.pack("<HHII", tag, t, len(v), places[tag])
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            head += struct.pack("<HHI", tag, t, len(v)) + raw.ljust(4, b"\0")
    return head + b"\0" * 4 + extra + b"".join(tiles)


class Tiff:
    """The first image of a TIFF file: its tags, and the pieces (tiles or strips) that hold its cells. read(place, size) gives bytes of the file."""

    def __init__(self, read):
        self.read = read
        head = read(0, 8)
        if head[:2] not in (b"II", b"MM") or struct.unpack(("<" if head[:2] == b"II" else ">") + "H", head[2:4])[0] != 42:
            raise ValueError("no TIFF file, or one of over 4 GB")
        self.order = order = "<" if head[:2] == b"II" else ">"
        (at,) = struct.unpack(order + "I", head[4:])
        (n,) = struct.unpack(order + "H", read(at, 2))
        entries = read(at + 2, 12 * n)
        self.tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", entries, 12 * k)
            if kind in _TYPES:
                code, size = _TYPES[kind]
                raw = entries[12 * k + 8 : 12 * k + 8 + count * size] if count * size <= 4 else read(struct.unpack_from(order + "I", entries, 12 * k + 8)[0], count * size)
                self.tags[tag] = struct.unpack(f"{order}{count}{code}", raw)
        self.columns, self.rows = self.tags[WIDTH][0], self.tags[HEIGHT][0]
        self.tiled = TILES in self.tags
        self.piece_rows = self.tags[TILE_HEIGHT][0] if self.tiled else min(self.tags.get(STRIP_ROWS, (self.rows,))[0], self.rows)
        self.piece_columns = self.tags[TILE_WIDTH][0] if self.tiled else self.columns
        self.across = -(-self.columns // self.piece_columns)
        if self.tags.get(SAMPLES, (1,))[0] != 1 or self.tags.get(PREDICTOR, (1,))[0] != 1 or self.tags.get(COMPRESSION, (1,))[0] not in (1, 8, 32946):
            raise ValueError("only one band, without a predictor, plain or deflated")
        self.type = np.dtype(f"{order}{_FORMATS[self.tags.get(FORMAT, (1,))[0]]}{self.tags[BITS][0] // 8}")
        text = b"".join(self.tags.get(NODATA, ())).rstrip(b"\0 ").decode() if NODATA in self.tags else ""
        self.nodata = float(text) if text else None

    def grid(self) -> Grid:
        dx, dy = self.tags.get(SCALE, (1.0, 1.0))[:2]
        c, r, _, x, y = self.tags.get(TIEPOINT, (0.0,) * 6)[:5]
        keys = self.tags.get(KEYS, ())
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
        return Grid(x - c * dx, y + r * dy, dx, dy, codes.get(3072, codes.get(2048, 0)))

    def piece(self, k: int) -> tuple[int, int, np.ndarray]:
        """Row and column of the first cell of a piece, and its cells within the image."""
        place, size = self.tags[TILES if self.tiled else STRIPS][k], self.tags[TILE_BYTES if self.tiled else STRIP_BYTES][k]
        r, c = k // self.across * self.piece_rows, k % self.across * self.piece_columns
        rows, columns = min(self.piece_rows, self.rows - r), min(self.piece_columns, self.columns - c)
        raw = self.read(place, size)
        raw = zlib.decompress(raw) if self.tags.get(COMPRESSION, (1,))[0] != 1 else raw
        stored = self.piece_rows if self.tiled else rows
        return r, c, np.frombuffer(raw, self.type, stored * self.piece_columns).reshape(stored, self.piece_columns)[:rows, :columns]


@dataclass
class Blocks(WriterCommitMessage):
    files: list[dict]


class GeoTiffs(DataSource):
    """A raster of GeoTIFF files: a folder that write_raster made, any folder of .tif files, or one file. Columns r, c and value, nodata as NULL; in files
    that stand alone r and c count from each file's own corner. Comparisons of r and c choose the blocks that are read."""

    @classmethod
    def name(cls) -> str:
        return "geotiffs"

    def schema(self) -> str:
        return "file string, r int, c int, value double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TiffReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TiffWriter(self.options, overwrite)


class TiffReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.at_once = options["path"], int(options.get("pieces", 64))
        self.limits: list[tuple[str, bool, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if f.__class__ in (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and f.attribute in (("r",), ("c",)):
                self.limits.append((f.attribute[0], f.__class__ in (GreaterThan, GreaterThanOrEqual), float(f.value)))
            yield f

    def _meets(self, r: int, c: int, rows: int, columns: int) -> bool:
        first, last = {"r": r, "c": c}, {"r": r + rows - 1, "c": c + columns - 1}
        return all(last[k] >= v if least else first[k] <= v for k, least, v in self.limits)

    def partitions(self) -> list[InputPartition]:
        files, path = located(self.path)
        index = f"{path}/index.json"
        if files.get_file_info(index).type == FileType.File:
            with files.open_input_file(index) as f:
                found = [(f"{path}/{b['file']}", b["r"], b["c"], b["rows"], b["columns"]) for b in json.loads(f.read())["blocks"]]
        elif files.get_file_info(path).type == FileType.Directory:
            found = [(f.path, 0, 0, None, None) for f in files.get_file_info(FileSelector(path)) if f.path.lower().endswith((".tif", ".tiff"))]
        else:
            found = [(path, 0, 0, None, None)]
        out = []
        for name, r, c, rows, columns in sorted(found):
            if rows is not None and not self._meets(r, c, rows, columns):
                continue
            with files.open_input_file(name) as f:
                tiff = Tiff(lambda at, n: f.read_at(n, at))
                n = tiff.across * -(-tiff.rows // tiff.piece_rows)
            out += [InputPartition((name, r, c, a, min(a + self.at_once, n))) for a in range(0, n, self.at_once)]
        return out or [InputPartition(("", 0, 0, 0, 0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        name, top, left, first, last = partition.value
        files, _ = located(self.path)
        if first == last:
            return
        with files.open_input_file(name) as f:
            tiff = Tiff(lambda at, n: f.read_at(n, at))
            for k in range(first, last):
                r, c, v = tiff.piece(k)
                rows, columns = v.shape
                if not self._meets(top + r, left + c, rows, columns):
                    continue
                v = v.astype(np.float64).reshape(-1)
                rr, cc = np.divmod(np.arange(rows * columns), columns)
                masked = ~np.isfinite(v) | (v == tiff.nodata if tiff.nodata is not None else False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(v)), pa.array((rr + r + top).astype(np.int32)), pa.array((cc + c + left).astype(np.int32)), pa.array(v, mask=masked)], ["file", "r", "c", "value"]
                )


class TiffWriter(DataSourceArrowWriter):
    """Rows (block_r, block_c, r, c, value), those of a block together. Options: path, block, nodata, palette (JSON), grid (JSON)."""

    def __init__(self, options, overwrite: bool):
        self.path, self.block, self.nodata = options["path"].removeprefix("file:"), int(options["block"]), float(options["nodata"])
        self.palette = {int(k): tuple(v) for k, v in json.loads(options["palette"]).items()} if "palette" in options else None
        self.grid, self.overwrite = Grid(**json.loads(options["grid"])), overwrite
        self.own = f"blocks-{uuid.uuid4().hex}"
        self.staging = f"{self.path}/.staging-{self.own}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Blocks:
        os.makedirs(self.staging, exist_ok=True)
        files, now, values, attempt = [], None, None, uuid.uuid4().hex[:8]

        def close() -> None:
            r, c = now[0] * self.block, now[1] * self.block
            g = self.grid
            own = Grid(g.west + c * g.dx, g.north - r * g.dy, g.dx, g.dy, g.epsg)
            used = np.argwhere(values != self.nodata) if self.nodata == self.nodata else np.argwhere(~np.isnan(values))
            rows, columns = (used.max(0) + 1).tolist() if len(used) else (1, 1)
            name = f"{now[0]}_{now[1]}-{attempt}.tif"
            with open(f"{self.staging}/{name}", "wb") as f:
                f.write(tiff_bytes(values[:rows, :columns], own, self.nodata, self.palette))
            files.append({"file": f"{self.own}/{name}", "r": r, "c": c, "rows": rows, "columns": columns})

        for batch in iterator:
            br, bc, r, c = (batch.column(k).to_numpy() for k in range(4))
            v = batch.column(4).cast(pa.float64()).fill_null(self.nodata).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(br) != 0) | (np.diff(bc) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(br)]):
                if a == b:
                    continue
                if now != (br[a], bc[a]):
                    if now is not None:
                        close()
                    now, values = (int(br[a]), int(bc[a])), np.full((self.block, self.block), self.nodata)
                values[r[a:b] - now[0] * self.block, c[a:b] - now[1] * self.block] = v[a:b]
        if now is not None:
            close()
        return Blocks(files)

    def commit(self, messages: list[Blocks | None]) -> None:
        blocks = [b for m in messages if m is not None for b in m.files]
        os.makedirs(self.staging, exist_ok=True)
        wanted = {b["file"].rpartition("/")[2] for b in blocks}
        for name in os.listdir(self.staging):  # of attempts that were run again
            if name not in wanted:
                os.remove(f"{self.staging}/{name}")
        index = f"{self.path}/index.json"
        before = json.load(open(index))["blocks"] if os.path.exists(index) else []
        os.rename(self.staging, f"{self.path}/{self.own}")
        with open(f"{self.path}/.{self.own}.json", "w") as f:
            json.dump({"blocks": ([] if self.overwrite else before) + blocks}, f)
        os.replace(f"{self.path}/.{self.own}.json", index)
        for folder in {b["file"].partition("/")[0] for b in before} if self.overwrite else ():
            shutil.rmtree(f"{self.path}/{folder}", ignore_errors=True)

    def abort(self, messages: list[Blocks | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)
        if os.path.isdir(self.path) and not os.listdir(self.path):
            os.rmdir(self.path)


def coarse_factor(cells: DataFrame, most: int, limit: int = 16) -> int:
    """The least of 1, 2, 4, ... by which the grid of cells (r, c) must be coarsened to have `most` cells; refused beyond `limit`."""
    size = cells.agg((F.max("r") - F.min("r") + 1).alias("rows"), (F.max("c") - F.min("c") + 1).alias("columns")).first()
    factor = 1
    while size.rows and -(-size.rows // factor) * -(-size.columns // factor) > most:
        factor *= 2
        if factor > limit:
            raise ValueError(f"{size.rows} by {size.columns} cells don't fit {most} even at a {limit}th")
    return factor


def write_raster(cells: DataFrame, path: str, grid: Grid = Grid(), value: str = "value", palette: Mapping[int, tuple[int, int, int]] | None = None, nodata: float | None = None, most: int | None = None, block: int = 1024, mode: str = "overwrite") -> int:
    """Writes cells (r, c from 0, value) as GeoTIFF blocks and gives the factor they were coarsened by: means of float rasters, the most frequent code (the
    least of equal ones) of rasters with a palette, until there are `most` cells. A palette makes bytes; nodata is NaN, or 255 with one."""
    nodata = (255.0 if palette is not None else float("nan")) if nodata is None else float(nodata)
    factor = coarse_factor(cells, most) if most is not None else 1
    cells = cells.select("r", "c", F.col(value).cast("double").alias("value"))
    if factor > 1:
        reduced = F.mode("value", True) if palette is not None else F.avg("value")
        cells = cells.groupBy(F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c")).agg(reduced.alias("value"))
    own = Grid(grid.west, grid.north, grid.dx * factor, grid.dy * factor, grid.epsg)
    at = lambda k: F.floor(F.col(k) / block).cast("int").alias(f"block_{k}")
    dealt = cells.select(at("r"), at("c"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "value").repartition("block_r", "block_c").sortWithinPartitions("block_r", "block_c")
    spark = cells.sparkSession
    spark.dataSource.register(GeoTiffs)
    out = dealt.write.format("geotiffs").mode(mode).option("path", path).option("block", block).option("nodata", nodata).option("grid", json.dumps(own.__dict__))
    (out if palette is None else out.option("palette", json.dumps(palette))).save()
    return factor


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """(file, r, c, value) of a raster's cells; see GeoTiffs."""
    spark.dataSource.register(GeoTiffs)
    push_filters(spark)
    return spark.read.format("geotiffs").option("path", path).load()
