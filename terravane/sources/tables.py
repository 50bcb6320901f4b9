"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


class EndpointRows:
    """Points of trajectory endpoint files from their lines: called with rows (file, k, line) PARTITION BY file ORDER BY k. A file's header gives its own
    length; years before 70 belong to this century; a record with fewer than 12 fields is an error."""

    def __init__(self):
        self.header, self.direction, self.grids, self.paths, self.seen = [], "FORWARD", None, None, 0

    def eval(self, row: Row) -> Iterator[tuple]:
        line = row["line"].split()
        if not line:
            return
        self.seen += 1
        if self.grids is None:
            self.grids = int(line[0])
        elif self.paths is None and self.seen == self.grids + 2:
            self.paths, self.direction = int(line[0]), (line[1] if len(line) > 1 else "FORWARD").upper()
        elif self.paths is not None and self.seen > self.grids + self.paths + 3:
            if len(line) < 12:
                raise ValueError(f"endpoint record with fewer than 12 fields: {row['line']}")
            year = int(line[2])
            at = f"{year + (2000 if year < 70 else 1900):04d}-{int(line[3]):02d}-{int(line[4]):02d} {int(line[5]):02d}:{int(line[6]):02d}:00"
            yield row["file"], self.direction, int(line[0]), at, float(line[10]), float(line[9]), float(line[11])

    def terminate(self) -> Iterator[tuple]:
        if self.seen and self.paths is None:
            raise ValueError("an endpoint file without a header")
        return iter(())


def register_tables(spark: SparkSession) -> None:
    """Makes endpoint_rows(TABLE(lines) PARTITION BY file ORDER BY k) known to SQL; lines has columns file, k and line."""
    spark.udtf.register("endpoint_rows", udtf(EndpointRows, returnType="file string, direction string, traj_id int, at string, lon double, lat double, height double"))


def register_lines(spark: SparkSession, path: str, view: str = "lines") -> None:
    """The lines of text files as a view (file, k, line)."""
    from pyspark.sql import functions as F

    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("k", "line"))
    text.createOrReplaceTempView(view)
