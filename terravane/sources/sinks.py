"""Sinks of text and tables for people and other programs."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(cells: DataFrame, path: str) -> None:
    """Cells or points as CSV files with a header; masked values are empty."""
    cells.write.mode("overwrite").option("header", True).csv(path)


def markdown(table: DataFrame, columns: Sequence[str], order: Sequence[str | Column], most: int = 1000) -> str:
    """A table of a report as Markdown. Reports are short: more than `most` rows are refused, not cut."""
    rows = table.orderBy(*order).select(*(F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in columns)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report's table holds {most} rows at most")
    cell = lambda x: x.replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(x) for x in r) + " |" for r in rows]) + "\n"


def page(title: str, parts: Sequence[tuple[str, str]]) -> str:
    """A page of titled texts that needs no other file."""
    body = "".join(f"<h2>{html.escape(head)}</h2><pre>{html.escape(text)}</pre>" for head, text in parts)
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}"


def class_raster(cells: DataFrame, code: str, palette: dict[int, str]) -> DataFrame:
    """Cells with a byte code, 255 where there is none, and its colour; codes without a colour are refused by the caller's check `colour IS NULL`."""
    colours = F.create_map(*(x for k, c in palette.items() for x in (F.lit(k), F.lit(c))))
    return cells.select("r", "c", F.coalesce(F.col(code).cast("int"), F.lit(255)).alias("code"), F.element_at(colours, F.col(code).cast("int")).alias("colour"))


# fixed values: settings of a time-series run and the suffixes of the files they name; the first two are always set
SERIES_BANDS = {
    "mintpy.load.unwFile": "_unw_phase.tif",
    "mintpy.load.corFile": "_corr.tif",
    "mintpy.load.demFile": "_dem.tif",
    "mintpy.load.incAngleFile": "_inc_map.tif",
}


def series_config(files: DataFrame, product: str, name: str, folder: str) -> str:
    """Settings for the bands there are; one without a file would stop the run, so it is left out. Incidence angles belong to a track, not to
    a pair: one file stands for all, that of the first product by name."""
    ends = lambda s: F.endswith(F.col(name), F.lit(s))
    least = lambda s: F.min(F.when(ends(s), F.concat_ws("/", product, name)))
    found = files.agg(*(least(s).alias(f"b{k}") for k, s in enumerate(SERIES_BANDS.values()))).first()
    lines = ["mintpy.load.processor = hyp3"]
    for k, (key, suffix) in enumerate(SERIES_BANDS.items()):
        if k < 2 or found[k]:
            lines.append(f"{key} = {folder}/" + (found[k] if suffix == "_inc_map.tif" else f"*/*{suffix}"))
    return "\n".join(lines) + "\n"
