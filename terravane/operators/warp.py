"""Grids of other projections, and images that lie a little apart."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .paths import bilinear
from .quantiles import quantiles

Mapping2 = Callable[[Column, Column], tuple[Column, Column]]


def resampled(target: DataFrame, cells: DataFrame, value: str, to_place: Mapping2, from_place: Mapping2, how: str = "nearest") -> DataFrame:
    """(r, c, value) of the target's cells (r, c) from a source grid's cells (r, c, value) of another projection, by inverse mapping: to_place gives a
    target cell's longitude and latitude from its (c, r), from_place a place's position (c, r) in the source's cell units, centres at whole numbers.
    how: nearest, or bilinear (NULL where one of the four is missing)."""
    lon, lat = to_place(F.col("c"), F.col("r"))
    places = target.select("r", "c", lon.alias("_lon"), lat.alias("_lat"))
    x, y = from_place(F.col("_lon"), F.col("_lat"))
    at = places.select(F.col("r").alias("_r"), F.col("c").alias("_c"), x.alias("_x"), y.alias("_y"))
    if how == "bilinear":
        return bilinear(at, cells, ["_r", "_c"], F.col("_x"), F.col("_y"), value).withColumnsRenamed({"_r": "r", "_c": "c"})
    if how != "nearest":
        raise ValueError(f"how is nearest or bilinear, not {how}")
    near = at.withColumns({"r": F.floor(F.col("_y") + 0.5).cast("int"), "c": F.floor(F.col("_x") + 0.5).cast("int")})
    return near.join(cells.select("r", "c", value), ["r", "c"], "left").select(F.col("_r").alias("r"), F.col("_c").alias("c"), value)


def _cross(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    n, m = one.shape
    window = np.outer(np.hanning(n), np.hanning(m))
    a, b = (np.fft.fft2((x - x.mean()) / (x.std() + 1e-10) * window) for x in (one, two))
    return b * a.conj()


def shift_of(one: np.ndarray, two: np.ndarray) -> tuple[float, float, float]:
    """(dy, dx, response): how far the second image's content lies from the first one's. Phase correlation under a Hann window gives whole pixels, and
    the share of the correlation around its peak is the response; what remains is the slope of the phase between the parts that then overlap,
    fitted over the lower frequencies by their strength."""
    n, m = one.shape
    cross = _cross(one, two)
    peak = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
    r, c = np.unravel_index(peak.argmax(), peak.shape)
    near = np.maximum(peak[np.ix_(np.arange(r - 2, r + 3) % n, np.arange(c - 2, c + 3) % m)], 0).sum()
    dy, dx = (r + n // 2) % n - n // 2, (c + m // 2) % m - m // 2
    if abs(dy) > n // 2 - 4 or abs(dx) > m // 2 - 4:
        return float(dy), float(dx), 0.0
    first = one[max(-dy, 0) : n - max(dy, 0), max(-dx, 0) : m - max(dx, 0)]
    cross = _cross(first, two[max(dy, 0) : n + min(dy, 0), max(dx, 0) : m + min(dx, 0)])
    fy, fx = (np.fft.fftfreq(k) for k in cross.shape)
    u, v = np.meshgrid(fy, fx, indexing="ij")
    use = (np.hypot(u, v) < 0.25) & (u * u + v * v > 0)
    turn, weight = -np.angle(cross[use]) / (2 * np.pi), np.abs(cross[use])
    design = np.stack((u[use], v[use]), 1)
    fit = np.linalg.lstsq(design * weight[:, None], turn * weight, rcond=None)[0]
    fit = np.clip(fit, -1.5, 1.5)
    return float(dy + fit[0]), float(dx + fit[1]), float(near)


def _offsets(size: int, step: int, valid: float):
    def run(table: pa.Table) -> pa.Table:
        pr, pc = table["pr"][0].as_py(), table["pc"][0].as_py()
        images = np.zeros((2, size, size))
        images[table["k"].to_numpy(), table["r"].to_numpy() - pr * step, table["c"].to_numpy() - pc * step] = table["value"].to_numpy()
        rows = []
        if ((images != 0).all(0)).mean() >= valid:
            dy, dx, response = shift_of(*images)
            rows.append((pr * step + size / 2, pc * step + size / 2, dy, dx, response))
        columns = list(zip(*rows)) or [[]] * 5
        return pa.table([pa.array(x, pa.float64()) for x in columns], names=["y", "x", "dy", "dx", "response"])

    return run


def image_offsets(one: DataFrame, two: DataFrame, value: str, size: int = 64, step: int | None = None, valid: float = 0.5) -> DataFrame:
    """(y, x, dy, dx, response): offsets between two images on one grid (r, c, value; no data is 0 or missing) in square patches, one every `step` cells. Patches
    are dealt out by shuffle, each to a task of its own; those with too little in common give no row."""
    step = size if step is None else step
    both = one.select(F.lit(0).alias("k"), "r", "c", F.col(value).cast("double").alias("value")).union(two.select(F.lit(1), "r", "c", F.col(value).cast("double"))).where("value IS NOT NULL")
    # patches p with p * step <= r < p * step + size
    span = lambda x: F.explode(F.sequence(F.ceil((F.col(x) - size + 1) / step).cast("int"), F.floor(F.col(x) / step).cast("int")))
    dealt = both.withColumn("pr", span("r")).withColumn("pc", span("c"))
    return dealt.groupBy("pr", "pc").applyInArrow(_offsets(size, step, valid), "y double, x double, dy double, dx double, response double")


def fitted_offsets(offsets: DataFrame, least: float = 0.0, rounds: int = 5, spread: float = 3.0) -> dict[str, tuple[float, float, float]]:
    """{dy: (a, by, bx), dx: ...}: planes a + by * y + bx * x through the offsets with a response over `least`. Patches further off than `spread` robust
    deviations (at least a hundredth of a pixel) in either direction are rejected, and the planes fitted anew until none is."""
    kept = written(offsets.where(F.col("response") > least))
    names, before = ("dy", "dx"), None
    for _ in range(rounds):
        products = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in ("y", "x") for b in ("y", "x", "dy", "dx")]
        s = kept.agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in ("y", "x", "dy", "dx")), *products).first()
        if s.n < 6:
            raise ValueError(f"{s.n} patches are too few for a plane")
        normal = np.array([[s.n, s.y, s.x], [s.y, s.y_y, s.y_x], [s.x, s.y_x, s.x_x]])
        planes = {k: np.linalg.solve(normal, np.array([s[k], s[f"y_{k}"], s[f"x_{k}"]])) for k in names}
        if s.n == before:
            break
        before = s.n
        away = {k: F.col(k) - (float(p[0]) + F.col("y") * float(p[1]) + F.col("x") * float(p[2])) for k, p in planes.items()}
        rest = kept.withColumns({f"_{k}": F.abs(x) for k, x in away.items()})
        bounds = {k: max(spread * 1.4826 * quantiles(rest, f"_{k}", {"m": 0.5}).first().m, 0.01) for k in names}
        kept = written(rest.where(" AND ".join(f"_{k} <= {bounds[k]!r}" for k in names)).select(offsets.columns))
    return {k: tuple(map(float, p)) for k, p in planes.items()}
