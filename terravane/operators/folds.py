"""Recurrences over days, and paths through a wind field."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fire import START, bui, day_length, dc_next, dmc_next, ffmc_next, fwi, isi


def _start(code: str) -> Column:
    """A code's start as a value that may be NULL for all that Spark knows: a fold that begins with a plain literal takes the code for one that never
    is, and makes a number of the NULL that a masked day leaves."""
    return F.when(F.size("days") >= 0, F.lit(START[code]))


def fire_weather(weather: DataFrame, keys: Sequence[str], day: str = "day", t: str = "t", h: str = "h", w: str = "w", rain: str = "rain", lat: Column | None = None) -> DataFrame:
    """The six codes of the last day by keys, from daily noon weather: a fold over each cell's days in order.

    A cell's days, a season or so, travel as one array; the fold itself is an expression.
    """
    lat = F.lit(0.0) if lat is None else lat
    daily = F.struct(F.col(day).alias("day"), F.col(t).alias("t"), F.col(h).alias("h"), F.col(w).alias("w"), F.col(rain).alias("rain"), day_length(lat, F.col(day), "dmc").alias("le"), day_length(lat, F.col(day), "dc").alias("lf"))
    season = weather.groupBy(*keys).agg(F.array_sort(F.collect_list(daily)).alias("days"))
    start = F.struct(*(_start(k).alias(k) for k in START))

    def step(a: Column, x: Column) -> Column:
        return F.struct(
            ffmc_next(a.ffmc, x.t, x.h, x.w, x.rain).alias("ffmc"),
            dmc_next(a.dmc, x.t, x.h, x.rain, x.le).alias("dmc"),
            dc_next(a.dc, x.t, x.rain, x.lf).alias("dc"),
        )

    folded = season.select(*keys, F.aggregate("days", start, step).alias("s"), F.element_at("days", -1).alias("last"))
    out = folded.select(*keys, F.col("last.day").alias("day"), "s.ffmc", "s.dmc", "s.dc", isi(F.col("s.ffmc"), F.col("last.w")).alias("isi"), bui(F.col("s.dmc"), F.col("s.dc")).alias("bui"))
    return out.withColumn("fwi", fwi(F.col("isi"), F.col("bui")))


def drought_code_series(weather: DataFrame, keys: Sequence[str], day: str = "day", t: str = "t", rain: str = "rain", lat: Column | None = None) -> DataFrame:
    """The drought code of every day by keys."""
    lat = F.lit(0.0) if lat is None else lat
    daily = F.struct(F.col(day).alias("day"), F.col(t).alias("t"), F.col(rain).alias("rain"), day_length(lat, F.col(day), "dc").alias("lf"))
    season = weather.groupBy(*keys).agg(F.array_sort(F.collect_list(daily)).alias("days"))
    start = F.struct(_start("dc").alias("dc"), F.expr("cast(array() as array<struct<day:date,dc:double>>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        now = dc_next(a.dc, x.t, x.rain, x.lf)
        return F.struct(now.alias("dc"), F.concat(a.out, F.array(F.struct(x.day.alias("day"), now.alias("dc")))).alias("out"))

    return season.select(*keys, F.inline(F.aggregate("days", start, step, lambda a: a.out)))


def first_crossing(series: DataFrame, keys: Sequence[str], day: str, value: str, bound: float) -> DataFrame:
    """First day at or above a bound by keys, and whether that is the first day there is, so that it may have come earlier."""
    first = F.min(F.when(F.col(value) >= bound, F.col(day)))
    return series.groupBy(*keys).agg(first.alias("crossed"), (first == F.min(day)).alias("censored"))


def parcels(seeds: DataFrame, wind: DataFrame, hours: int, minutes: int = 20, step: float = 1.0) -> DataFrame:
    """Paths (traj_id, k, lon, lat) of parcels from seeds (traj_id, lon, lat, hour) carried by winds u, v in m/s on a
    grid (r, c, hour) of `step` degrees: midpoint steps of `minutes`, nearest cell, linear in time.

    The wind field is broadcast and must be small: an hourly field of one region, at most a few MB.
    """
    field = wind.select("r", "c", "hour", "u", "v")
    if field.count() > 500_000:
        raise ValueError("the wind field is too large to broadcast; take a region or fewer hours")
    table = field.toPandas()
    shape = tuple(int(table[k].max()) + 1 for k in ("hour", "r", "c"))
    u, v = np.zeros(shape), np.zeros(shape)
    at = (table.hour.to_numpy(), table.r.to_numpy(), table.c.to_numpy())
    u[at], v[at] = table.u, table.v
    shared = seeds.sparkSession.sparkContext.broadcast((u, v))

    def velocity(lon: np.ndarray, lat: np.ndarray, hour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, v = shared.value
        last = u.shape[0] - 1
        h = np.clip(hour, 0, last)
        h0 = np.floor(h).astype(int)
        h1, f = np.minimum(h0 + 1, last), h - np.floor(h)
        r = np.clip(np.floor(lat / step), 0, u.shape[1] - 1).astype(int)
        c = np.clip(np.floor(lon / step), 0, u.shape[2] - 1).astype(int)
        east, north = u[h0, r, c] * (1 - f) + u[h1, r, c] * f, v[h0, r, c] * (1 - f) + v[h1, r, c] * f
        metres = 111_320.0
        return east * 3600 / (metres * np.cos(np.radians(lat))), north * 3600 / metres

    def run(batches):
        dt = minutes / 60
        for pdf in batches:
            lon, lat, hour = pdf.lon.to_numpy(float), pdf.lat.to_numpy(float), pdf.hour.to_numpy(float)
            for k in range(int(hours / dt) + 1):
                yield pd.DataFrame({"traj_id": pdf.traj_id, "k": k, "lon": lon, "lat": lat})
                du, dv = velocity(lon, lat, hour)
                mu, mv = velocity(lon + du * dt / 2, lat + dv * dt / 2, hour + dt / 2)
                lon, lat, hour = lon + mu * dt, lat + mv * dt, hour + dt

    return seeds.select("traj_id", "lon", "lat", "hour").mapInPandas(run, "traj_id long, k int, lon double, lat double")
