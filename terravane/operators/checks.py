"""What is settled before data are read: areas, windows and options, and what can't be done is refused with its reason."""

from __future__ import annotations

import datetime
import hashlib
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: ways to name an area, the first one given counts
PRECEDENCE = ("site", "city", "location", "point", "country", "admin", "areas", "bbox")


def chosen_area(options: Mapping[str, object]) -> tuple[str, object]:
    """The way an area is named, and its value."""
    for name in PRECEDENCE:
        if options.get(name) not in (None, "", ()):
            return name, options[name]
    raise ValueError(f"no area: give one of {', '.join(PRECEDENCE)}")


def box_around(lon: float, lat: float, km: float) -> tuple[float, float, float, float]:
    """A square of 2 * km around a place: west, south, east, north."""
    import math

    dx, dy = km / (111.32 * math.cos(math.radians(lat))), km / 110.57
    return lon - dx, lat - dy, lon + dx, lat + dy


def checked_box(text: str) -> tuple[float, float, float, float]:
    """west,south,east,north as numbers; refuses other counts, other than numbers, and boxes without inside."""
    parts = text.split(",")
    try:
        w, s, e, n = map(float, parts)
    except ValueError:
        raise ValueError(f"a box is west,south,east,north, not {text!r}") from None
    if not (-180 <= w < e <= 180 and -90 <= s < n <= 90):
        raise ValueError(f"box {text!r} has no inside or leaves the globe")
    return w, s, e, n


def resolved(names: DataFrame, wanted: str | Column, first: str, second: str) -> DataFrame:
    """Places of a name at the first level, or at the second one where the first has none. names: columns first and second."""
    low = F.lower(F.trim(F.lit(wanted)))
    marked = names.withColumn("level", F.when(F.lower(F.trim(first)) == low, 1).when(F.lower(F.trim(second)) == low, 2)).where("level IS NOT NULL")
    best = marked.agg(F.min("level").alias("_best"))  # one row
    return marked.join(F.broadcast(best), F.col("level") == F.col("_best")).drop("_best")


def some(found: DataFrame, what: str) -> DataFrame:
    if found.isEmpty():
        raise ValueError(f"nothing found for {what}")
    return found


def checked_season(start: datetime.date, end: datetime.date, spinup: int, least: int = 30) -> None:
    if spinup < least:
        raise ValueError(f"a spin-up of {spinup} days is too short: {least} at least")
    if end <= start:
        raise ValueError(f"the season ends on {end}, not after its start {start}")


def checked_columns(df: DataFrame, needed: Sequence[str], what: str) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{what} has no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def checked_epochs(epochs: Sequence[int], n: int = 3) -> None:
    if len(epochs) != n or list(epochs) != sorted(set(epochs)):
        raise ValueError(f"{n} different epochs in order are needed, not {list(epochs)}")


def checked_receptors(direction: str, receptors: Sequence) -> None:
    if receptors and direction != "backward":
        raise ValueError("receptors are where backward runs start; a forward run starts at fires")


def checked_scale(asked: float, scales: Mapping[str, float]) -> float:
    """The pixel size to use: that asked for, if no input is coarser; a finer one would only seem finer."""
    name = max(scales, key=scales.get)
    if asked < scales[name]:
        raise ValueError(f"a pixel of {asked} is finer than {name}'s {scales[name]}")
    return asked


def complete_season(checkpoints: DataFrame, day: str, wanted: Sequence[datetime.date]) -> DataFrame:
    """checkpoints, if there is one for each wanted day; else refused with the days that are missing."""
    days = checkpoints.sparkSession.createDataFrame([(d,) for d in wanted], "_day date")
    missing = [r._day for r in days.join(checkpoints.select(F.col(day).alias("_day")).distinct(), "_day", "left_anti").orderBy("_day").collect()]
    if missing:
        raise ValueError(f"{len(missing)} of {len(wanted)} checkpoints are missing: {', '.join(map(str, missing))}")
    return checkpoints


def run_id(scenario: str, name: str, at: datetime.datetime) -> str:
    """timestamp_scenario_name_token; the token keeps runs of one second apart."""
    clean = "".join(c if c.isalnum() else "-" for c in name.lower()).strip("-")
    stamp = "{:%Y%m%d}-{:%H%M%S}".format(at, at)
    token = hashlib.sha256(f"{scenario}/{name}/{at.isoformat()}/{uuid.uuid4()}".encode()).hexdigest()[:8]
    return "_".join((stamp, scenario, clean, token))


def step_dates(end: datetime.date) -> dict[str, datetime.date]:
    """Dates that the steps of a chain derive from its end."""
    day = datetime.timedelta(1)
    return {"end": end, "haze_start": end - 90 * day, "drought_start": end - 210 * day, "forecast_end": end + 4 * day}


def run_steps(steps: Sequence[tuple[str, bool, object]]) -> dict[str, str]:
    """Runs (name, required, function) in order and returns each one's state. An optional step that fails is reported; a required one
    ends the run, and the steps after it are not run."""
    states: dict[str, str] = {}
    stopped = False
    for name, required, step in steps:
        if stopped:
            states[name] = "not run"
            continue
        try:
            step()
            states[name] = "done"
        except Exception as e:  # noqa: BLE001
            states[name] = f"failed: {e}"
            stopped = required
    return states
