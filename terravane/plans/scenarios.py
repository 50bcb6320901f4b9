"""Named scenarios, each built by the query that answers it, and the chain of seven with its brief."""

from __future__ import annotations

import datetime
import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assess import claims
from ..operators.checks import step_dates
from ..sources.adapters import View, viewing
from . import coast, dynamics, grids, more, motion, reports, spectral, stacks, zonal  # noqa: F401  the queries that build scenarios
from .orchestration import chain, register
from .registry import QUERIES

#: Scenario: the query that builds it. The four of change between two dates are registered where they are made.
BUILT_BY = {
    "mining": "ch4_mining",
    "urban-trend": "ch5_urban_trend",
    "flood": "ch6_flood",
    "disturbance": "ch7_disturbance",
    "imagery": "ch3_imagery_state",
    "urban-history": "ch13_urban_growth",
    "insar": "ch26_trusted_range",
    "insar-series": "ag16_velocity",
    "smoke-track": "rc6_path_lengths",
    "smoke-exposure": "ag8_person_days",
    "fire-record": "rc4_first_crossing",
    "fire-danger": "ag4_zone_class_table",
    "fire-history": "ag10_burned_by_year",
    "fire-hotspot": "ag13_counts_by_zone",
    "haze": "su3_haze_run",
    "drought": "ch15_combined_drought",
    "coastline": "ch24_coast_change",
    "transit-access": "ch35_served_shares",
    "island-heat": "ch23_trend",
    "urban-heat": "ch21_matched_heat_island",
    "forest-history": "ch11_forest_loss",
    "population-change": "ch14_population_class",
}


#: Queries whose tables hold no days or places to choose.
UNDATED = ("rc6_path_lengths", "ch35_served_shares", "ch23_trend")


def _built(query: str):
    """A builder that sees the tables from `start` to `end` and within `box`, and hands the query's own thresholds on to it."""
    own = set(list(inspect.signature(QUERIES[query]).parameters)[2:])

    def build(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
        view = View(**{k: options.pop(k) for k in VIEWED if k in options and k not in own})
        with viewing(view):
            return QUERIES[query](spark, sf_dir, **options)

    return build, own | (set() if query in UNDATED else set(VIEWED))


VIEWED = ("start", "end", "box")

for _name, _query in BUILT_BY.items():
    _build, _options = _built(_query)
    register(_name, needs=("sf_dir",), takes=_options)(_build)

#: Steps of the chain and the date that tells them apart: one that a step's data start from, or the last one they reach.
STEPS = (("danger", "fire-danger", "end"), ("hotspots", "fire-hotspot", "end"), ("history", "fire-history", "end"), ("haze", "haze", "haze_start"), ("drought", "drought", "drought_start"), ("exposure", "smoke-exposure", "haze_start"), ("record", "fire-record", "forecast_end"))


def fire_season(spark: SparkSession, sf_dir: str, end: datetime.date) -> tuple[dict[str, DataFrame], dict[str, str], dict[str, datetime.date]]:
    """The chain of seven: results, the errors of steps that failed (they stop no other), and the date each step starts from."""
    dates = step_dates(end)
    season = {"start": dates["haze_start"], "end": end}
    # drought is told from the years before, which stay in view; the record runs up from long before the season, and reaches the forecast
    views = {"haze": season, "exposure": season, "drought": {"end": end, "year": end.year}, "record": {"start": dates["drought_start"], "end": dates["forecast_end"]}}
    done, failed = chain(spark, [(label, name, {"sf_dir": sf_dir, **views.get(label, {"end": dates[at]})}) for label, name, at in STEPS])
    return done, failed, {label: dates[at] for label, _, at in STEPS}


def brief(done: dict[str, DataFrame], failed: dict[str, str]) -> DataFrame:
    """One line for each step that was built, with its number of rows, and one with the reason for each that wasn't."""
    lines = None
    for label, df in done.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(label).alias("step"), F.format_string("%d rows", "n").alias("text"))
        lines = one if lines is None else lines.union(one)
    if failed:
        spark = next(iter(done.values())).sparkSession if done else SparkSession.active()
        missing = spark.createDataFrame(sorted(failed.items()), "step string, text string")
        lines = missing if lines is None else lines.union(missing)
    return lines


def season_claims(done: dict[str, DataFrame], share: float = 0.01) -> DataFrame:
    """(zone, claim): what the chain's numbers bear out about the danger in each zone, slivers left out; see assess.claims."""
    danger = done["danger"].where("zone_id IS NOT NULL")
    classes = [c for c in danger.columns if c.startswith("class_")]
    known = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    zones = danger.select(F.col("zone_id").cast("string").alias("zone"), F.col("total").alias("ha"), *((100 * F.try_divide(F.col(c), known)).alias(c) for c in classes))
    return claims(zones, "zone", "ha", classes, share=share)
