"""Plans over scenes and jobs: pairs, prices, names, chains of steps, and a registry of scenarios."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import rank_pairs


def pair_name(first: Column, second: Column, variant: Column | None = None) -> Column:
    """A name that depends on the two granules alone, in any order, and on the processing variant."""
    parts = F.concat_ws("|", F.array_sort(F.array(first.cast("string"), second.cast("string"))), *([] if variant is None else [variant]))
    return F.substring(F.sha1(parts), 1, 8)


def pair_plan(scenes: DataFrame, by: Sequence[str], most_apart: int, most_days: int, known: DataFrame, price: int) -> DataFrame:
    """One row: pairs wanted, those already there (known: scene_1, scene_2, in any order), their span, the price of all and what is still due.
    Pairs meet by their scenes: names have 32 bits, which among some hundred thousands of pairs are shared by chance."""
    own = [f(F.col("scene_1"), F.col("scene_2")).alias(k) for f, k in ((F.least, "_a"), (F.greatest, "_b"))]
    pairs = rank_pairs(scenes, by, "day", "scene_id", most_apart, most_days).select("*", *own)
    marked = pairs.join(known.select(*own).distinct().withColumn("there", F.lit(True)), ["_a", "_b"], "left")
    out = marked.agg(F.count("*").alias("pairs"), F.count("there").alias("already"), F.min("day_1").alias("first"), F.max("day_2").alias("last"))
    return out.withColumns({"price": F.col("pairs") * price, "due": (F.col("pairs") - F.col("already")) * price})


def track_choice(scenes: DataFrame, track: str, event: str, today: str, repeat: int = 12) -> DataFrame:
    """By track: the scene at or before an event, the one after it, the next pass from today on, and why a track can't serve yet."""
    date, now = F.lit(event).cast("date"), F.lit(today).cast("date")
    t = scenes.where(F.col("day") <= now).groupBy(track).agg(F.max(F.when(F.col("day") <= date, F.col("day"))).alias("before"), F.min(F.when(F.col("day") > date, F.col("day"))).alias("after"), F.max("day").alias("newest"))
    passes = F.floor(F.datediff(now, "newest") / repeat).cast("int") + 1
    reason = F.when(F.col("before").isNull(), "no scene before the event").when(F.col("after").isNull(), "no scene after the event yet")
    return t.select(track, "before", "after", F.date_add("newest", passes * repeat).alias("next_pass"), reason.alias("reason"))


def duplicates(jobs: DataFrame, name: str) -> DataFrame:
    return jobs.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def matched_pairs(scenes: DataFrame, by: Sequence[str], gap: int) -> DataFrame:
    """Consecutive scenes of a track that are exactly `gap` days apart, the others with the reason they are dropped."""
    w = Window.partitionBy(*by).orderBy("day", "scene_id")
    nexts = scenes.select(*by, "scene_id", "day", F.lead("scene_id").over(w).alias("scene_2"), F.lead("day").over(w).alias("day_2")).where("scene_2 IS NOT NULL")
    away = F.datediff("day_2", "day")
    return nexts.withColumn("reason", F.when(away != gap, F.concat(F.lit("gap of "), away.cast("string"), F.lit(" days"))))


@dataclass
class Scenario:
    """A named builder of a DataFrame and the options it needs."""

    build: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    defaults: dict = field(default_factory=dict)
    takes: frozenset[str] = frozenset()


SCENARIOS: dict[str, Scenario] = {}


def register(name: str, needs: Sequence[str] = (), takes: Iterable[str] = (), **defaults):
    """needs: options that must be given; takes: others that may be, besides those with a default."""

    def add(build: Callable[..., DataFrame]):
        SCENARIOS[name] = Scenario(build, tuple(needs), defaults, frozenset({*needs, *takes, *defaults}))
        return build

    return add


def run_scenario(name: str, spark: SparkSession, **options) -> DataFrame:
    """Builds a scenario's DataFrame; options override its defaults, what it needs must be there, and an option it doesn't take is refused."""
    if name not in SCENARIOS:
        raise ValueError(f"no scenario {name}; there are {', '.join(sorted(SCENARIOS))}")
    scenario = SCENARIOS[name]
    options = scenario.defaults | {k: v for k, v in options.items() if v is not None}
    if unknown := sorted(options.keys() - scenario.takes):
        raise ValueError(f"{name} takes no option {', '.join(unknown)}; there are {', '.join(sorted(scenario.takes))}")
    if missing := [n for n in scenario.needs if n not in options]:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    return scenario.build(spark, **options)


def chain(spark: SparkSession, steps: Sequence[tuple[str, str, dict]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Results of (label, scenario, options) steps that could be built, and the errors of the others; one step's
    failure doesn't stop the rest."""
    done, failed = {}, {}
    for label, name, options in steps:
        try:
            done[label] = run_scenario(name, spark, **options)
        except Exception as e:  # noqa: BLE001
            failed[label] = f"{type(e).__name__}: {e}"
    return done, failed
