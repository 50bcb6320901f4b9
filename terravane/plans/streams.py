"""Queries: streams run over all data at hand, held against the same windows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import rocksdb, shared_folder
from ..sources.adapters import WEATHER, adapter, adapter_sql, weather
from ..streaming.feeds import available, closed, counters, drought_codes, first_seen, frames, glow, latest_codes, sessions, stream
from ..streaming.jobs import known_jobs, submit
from .dynamics import _ONLY_DC
from .registry import query, r6

_SCENE = adapter_sql("scene")


def events(spark, d):
    return stream(spark, f"{d}/events.parquet", "ts")


@query("SELECT time_bucket(interval 30 minutes, ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def st2_frames(spark, d):
    f = available(frames(events(spark, d)), "update", ["start"])
    return f.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", r6(F.col("mean")).alias("mean"))


@query("WITH f AS (SELECT ts, unnest(generate_series(time_bucket(interval 30 minutes, ts) + interval 30 minutes, time_bucket(interval 30 minutes, ts) + interval 12 hours, interval 30 minutes)) AS frame FROM events) SELECT frame, count(*) AS n, round(sum(1 - floor(epoch(frame) - floor(epoch(ts))) / 43200), 6) AS glow FROM f GROUP BY frame")
def st3_glow(spark, d):
    g = available(glow(events(spark, d)), "update", ["frame"])
    return g.select(F.col("frame").cast("timestamp_ntz").alias("frame"), "n", r6(F.col("glow")).alias("glow"))


@query("SELECT ts::date AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st4_counters(spark, d):
    return available(counters(events(spark, d)), "update", ["day", "event_type"])


@query("WITH s AS (SELECT user_id, ts, (ts > lag(ts) OVER w + interval 6 hours)::int AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(coalesce(cut, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k")
def st6_sessions(spark, d):
    s = closed(spark, f"{d}/events.parquet", "ts", lambda feed: sessions(feed, "user_id"))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def st1_first_seen(spark, d):
    return available(first_seen(events(spark, d), ["user_id", "event_type"]).select("user_id", "event_type"), "append")


@query(f"WITH RECURSIVE weather AS ({WEATHER}), {_ONLY_DC} SELECT cell, day, round(dc, 6) AS dc FROM s WHERE k > 0")
def st8_drought_state(spark, d):
    own, folder = rocksdb(spark), shared_folder(spark)
    weather(spark, d).select("cell", "day", "t", "rain").write.parquet(folder)
    out = latest_codes(available(drought_codes(stream(own, folder)), "append"))
    return out.select("cell", "day", r6(F.col("dc")).alias("dc"))


@query(f"WITH {_SCENE}, a AS (SELECT scene_id, cloud_pct FROM scene WHERE cloud_pct < 4) SELECT 'job-' || scene_id AS name, min(CASE WHEN cloud_pct < 2 THEN 0 ELSE 1 END)::bigint AS batch FROM a GROUP BY 1")
def st7_submitted_jobs(spark, d):
    """Jobs asked for twice are submitted once: a second batch that holds the first one adds only what is new."""
    ledger = shared_folder(spark)
    s = adapter(spark, d, "scene").select(F.concat(F.lit("job-"), F.col("scene_id").cast("string")).alias("name"), "cloud_pct")
    submit(s.where("cloud_pct < 2"), ledger, 0)
    submit(s.where("cloud_pct < 4"), ledger, 1)
    submit(s.where("cloud_pct < 4"), ledger, 1)  # run again after a crash
    return known_jobs(spark, ledger)
