"""Complete results of streams stand in files, not on the driver."""

from __future__ import annotations

import datetime
import random

from terravane.operators.folds import drought_code_series
from terravane.session import rocksdb
from terravane.streaming.feeds import available, closed, drought_codes, latest_codes, sessions, stream
from terravane.streaming.lags import keep_late, silent_sources, source_windows, union_of_sources
from terravane.streaming.watch import watched_tracks


def test_sessions_are_files(spark, tmp_path):
    path = str(tmp_path / "feed")
    for k, rows in enumerate(["(1, '2024-01-01 00:00:00'), (1, '2024-01-01 05:00:00'), (2, '2024-01-01 00:00:00')", "(1, '2024-01-01 10:00:00'), (1, '2024-01-02 00:00:00')"]):
        spark.sql(f"SELECT col1 AS k, cast(col2 AS timestamp) AS ts FROM VALUES {rows}").coalesce(1).write.mode("append").parquet(path)
    whole = available(sessions(stream(spark, path), "k"), "complete")
    out = closed(spark, path, "ts", lambda feed: sessions(feed, "k"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, out.collect()))
    assert sorted((r.k, str(r.start), r.n) for r in out.collect()) == [(1, "2024-01-01 00:00:00", 3), (1, "2024-01-02 00:00:00", 1), (2, "2024-01-01 00:00:00", 1)]
    assert out.inputFiles()


def deliver(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(df, folder, mode="append"):
    df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def test_late_days_are_folded_in_again(spark, tmp_path):
    rng = random.Random(5)
    schema = "cell long, day date, t double, rain double"
    first = datetime.date(2024, 1, 1)
    days = [(cell, first + datetime.timedelta(k), None if (cell, k) in {(2, 20), (3, 0)} else 20.0 + k % 11, 9.0 * (k % 5 == 0) if (cell, k) != (2, 30) else None) for cell in range(1, 5) for k in range(35)]
    shuffled = sorted(days, key=lambda r: (r[1] - first).days + rng.uniform(0, 12))
    own, path = rocksdb(spark), str(tmp_path / "weather")
    for k in range(4):
        deliver(spark, path, shuffled[35 * k : 35 * (k + 1)], schema)
        out = run(drought_codes(stream(own, path), keep=20), str(tmp_path / "run"))  # each time from its checkpoint
    got = {(r.cell, r.day): r.dc for r in latest_codes(out).collect()}
    want = {(r.cell, r.day): r.dc for r in drought_code_series(spark.createDataFrame(days, schema), ["cell"]).collect()}
    assert got.keys() == want.keys() and out.where("late").isEmpty() and out.count() > len(want)
    for k, x in want.items():
        assert (x is None) == (got[k] is None) and (x is None or abs(x - got[k]) < 1e-9)
    assert sum(x is None for x in want.values()) == 15 + 35
    deliver(spark, path, [(1, first, 30.0, 0.0)], schema)  # before all that the log holds
    late = run(drought_codes(stream(own, path), keep=20), str(tmp_path / "run")).where("late").collect()
    assert [(r.cell, r.day, r.dc) for r in late] == [(1, first, None)]


def test_a_watch_ends_when_its_directions_are_done(spark, tmp_path):
    schema = "event long, happened timestamp, path int, frame int, direction string, acquired timestamp"
    at = lambda d, h=0: datetime.datetime(2024, 1, 1, h) + datetime.timedelta(d)
    own, path = rocksdb(spark), str(tmp_path / "polls")
    happened = at(30)
    scene = lambda event, p, direction, day: (event, happened, p, 1, direction, at(day))
    polls = [
        [scene(1, 10, "asc", 5), scene(1, 10, "asc", 17), scene(1, 20, "desc", 8), scene(2, 10, "asc", 5), scene(3, 30, "asc", 29)],
        [scene(1, 10, "asc", 5), scene(1, 10, "asc", 31), scene(2, 10, "asc", 33), scene(1, 11, "asc", 32), scene(1, 11, "asc", 2)],
        [scene(1, 20, "desc", 34), scene(1, 12, "desc", 40), scene(1, 12, "desc", 3), scene(1, 10, "asc", 43)],
        [scene(1, 20, "desc", 46), scene(1, 10, "asc", 55), scene(9, 1, "asc", 200)],
        [scene(9, 1, "asc", 201)],
    ]
    seen = []
    for rows in polls:
        deliver(spark, path, rows, schema)
        out = run(watched_tracks(stream(own, path), "event", "happened", "acquired"), str(tmp_path / "run"))
        seen.append(out.count())
    got = sorted((r.event, r.direction or "", r.path, r.n_pre, r.coherence, r.ended) for r in out.collect())
    assert got == [(1, "asc", 10, 2, True, None), (1, "desc", 20, 1, False, None), (2, "", None, None, None, "gave up"), (2, "asc", 10, 1, False, None), (3, "", None, None, None, "gave up"), (9, "", None, None, None, "gave up")]
    assert seen[:3] == [0, 2, 3]
    assert [(r.pre, r.post) for r in out.where("event = 1 AND direction = 'asc'").collect()] == [(at(17), at(31))]


def test_sources_lag_each_for_itself(spark, tmp_path):
    schema = "id long, ts timestamp"
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    lags = {"fast": "1 hour", "slow": "12 hours"}
    paths = {k: str(tmp_path / k) for k in lags}
    for p in paths.values():
        deliver(spark, p, [], schema)
    union = lambda: union_of_sources({k: (stream(spark, paths[k]), lags[k]) for k in lags}, "ts")
    folder, aside = str(tmp_path / "run"), str(tmp_path / "aside")

    def batch(**rows):
        for k, hours in rows.items():
            deliver(spark, paths[k], [(h, at(h)) for h in hours], schema)
        keep_late(union(), lags, "ts", "6 hours", aside).option("checkpointLocation", f"{aside}/state").trigger(availableNow=True).start().awaitTermination()
        return {(r.start, r.source): r.n for r in run(source_windows(union(), "ts", "6 hours"), folder).collect()}

    assert batch(fast=range(30)) == {}  # the slow one has said nothing: all windows wait
    newest = spark.createDataFrame([("fast", at(29))], "source string, seen timestamp")
    assert [r.source for r in silent_sources(newest, lags, "1 day").collect()] == ["slow"]
    batch(slow=range(20))
    got = batch(fast=range(30, 36), slow=[20])  # a batch sees the watermark of those before it
    assert got == {(at(0), "fast"): 6, (at(0), "slow"): 6}
    batch(fast=[2, 40], slow=[1, 21])  # two rows of a window that is closed, and two that aren't late
    late = spark.read.parquet(f"{aside}/late")
    assert sorted((r.source, r.id) for r in late.collect()) == [("fast", 2), ("slow", 1)]
    batch(fast=[100], slow=[100])
    got = batch(fast=[101], slow=[101])
    want = {}
    for k, hours in (("fast", [*range(36), 40]), ("slow", range(22))):
        for h in hours:
            want[at(h - h % 6), k] = want.get((at(h - h % 6), k), 0) + 1
    assert {k: n for k, n in got.items() if k[0] < at(48)} == want
    newest = spark.createDataFrame([("fast", at(100)), ("slow", at(40))], "source string, seen timestamp")
    assert [r.source for r in silent_sources(newest, lags, "2 days").collect()] == ["slow"]
    assert silent_sources(newest, lags, "4 days").collect() == []
