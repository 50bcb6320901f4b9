"""Queries: whole contour lines, served areas, masked weather, and streams that end, wait for lags or take late days."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.fire import BREAKS, danger_class
from ..functions.geo import tile_zoom
from ..functions.projection import FORWARD, utm
from ..operators.assess import regraded
from ..operators.coast import crossings, shifted_epochs, transects_of_lines
from ..operators.folds import fire_weather
from ..operators.lines import contour_lines
from ..operators.reach import line_cells, near_cells
from ..operators.warp import image_offsets
from ..session import rocksdb, shared_folder
from ..sources.adapters import WEATHER, adapter, adapter_sql, weather
from ..sources.products import judged, pair_stats, rejects
from ..sources.rasterfiles import Grid, read_raster, write_raster
from ..sources.tables import register_tables
from ..streaming.feeds import available, closed, stream
from ..streaming.lags import source_windows, union_of_sources
from ..streaming.watch import watched_tracks
from .dynamics import COUNTS, counts
from .motion import _QUAD, _SIDES
from .registry import SQL, query, r6
from .reports import su26_hillshade

OBS, POINT = adapter_sql("obs"), adapter_sql("point")

_ID = {"t": "(r::bigint * 2147483648 + c) * 2", "u": "((r + 1)::bigint * 2147483648 + c) * 2", "l": "(r::bigint * 2147483648 + c) * 2 + 1", "s": "(r::bigint * 2147483648 + c + 1) * 2 + 1"}
_WAYS = {
    "lt": "k = 1 OR (k = 5 AND NOT high)", "su": "k = 4 OR (k = 5 AND NOT high)", "st": "k = 13 OR (k = 5 AND high)", "lu": "k = 7 OR (k = 5 AND high)",
    "tl": "k = 14 OR (k = 10 AND high)", "us": "k = 11 OR (k = 10 AND high)", "ts": "k = 2 OR (k = 10 AND NOT high)", "ul": "k = 8 OR (k = 10 AND NOT high)",
    "ls": "k = 3", "tu": "k = 6", "sl": "k = 12", "ut": "k = 9",
}
_SEG = "seg AS (" + " UNION ALL ".join(f"SELECT {_ID[p]} AS u, {_ID[q]} AS v, {p}x AS x1, {p}y AS y1, {q}x AS x2, {q}y AS y2 FROM p WHERE {rule}" for (p, q), rule in _WAYS.items()) + ")"
_WALK = """ahead AS (SELECT u AS s, v AS x FROM seg UNION SELECT s, seg.v FROM ahead JOIN seg ON seg.u = ahead.x),
first AS (SELECT u, false AS closed FROM seg WHERE u NOT IN (SELECT v FROM seg) UNION ALL SELECT s, true FROM ahead GROUP BY s HAVING bool_or(x = s) AND min(x) = s),
walk AS (SELECT u AS line, u, v, 0::bigint AS position, closed FROM seg JOIN first USING (u) UNION ALL SELECT line, seg.u, seg.v, position + 1, closed FROM walk JOIN seg ON seg.u = walk.v WHERE seg.u <> line),
whole AS (SELECT line, position, closed, x1, y1, x2, y2, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS len FROM walk JOIN seg USING (u)),
long AS (SELECT *, sum(len) OVER (PARTITION BY line) AS total FROM whole)"""


@query(f"WITH RECURSIVE {OBS}, {COUNTS}, {_QUAD}, {_SIDES}, {_SEG}, {_WALK} SELECT line, position, closed, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(total, 6) AS whole FROM long WHERE total >= 2.5")
def gr7_contour_lines(spark, d):
    """The contour as lines: number, order and whole length of the segments of each line of 2.5 cells or more."""
    lines = contour_lines(counts(spark, d), "v", 150.5, least=2.5)
    return lines.select("line", "position", "closed", *(r6(F.col(k)).alias(k) for k in ("x1", "y1", "x2", "y2", "whole")))


_STREETS = "street AS (SELECT (o_orderkey * 37 % 9973)::double / 10 AS x1, (o_orderkey * 53 % 8887)::double / 10 AS y1, (o_orderkey * 37 % 9973)::double / 10 + 2.3 AS x2, (o_orderkey * 53 % 8887)::double / 10 - 1.7 AS y2 FROM orders)"
_MARKED = """strip AS (SELECT *, unnest(generate_series(floor(x1)::bigint, floor(x2)::bigint)) AS c FROM street),
pass AS (SELECT c, CASE WHEN c > x1 THEN y1 + (y2 - y1) * ((c - x1) / (x2 - x1)) ELSE y1 END AS a, CASE WHEN c + 1 < x2 THEN y1 + (y2 - y1) * ((c + 1 - x1) / (x2 - x1)) ELSE y2 END AS b FROM strip),
marked AS (SELECT DISTINCT unnest(generate_series(floor(least(a, b))::bigint, floor(greatest(a, b))::bigint)) AS r, c FROM pass),
around AS (SELECT dr, dc FROM generate_series(-4, 4) a(dr), generate_series(-4, 4) b(dc) WHERE dr * dr + dc * dc <= 20),
near AS (SELECT r + dr AS r, c + dc AS c, min(dr * dr + dc * dc) AS d2 FROM marked, around GROUP BY 1, 2)"""


@query(f"WITH {_STREETS}, {_MARKED} SELECT d2::bigint AS d2, count(*) AS cells, sum(r)::bigint AS rows, sum(c)::bigint AS columns FROM near GROUP BY d2")
def gr5_served_cells(spark, d):
    """Cells within 4.5 cells of a street by their squared distance; the sums of rows and columns tell which cells they are."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    x, y = (F.col("o_orderkey") * 37 % 9973).cast("double") / 10, (F.col("o_orderkey") * 53 % 8887).cast("double") / 10
    cells = near_cells(line_cells(o.select(x.alias("x1"), y.alias("y1"), (x + 2.3).alias("x2"), (y - 1.7).alias("y2"))), 4.5)
    return cells.groupBy("d2").agg(F.count("*").alias("cells"), F.sum("r").alias("rows"), F.sum("c").alias("columns"))


_CODES = ("ffmc", "dmc", "dc", "isi", "bui", "fwi")
_L, _M, _H = BREAKS["FWI"]


@query(
    f"WITH whole AS ({SQL['rc1_fire_weather']}), masked AS (SELECT cell, bool_or((cell * 31 + day(day)) % 211 = 0) AS gap FROM ({WEATHER}) GROUP BY cell), x AS (SELECT whole.cell AS cell, whole.day AS day, "
    + ", ".join(f"CASE WHEN NOT gap THEN {c} END AS {c}" for c in _CODES)
    + f" FROM whole JOIN masked USING (cell)) SELECT *, CASE WHEN fwi >= {_H} THEN 3 WHEN fwi >= {_M} THEN 2 WHEN fwi >= {_L} THEN 1 WHEN fwi IS NOT NULL THEN 0 END AS class FROM x"
)
def rc1_masked_weather(spark, d):
    """Fire weather of cells whose temperature is masked on some days: no codes and no class from the first such day on."""
    masked = weather(spark, d).withColumn("t", F.when((F.col("cell") * 31 + F.dayofmonth("day")) % 211 != 0, F.col("t")))
    codes = fire_weather(masked, ["cell"]).select("cell", "day", *(r6(F.col(k)).alias(k) for k in _CODES))
    return codes.withColumn("class", danger_class("FWI", F.col("fwi")))


_POLLS = "poll AS (SELECT user_id % 40 AS event, event_id % 7 AS path, user_id % 3 AS frame, substr('ABC', (event_id % 7 % 3 + 1)::int, 1) AS direction, epoch_us(ts) // 1000 AS acquired, epoch_ms(timestamp '2024-01-03 00:00:00') + (user_id % 40) * 43200000 AS happened FROM events)"
_READY = """track AS (SELECT event, path, frame, direction, max(CASE WHEN acquired <= happened THEN acquired END) AS pre, min(CASE WHEN acquired > happened THEN acquired END) AS post, count(DISTINCT CASE WHEN acquired <= happened THEN acquired END) AS n_pre FROM poll GROUP BY 1, 2, 3, 4),
one AS (SELECT *, row_number() OVER (PARTITION BY event, direction ORDER BY post, path, frame) AS k FROM track WHERE pre IS NOT NULL AND post IS NOT NULL)"""


@query(f"WITH {_POLLS}, {_READY} SELECT event, direction, path::int AS path, frame::int AS frame, pre, post, n_pre, n_pre >= 2 AS coherence FROM one WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY event ORDER BY post, path, frame) <= 2")
def st1_watch(spark, d):
    """Polls of scenes around 40 events: the first two directions of view that have a scene before and after, and no more rows after them."""
    spark = rocksdb(spark)
    e = stream(spark, f"{d}/events.parquet", "ts")
    at = F.expr("timestamp '2024-01-03 00:00:00'") + F.make_dt_interval(hours=(F.col("user_id") % 40 * 12).cast("int"))
    polls = e.select((F.col("user_id") % 40).alias("event"), at.alias("happened"), (F.col("event_id") % 7).alias("path"), (F.col("user_id") % 3).alias("frame"), F.substring(F.lit("ABC"), (F.col("event_id") % 7 % 3 + 1).cast("int"), F.lit(1)).alias("direction"), F.col("ts").alias("acquired"))
    w = available(watched_tracks(polls, "event", "happened", "acquired"), "append")
    return w.select("event", "direction", "path", "frame", F.unix_millis("pre").alias("pre"), F.unix_millis("post").alias("post"), "n_pre", "coherence")


@query("SELECT time_bucket(interval 6 hours, ts) AS start, 'feed' || (user_id % 3) AS source, count(*) AS n FROM events GROUP BY 1, 2")
def st5_lagged_windows(spark, d):
    """Windows over three sources with lags of their own: once all have arrived, what a batch query counts."""
    lags = {"feed0": "1 hour", "feed1": "1 day", "feed2": "8 days"}

    def build(feed):
        # the row that closes the last windows belongs to every source
        own = {k: (feed.where((F.col("user_id") % 3 == int(k[-1])) | F.col("user_id").isNull()), lag) for k, lag in lags.items()}
        return source_windows(union_of_sources(own, "ts"), "ts", "6 hours")

    w = closed(spark, f"{d}/events.parquet", "ts", build)
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "source", "n")



_UTM = utm(48)
_ECC = (_UTM.flattening * (2 - _UTM.flattening)) ** 0.5
_TERMS = list(enumerate(_UTM.series(FORWARD), 1))
_SERIES = f"""t AS (SELECT event_id, sinh(atanh(sin(radians(lat * 4))) - {_ECC!r}::double * atanh({_ECC!r}::double * sin(radians(lat * 4)))) AS t, radians(lon - {_UTM.lon!r}::double) AS away FROM point),
g AS (SELECT event_id, atan2(t, cos(away)) AS u, asinh(sin(away) / sqrt(t * t + power(cos(away), 2))) AS v FROM t)"""


@query(
    f"WITH {POINT}, {_SERIES} SELECT event_id, round({_UTM.east!r}::double + {_UTM.radius!r}::double * (v"
    + "".join(f" + {a!r}::double * cos({2 * j} * u) * sinh({2 * j} * v)" for j, a in _TERMS)
    + f"), 2) AS x, round({_UTM.radius!r}::double * (u"
    + "".join(f" + {a!r}::double * sin({2 * j} * u) * cosh({2 * j} * v)" for j, a in _TERMS)
    + "), 2) AS y FROM g"
)
def rs3_projected(spark, d):
    """Places in UTM, their latitudes stretched to 40 degrees either way."""
    x, y = _UTM.project(F.col("lon"), F.col("lat") * 4)
    return adapter(spark, d, "point").select("event_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query(f"WITH s AS ({SQL['su26_hillshade']}), e AS (SELECT quantile_cont(shade, 0.55) AS lo, quantile_cont(shade, 0.999) AS hi FROM s) SELECT r, c, round(power(least(greatest((shade - lo) / (hi - lo + 1e-6), 0), 1), 2.0) * 0.9, 4) AS lift FROM s, e")
def su26_regraded(spark, d):
    """The hillshade's light stretched between two of its quantiles."""
    return regraded(su26_hillshade(spark, d), "shade").select("r", "c", F.round("lift", 4).alias("lift"))


@query(f"WITH {POINT}, s AS (SELECT sat, (max(lon) - min(lon)) / (1 + length(sat)) AS span FROM point GROUP BY sat) SELECT sat, least(greatest(round_even(log2((3000 * 360.0 / 256)::double / greatest(span, 1e-6)), 0), 8), 14)::int AS zoom FROM s")
def su27_tile_zoom(spark, d):
    """The zoom at which the span of each satellite's detections, narrowed to tell them apart, fills a map of 3,000 pixels."""
    span = (F.max("lon") - F.min("lon")) / (1 + F.length("sat"))
    return adapter(spark, d, "point").groupBy("sat").agg(span.alias("span")).select("sat", tile_zoom(F.col("span")).alias("zoom"))


_PAIR = "l_orderkey || '_' || l_linenumber"
_STATS = f"st AS (SELECT {_PAIR} AS pair, l_quantity AS coverage, l_discount AS coherence FROM lineitem WHERE l_linenumber <> 7 AND l_linenumber % 3 > 0)"


@query(f"WITH {_STATS}, one AS (SELECT DISTINCT {_PAIR} AS pair FROM lineitem WHERE l_quantity < 5), two AS (SELECT DISTINCT {_PAIR} AS pair FROM lineitem WHERE l_discount < 0.02) SELECT CASE WHEN pair IN (SELECT pair FROM one) THEN 'coverage' WHEN pair IN (SELECT pair FROM two) THEN 'loops' END AS rejected_by, count(*) AS pairs, round(sum(coverage), 4) AS coverage FROM st GROUP BY 1")
def sc27_judged_pairs(spark, d):
    """Pairs by the list that rejects them, from lines of text: comments and short lines among the statistics, and two lists that overlap."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    name = F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    short = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit(" 12 "), F.col("l_quantity").cast("string"), F.lit("  "), F.col("l_discount").cast("string")))
    stats = pair_stats(li.select(F.concat(F.when(F.col("l_linenumber") == 7, "# ").otherwise(""), name, F.lit("  1.5"), short).alias("value")))
    listed = lambda rule: rejects(li.where(rule).select(F.concat(name, F.lit("  # rejected")).alias("value")))
    out = judged(stats, coverage=listed("l_quantity < 5"), loops=listed("l_discount < 0.02"))
    return out.groupBy("rejected_by").agg(F.count("*").alias("pairs"), F.round(F.sum("coverage"), 4).alias("coverage"))


@query("WITH w AS (SELECT DISTINCT year(o_orderdate) + (o_custkey % 9) - 4 AS epoch FROM orders), y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) % 3 = 0), b AS (SELECT epoch, arg_min(y, (abs(y - epoch), y)) AS used FROM w JOIN y ON abs(y - epoch) <= 2 GROUP BY epoch) SELECT w.epoch AS epoch, used FROM w LEFT JOIN b ON b.epoch = w.epoch")
def su12_shifted_epochs(spark, d):
    """The year that stands for each epoch: the nearest one with scenes within two years; every third year has some."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    y = F.year("o_orderdate")
    return shifted_epochs(o.select((y + F.col("o_custkey") % 9 - 4).alias("epoch")), "epoch", o.where(y % 3 == 0).select(y.alias("y")), "y")


_LINE = "ln AS (SELECT s_suppkey AS t, (s_suppkey % 9)::double AS x, (s_suppkey * 7 % 10)::double / 2 AS y, 3.0::double + s_suppkey % 4 AS dx, 4.0::double - s_suppkey % 3 AS dy FROM supplier), tr AS (SELECT t, x, y, dx / sqrt(dx * dx + dy * dy) AS nx, dy / sqrt(dx * dx + dy * dy) AS ny FROM ln)"
_SHORE = "shore AS (SELECT o_orderkey % 3 AS epoch, (o_orderkey * 37 % 97)::double / 10 AS x1, (o_orderkey * 53 % 89)::double / 10 AS y1, (o_orderkey * 37 % 97)::double / 10 + 0.4 AS x2, (o_orderkey * 53 % 89)::double / 10 - 0.3 AS y2 FROM orders)"


@query(f"WITH {_LINE}, {_SHORE}, h AS (SELECT t, epoch, nx * (y2 - y1) - ny * (x2 - x1) AS det, ((x1 - x) * (y2 - y1) - (y1 - y) * (x2 - x1)) AS a, ((x1 - x) * ny - (y1 - y) * nx) AS b FROM tr, shore) SELECT t, epoch, round(max(a / det), 5) AS distance FROM h WHERE det <> 0 AND a / det >= 0 AND a / det <= 4 AND b / det >= 0 AND b / det <= 1 GROUP BY t, epoch")
def su12_given_transects(spark, d):
    """Crossings of transects that are given as lines of two points, up to 4 units along them."""
    key = F.col("s_suppkey")
    at = spark.read.parquet(f"{d}/supplier.parquet").select(key.alias("t"), (key % 9).cast("double").alias("x"), ((key * 7 % 10).cast("double") / 2).alias("y"), (3.0 + key % 4).alias("dx"), (4.0 - key % 3).alias("dy"))
    points = at.select("t", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col("x") + F.col("dx") * k).alias("x"), (F.col("y") + F.col("dy") * k).alias("y")) for k in (0, 1)))).alias("p")).select("t", "p.*")
    o = spark.read.parquet(f"{d}/orders.parquet")
    x, y = (F.col("o_orderkey") * 37 % 97).cast("double") / 10, (F.col("o_orderkey") * 53 % 89).cast("double") / 10
    shores = o.select((F.col("o_orderkey") % 3).alias("epoch"), x.alias("x1"), y.alias("y1"), (x + 0.4).alias("x2"), (y - 0.3).alias("y2"))
    return crossings(transects_of_lines(points, "t", "k", "x", "y"), "t", shores, "epoch", 4.0, 2.0).withColumn("distance", F.round("distance", 5))


_IMAGE = "one AS (SELECT l_orderkey % 64 AS r, l_partkey % 64 AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), two AS (SELECT r + 3 AS r, c - 2 AS c, v FROM one)"


@query(f"WITH {_IMAGE}, p AS (SELECT one.r // 32 AS pr, one.c // 32 AS pc, count(*) AS n FROM one JOIN two ON one.r = two.r AND one.c = two.c GROUP BY 1, 2) SELECT pr * 32 + 16::double AS y, pc * 32 + 16::double AS x, 3 AS dy, -2 AS dx FROM p WHERE n >= 512")
def rc9_offsets(spark, d):
    """Offsets of an image's patches against a copy of it that lies three rows down and two columns to the left, in whole pixels; patches with too few cells in common have none."""
    one = spark.read.parquet(f"{d}/lineitem.parquet").groupBy((F.col("l_orderkey") % 64).cast("int").alias("r"), (F.col("l_partkey") % 64).cast("int").alias("c")).agg(F.sum("l_quantity").alias("v"))
    two = one.select((F.col("r") + 3).alias("r"), (F.col("c") - 2).alias("c"), "v")
    o = image_offsets(one, two, "v", 32)
    return o.select("y", "x", F.round("dy").cast("int").alias("dy"), F.round("dx").cast("int").alias("dx"))


@query(f"WITH {OBS}, {COUNTS} SELECT r, c, v::float::double AS value FROM v WHERE (r + c) % 5 > 0 UNION ALL SELECT r, c, NULL FROM v WHERE (r + c) % 5 = 0")
def sk2_raster(spark, d):
    """Cells written as tiled raster files in blocks of 8 and read again; every fifth diagonal is masked."""
    folder = shared_folder(spark)
    cells = counts(spark, d).select("r", "c", F.when((F.col("r") + F.col("c")) % 5 > 0, F.col("v")).alias("value"))
    write_raster(cells, folder, Grid(100.0, 10.0, 0.5, 0.5), block=8)
    return read_raster(spark, folder).drop("file").join(cells.select("r", "c"), ["r", "c"])  # a block's corner that has no cells is masked too


@query(f"WITH {OBS}, k AS (SELECT r, c, CASE WHEN avg(tir) < 26.5 THEN 0 WHEN avg(tir) < 27 THEN 1 WHEN avg(tir) < 27.5 THEN 2 ELSE 3 END AS class FROM obs GROUP BY r, c), n AS (SELECT r // 2 AS r, c // 2 AS c, class, count(*) AS n FROM k GROUP BY 1, 2, 3) SELECT r::int AS r, c::int AS c, arg_min(class, (-n, class))::double AS value FROM n GROUP BY r, c")
def sk2_coarse_classes(spark, d):
    """A raster of classes with a palette that may hold 120 cells: coarsened by 2, to the most frequent class."""
    folder, t = shared_folder(spark), F.avg("tir")
    k = adapter(spark, d, "obs").groupBy("r", "c").agg(F.when(t < 26.5, 0).when(t < 27, 1).when(t < 27.5, 2).otherwise(3).alias("class"))
    write_raster(k, folder, value="class", palette={0: (0, 90, 0), 1: (250, 220, 0), 2: (250, 120, 0), 3: (180, 0, 0)}, most=120)
    return read_raster(spark, folder).drop("file")


_HEAD = ("1 1", "GDAS 24 1 1 0 0", "1 BACKWARD OMEGA", "24 1 1 0 100.0 0.0 500", "1 PRESSURE")


@query("SELECT 'u' || user_id AS file, 'BACKWARD' AS direction, 1 AS traj_id, strftime(ts, '%Y-%m-%d %H:%M:00') AS at, round(100 + (event_id * 37 % 1000) / 100.0::double, 6) AS lon, round((event_id * 91 % 2000) / 100.0::double - 10, 6) AS lat, round(value, 2) AS height FROM events")
def sc18_endpoint_rows(spark, d):
    """Endpoint files as lines of text, one file a user, read by the table function from SQL."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("file", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    at = F.date_format("ts", "yy MM dd HH mm")
    place = F.format_string("%.2f %.2f %.2f", (F.col("event_id") * 91 % 2000) / 100.0 - 10, (F.col("event_id") * 37 % 1000) / 100.0 + 100, F.col("value"))
    records = e.select("file", (F.col("event_id") + len(_HEAD)).alias("k"), F.concat_ws(" ", F.lit("1 1"), at, F.lit("0 0.0"), place, F.lit("950.0")).alias("line"))
    head = e.select("file").distinct().select("file", F.posexplode(F.array(*map(F.lit, _HEAD))).alias("k", "line"))
    view = f"lines_{uuid.uuid4().hex}"
    head.select("file", F.col("k").cast("long").alias("k"), "line").union(records).createOrReplaceTempView(view)
    register_tables(spark)
    return spark.sql(f"SELECT file, direction, traj_id, at, round(lon, 6) AS lon, round(lat, 6) AS lat, round(height, 2) AS height FROM endpoint_rows(TABLE({view}) PARTITION BY file ORDER BY k)")
