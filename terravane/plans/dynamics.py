"""Queries: recurrences, grid neighbourhoods, regions and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fire import BREAKS, danger_class, noon_utc_hour, relative_humidity, wet_bulb
from ..operators.folds import drought_code_series, fire_weather, first_crossing, parcels
from ..operators.graph import border_regions, despeckled, distances, undirected
from ..operators.grid import box_mean, focal, local_peaks, opened, slope_degrees, unwrapped
from ..operators.joins import QUEEN
from ..sources.adapters import WEATHER, adapter, adapter_sql, weather
from .registry import query, r6

OBS, POINT, EDGE = (adapter_sql(x) for x in ("obs", "point", "edge"))
COUNTS = "v AS (SELECT r, c, count(*)::double AS v FROM obs GROUP BY r, c)"


def counts(spark, d):
    return adapter(spark, d, "obs").groupBy("r", "c").agg(F.count("*").cast("double").alias("v"))


_DC = """greatest((CASE WHEN d.rain > 2.8 THEN greatest(400 * ln(800 / (800 * exp(-p.dc / 400) + 3.937 * (0.83 * d.rain - 1.27))), 0) ELSE p.dc END)
    + 0.5 * greatest(0.36 * (greatest(d.t, -2.8) + 2.8) + 1.4, 0), 0)"""
_DMC = """greatest((CASE WHEN d.rain > 1.5 THEN greatest(244.72 - 43.43 * ln(20 + exp(5.6348 - p.dmc / 43.43) + 1000 * (0.92 * d.rain - 1.27) / (48.77
    + (CASE WHEN p.dmc > 65 THEN 6.2 * ln(p.dmc) - 17.2 WHEN p.dmc > 33 THEN 14 - 1.3 * ln(p.dmc) ELSE 100 / (0.5 + 0.3 * p.dmc) END) * (0.92 * d.rain - 1.27)) - 20), 0) ELSE p.dmc END)
    + 0.0001894 * (greatest(d.t, -1.1) + 1.1) * (100 - d.h) * 9.0, 0)"""
_RATE = "0.581 * exp(0.0365 * t) * (0.424 * (1 - pow({x}, 1.7)) + 0.0694 * sqrt(w) * (1 - pow({x}, 8)))"
_FOLD = f"""d AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY day) AS k FROM weather),
s AS (SELECT cell, 0::bigint AS k, 85.0::double AS ffmc, 6.0::double AS dmc, 15.0::double AS dc, NULL::date AS day, 0::double AS w FROM d GROUP BY cell
  UNION ALL SELECT cell, k, 59.5 * (250 - now) / (147.2 + now), dmc, dc, day, w FROM (
    SELECT *, CASE WHEN m < ed AND m < ew THEN ew - (ew - m) * pow(10, -({_RATE.format(x='((100 - h) / 100)')})) WHEN m > ed THEN ed + (m - ed) * pow(10, -({_RATE.format(x='(h / 100)')})) ELSE m END AS now FROM (
    SELECT *, 0.942 * pow(h, 0.679) + 11 * exp((h - 100) / 10) + 0.18 * (21.1 - t) * (1 - exp(-0.115 * h)) AS ed, 0.618 * pow(h, 0.753) + 10 * exp((h - 100) / 10) + 0.18 * (21.1 - t) * (1 - exp(-0.115 * h)) AS ew,
      CASE WHEN rain > 0.5 THEN least(was + 42.5 * (rain - 0.5) * exp(-100 / (251 - was)) * (1 - exp(-6.93 / (rain - 0.5))) + CASE WHEN was > 150 THEN 0.0015 * pow(was - 150, 2) * sqrt(rain - 0.5) ELSE 0 END, 250) ELSE was END AS m FROM (
    SELECT d.cell AS cell, d.k AS k, d.day AS day, d.t AS t, d.h AS h, d.w AS w, d.rain AS rain, 147.2 * (101 - p.ffmc) / (59.5 + p.ffmc) AS was, {_DMC} AS dmc, {_DC} AS dc FROM s p JOIN d ON d.cell = p.cell AND d.k = p.k + 1) a) b) c)"""


@query(f"""WITH RECURSIVE weather AS ({WEATHER}), {_FOLD}, l AS (SELECT s.* FROM s JOIN (SELECT cell, max(k) AS k FROM s GROUP BY cell) x ON s.cell = x.cell AND s.k = x.k),
i AS (SELECT *, 0.208 * exp(0.05039 * w) * 91.9 * exp(-0.1386 * (147.2 * (101 - ffmc) / (59.5 + ffmc))) * (1 + pow(147.2 * (101 - ffmc) / (59.5 + ffmc), 5.31) / 4.93e7) AS isi, 0.8 * dc / (dmc + 0.4 * dc) AS q FROM l),
b AS (SELECT *, greatest(CASE WHEN dmc > 0.4 * dc THEN dmc - (1 - q) * (0.92 + pow(0.0114 * dmc, 1.7)) ELSE q * dmc END, 0) AS bui FROM i),
f AS (SELECT *, 0.1 * isi * CASE WHEN bui > 80 THEN 1000 / (25 + 108.64 * exp(-0.023 * bui)) ELSE 0.626 * pow(bui, 0.809) + 2 END AS x FROM b)
SELECT cell, day, round(ffmc, 6) AS ffmc, round(dmc, 6) AS dmc, round(dc, 6) AS dc, round(isi, 6) AS isi, round(bui, 6) AS bui, round(CASE WHEN x > 1 THEN exp(2.72 * pow(0.434 * ln(x), 0.647)) ELSE greatest(x, 0) END, 6) AS fwi FROM f""")
def rc1_fire_weather(spark, d):
    codes = fire_weather(weather(spark, d), ["cell"])
    return codes.select("cell", "day", *(r6(F.col(k)).alias(k) for k in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")))


_ONLY_DC = f"""d AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY day) AS k FROM weather),
s AS (SELECT cell, 0::bigint AS k, 15.0::double AS dc, NULL::date AS day FROM d GROUP BY cell UNION ALL SELECT d.cell, d.k, {_DC}, d.day FROM s p JOIN d ON d.cell = p.cell AND d.k = p.k + 1)"""


@query(f"WITH RECURSIVE weather AS ({WEATHER}), {_ONLY_DC} SELECT cell, day, round(dc, 6) AS dc FROM s WHERE k > 0")
def rc2_drought_code(spark, d):
    return drought_code_series(weather(spark, d), ["cell"]).select("cell", "day", r6(F.col("dc")).alias("dc"))


@query(f"WITH RECURSIVE weather AS ({WEATHER}), {_ONLY_DC} SELECT cell, min(CASE WHEN dc >= 60 THEN day END) AS crossed, min(CASE WHEN dc >= 60 THEN day END) = min(day) AS censored FROM s WHERE k > 0 GROUP BY cell")
def rc4_first_crossing(spark, d, bound=60.0):
    return first_crossing(drought_code_series(weather(spark, d), ["cell"]), ["cell"], "day", "dc", bound)


@query(f"WITH weather AS ({WEATHER}) SELECT cell, day, round(least(greatest(exp(17.625 * (t - 6) / (t - 6 + 243.04) - 17.625 * t / (t + 243.04)) * 100, 0), 100), 6) AS rh, round(t * atan(0.151977 * sqrt(h + 8.313659)) + atan(t + h) - atan(h - 1.676331) + 0.00391838 * pow(h, 1.5) * atan(0.023101 * h) - 4.686035, 6) AS wet_bulb FROM weather")
def fn8_humidity(spark, d):
    w, t = weather(spark, d), F.col("t")
    return w.select("cell", "day", r6(relative_humidity(t, t - 6)).alias("rh"), r6(wet_bulb(t, F.col("h"))).alias("wet_bulb"))


@query(f"WITH {POINT}, h AS (SELECT event_id, 12 - lon / 15 AS x FROM point), b AS (SELECT event_id, CASE WHEN x - floor(x) = 0.5 THEN 2 * floor((floor(x) + 1) / 2) ELSE floor(x + 0.5) END::int AS y FROM h) SELECT event_id, ((y % 24) + 24) % 24 AS noon FROM b")
def fn8_noon_hour(spark, d):
    return adapter(spark, d, "point").select("event_id", noon_utc_hour(F.col("lon")).alias("noon"))


_LOW, _MID, _HIGH = BREAKS["DMC"]


@query(f"WITH {POINT} SELECT CASE WHEN value >= {_HIGH} THEN 3 WHEN value >= {_MID} THEN 2 WHEN value >= {_LOW} THEN 1 ELSE 0 END AS class, count(*) AS n FROM point GROUP BY 1")
def fn22_danger_class(spark, d):
    return adapter(spark, d, "point").groupBy(danger_class("DMC", F.col("value")).alias("class")).agg(F.count("*").alias("n"))


# --- grid


@query(f"WITH {OBS}, {COUNTS} SELECT a.r AS r, a.c AS c, median(b.v) AS median FROM v a JOIN v b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c")
def rs5_focal_median(spark, d):
    return focal(counts(spark, d), "v", "median")


@query(f"WITH {OBS}, {COUNTS}, m AS (SELECT a.r AS r, a.c AS c, min(b.v) AS v FROM v a JOIN v b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c) SELECT a.r AS r, a.c AS c, max(b.v) AS v FROM m a JOIN m b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c")
def rs5_opening(spark, d):
    return opened(counts(spark, d), "v")


@query(f"WITH {OBS}, {COUNTS} SELECT a.r AS r, a.c AS c, round(avg(b.v), 6) AS mean FROM v a JOIN v b ON abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 GROUP BY a.r, a.c")
def rs6_box_mean(spark, d):
    return box_mean(counts(spark, d), "v", 2).withColumn("mean", r6(F.col("mean")))


@query(f"WITH {OBS}, {COUNTS}, g AS (SELECT r, c, (coalesce(lead(v) OVER x, v) - coalesce(lag(v) OVER x, v)) / (coalesce(lead(c) OVER x, c) - coalesce(lag(c) OVER x, c)) / 30 AS gx, (coalesce(lead(v) OVER y, v) - coalesce(lag(v) OVER y, v)) / (coalesce(lead(r) OVER y, r) - coalesce(lag(r) OVER y, r)) / 30 AS gy FROM v WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)) SELECT r, c, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope FROM g")
def fn16_slope(spark, d):
    return slope_degrees(counts(spark, d), "v", 30.0).withColumn("slope", r6(F.col("slope")))


@query(f"WITH {OBS}, {COUNTS} SELECT a.r AS r, a.c AS c, any_value(a.v) AS v FROM v a JOIN v b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c HAVING any_value(a.v) >= 160 AND any_value(a.v) = max(b.v)")
def rs9_local_peaks(spark, d):
    return local_peaks(counts(spark, d), "v", 160)


@query("WITH p AS (SELECT l_orderkey AS k, l_linenumber AS i, (l_extendedprice % 628) / 100 - 3.14::double AS phase FROM lineitem), s AS (SELECT *, phase - lag(phase) OVER (PARTITION BY k ORDER BY i, phase) AS st FROM p), w AS (SELECT *, coalesce(st - 2 * pi() * floor((st + pi()) / (2 * pi())), phase) AS d FROM s) SELECT k, max(i) AS last, round(sum(d), 6) AS total, round(sum(abs(d)), 6) AS variation FROM w GROUP BY k")
def rc7_unwrap(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_extendedprice") % 628 / 100 - 3.14).alias("phase"))
    u = unwrapped(li.withColumn("o", F.struct("i", "phase")), ["k"], "o", "phase")
    from pyspark.sql import Window

    step = F.col("unwrapped") - F.coalesce(F.lag("unwrapped").over(Window.partitionBy("k").orderBy("o")), F.lit(0.0))
    return u.withColumn("d", step).groupBy("k").agg(F.max("i").alias("last"), r6(F.sum("d")).alias("total"), r6(F.sum(F.abs("d"))).alias("variation"))


# --- regions and networks

_MASK = "m AS (SELECT r, c, r * 100 + c AS id FROM v WHERE v >= 152)"
_LABEL = "lab AS (SELECT id, id AS to_id FROM m UNION SELECT l.id, b.id FROM lab l JOIN m a ON a.id = l.to_id JOIN m b ON {near} AND b.id <> a.id), root AS (SELECT id, min(to_id) AS root FROM lab GROUP BY id)"
_NEAR8 = "abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1"


def mask(spark, d):
    return counts(spark, d).where("v >= 152").select("r", "c")


@query(f"WITH RECURSIVE {OBS}, {COUNTS}, {_MASK}, {_LABEL.format(near=_NEAR8)}, s AS (SELECT root, count(*) AS size FROM root GROUP BY root HAVING count(*) >= 5) SELECT m.r AS r, m.c AS c, s.size AS size FROM m JOIN root ON m.id = root.id JOIN s ON s.root = root.root")
def gr1_despeckle(spark, d):
    return despeckled(mask(spark, d), 5, QUEEN).select("r", "c", "size")


@query(f"WITH RECURSIVE {OBS}, {COUNTS}, {_MASK}, {_LABEL.format(near=_NEAR8)}, f AS (SELECT DISTINCT root FROM root JOIN m ON m.id = root.id WHERE r IN (0, 19) OR c IN (0, 19)) SELECT m.r AS r, m.c AS c FROM m JOIN root ON m.id = root.id WHERE root.root IN (SELECT root FROM f)")
def gr2_border_regions(spark, d):
    return border_regions(mask(spark, d), 20, 20, QUEEN)


_BOTH = "e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(len) AS len FROM edge GROUP BY 1, 2), g AS (SELECT a AS src, b AS dst, len FROM e UNION ALL SELECT b, a, len FROM e)"


@query(f"WITH {EDGE}, {_BOTH} SELECT src, count(*) AS degree, min(len) AS nearest FROM g GROUP BY src")
def gr4_build_graph(spark, d):
    return undirected(adapter(spark, d, "edge")).groupBy("src").agg(F.count("*").alias("degree"), F.min("len").alias("nearest"))


_ROUNDS = ", ".join(f"d{k + 1} AS (SELECT node, min(dist) AS dist FROM (SELECT * FROM d{k} UNION ALL SELECT g.dst, d{k}.dist + g.len FROM d{k} JOIN g ON g.src = d{k}.node WHERE d{k}.dist + g.len <= 6) GROUP BY node)" for k in range(6))


@query(f"WITH {EDGE}, {_BOTH}, d0 AS (SELECT DISTINCT (-1 - s_suppkey)::bigint AS node, 0::double AS dist FROM supplier WHERE s_suppkey % 10 = 0), {_ROUNDS} SELECT node, dist FROM d6")
def gr3_network_distance(spark, d):
    stops = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey % 10 = 0").select((-1 - F.col("s_suppkey")).cast("long").alias("node"))
    return distances(adapter(spark, d, "edge"), stops, 6.0)


@query(None)
def rc3_parcels(spark, d):
    """Paths of parcels from the first detections; rows only, a broadcast field and numpy steps have no twin in SQL."""
    p = adapter(spark, d, "point")
    wind = p.groupBy(F.floor(F.col("lat") + 10).cast("int").alias("r"), F.floor(F.col("lon") - 100).cast("int").alias("c"), F.hour("ts").alias("hour"))
    wind = wind.agg((F.avg("value") % 7 - 3).alias("u"), (F.max("value") % 5 - 2).alias("v"))
    seeds = p.where("conf >= 95").select(F.col("event_id").alias("traj_id"), (F.col("lon") - 100).alias("lon"), (F.col("lat") + 10).alias("lat"), F.hour("ts").cast("double").alias("hour"))
    return parcels(seeds, wind, 6)
