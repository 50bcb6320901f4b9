"""Queries: zones, joins and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.classes import ISPU, VHI, class_from_above, class_up_to
from ..functions.geo import cell_area_ha, haversine_km, local_km
from ..functions.indices import index
from ..functions.masks import is_named
from ..operators.joins import around, nearest, neighbours, rank_pairs
from ..operators.stats import (
    agreement,
    auc,
    binned,
    circular,
    median_and_mad,
    morans_i,
    otsu,
    plane,
    runs,
    slope_through_origin,
    trailing_run,
    trend,
)
from ..operators.zonal import class_areas, cross_tab, grid_index, material_zones, person_days, rectangles, within, zone_codes
from ..sources.adapters import adapter, adapter_sql
from .registry import query, r6

OBS, SCENE, POINT, ZONE, PAIRS = (adapter_sql(x) for x in ("obs", "scene", "point", "zone", "pair_obs"))
IN_ZONE = "lon >= w AND lon < e AND lat >= s AND lat < n"
JOINED = f"j AS (SELECT p.*, z.zone_id AS zone_id, z.name AS name, z.country AS country FROM point p LEFT JOIN zone z ON {IN_ZONE})"
DEC = "date '1998-12-31'"


def zones(spark, d):
    return rectangles(adapter(spark, d, "zone"))


def zoned_points(spark, d):
    return within(adapter(spark, d, "point"), zones(spark, d), "lon", "lat", ["event_id"], "zone_id", tile=2.0)


@query(f"WITH {POINT}, {ZONE}, {JOINED} SELECT event_id, zone_id, name FROM j")
def js1_points_in_zones(spark, d):
    return zoned_points(spark, d).select("event_id", "zone_id", "name")


@query(f"WITH {POINT}, {ZONE}, {JOINED} SELECT zone_id, day, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM j GROUP BY zone_id, day")
def ag3_zonal_daily(spark, d):
    return zoned_points(spark, d).groupBy("zone_id", "day").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), F.max("value").alias("most"))


@query(f"WITH {POINT}, {ZONE}, {JOINED} SELECT country, name, count(*) AS n FROM j WHERE conf >= 30 GROUP BY country, name")
def ag13_counts_by_zone(spark, d, confidence=30):
    return zoned_points(spark, d).where(F.col("conf") >= confidence).groupBy("country", "name").agg(F.count("*").alias("n"))


@query(f"WITH {POINT} SELECT event_id, lon, lat, day FROM point WHERE conf >= 50 AND lon >= 102 AND lon <= 108 AND lat >= -8 AND lat <= 4")
def sc8_detections(spark, d):
    return adapter(spark, d, "point").where("conf >= 50 AND lon BETWEEN 102 AND 108 AND lat BETWEEN -8 AND 4").select("event_id", "lon", "lat", "day")


CLASS = "CASE WHEN conf < 25 THEN 0 WHEN conf < 50 THEN 1 WHEN conf < 75 THEN 2 WHEN conf < 90 THEN 3 END"
AREA = "0.01 * 111.320 * cos(radians(lat)) * 0.01 * 110.574 * 100"


def graded(df):
    conf = F.col("conf")
    return df.withColumns({"class": F.when(conf < 25, 0).when(conf < 50, 1).when(conf < 75, 2).when(conf < 90, 3), "ha": cell_area_ha(F.col("lat"), 0.01, 0.01)})


@query(f"WITH {POINT}, g AS (SELECT {CLASS} AS class, {AREA} AS ha FROM point), s AS (SELECT class, sum(ha) AS area FROM g WHERE class IS NOT NULL GROUP BY class), l AS (SELECT unnest([0, 1, 2, 3, 4])::int AS class), f AS (SELECT l.class AS class, coalesce(area, 0) AS area FROM l LEFT JOIN s ON l.class = s.class) SELECT class, round(area, 6) AS area, round(100 * area / sum(area) OVER (), 6) AS pct FROM f")
def ag2_class_areas(spark, d):
    a = class_areas(graded(adapter(spark, d, "point")).where(F.col("class").isNotNull()), "class", F.col("ha"), range(5))
    return a.select("class", r6(F.col("area")).alias("area"), r6(F.col("pct")).alias("pct"))


@query(f"WITH {POINT}, {ZONE}, {JOINED}, g AS (SELECT zone_id, {CLASS} AS class, {AREA} AS ha FROM j WHERE zone_id IS NOT NULL) SELECT zone_id, " + ", ".join(f"round(sum(CASE WHEN class = {k} THEN ha ELSE 0 END), 6) AS class_{k}" for k in range(4)) + ", round(sum(CASE WHEN class IS NULL THEN ha ELSE 0 END), 6) AS no_data, round(sum(ha), 6) AS total FROM g GROUP BY zone_id")
def ag4_zone_class_table(spark, d):
    t = cross_tab(graded(zoned_points(spark, d)), "zone_id", "class", F.col("ha"), range(4))
    return t.select("zone_id", *(r6(F.col(x)).alias(x) for x in t.columns[1:]))


@query(f"WITH {POINT}, m AS (SELECT least(greatest(floor((lat + 10) / 0.5::double), 0), 39)::int AS r, least(greatest(floor((lon - 100) / 0.5::double), 0), 19)::int AS c, value FROM point) SELECT r, c, count(*) AS n, round(sum(value), 6) AS total FROM m GROUP BY r, c")
def rs1_grid_lookup(spark, d):
    p = adapter(spark, d, "point")
    return p.groupBy(grid_index(F.col("lat"), -10, 0.5, 40).alias("r"), grid_index(F.col("lon"), 100, 0.5, 20).alias("c")).agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("WITH z AS (SELECT n_nationkey AS zone_id, n_name AS name, cast(n_regionkey AS varchar) AS region FROM nation) SELECT zone_id, dense_rank() OVER (ORDER BY CASE WHEN region = '0' THEN '(none)' ELSE region END)::int AS code FROM z")
def sc12_zone_codes(spark, d):
    z = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("zone_id"), F.nullif(F.col("n_regionkey").cast("string"), F.lit("0")).alias("region"))
    return zone_codes(z, "region").select("zone_id", "code")


_POP = "pop AS (SELECT c_nationkey AS zone_id, count(*) * 1000 AS people FROM customer GROUP BY c_nationkey), dd AS (SELECT zone_id, day, avg(value) AS pm FROM j WHERE zone_id IS NOT NULL GROUP BY zone_id, day), x AS (SELECT dd.zone_id AS zone_id, day, pm, people FROM dd JOIN pop ON dd.zone_id = pop.zone_id), k AS (SELECT *, CASE WHEN pm <= 15.5 THEN 0 WHEN pm <= 55.4 THEN 1 WHEN pm <= 150.4 THEN 2 WHEN pm <= 250.4 THEN 3 ELSE 4 END AS cl FROM x)"


def exposure(spark, d):
    people = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_nationkey").alias("zone_id")).agg((F.count("*") * 1000).alias("people"))
    air = zoned_points(spark, d).where("zone_id IS NOT NULL").groupBy("zone_id", "day").agg(F.avg("value").alias("pm"))
    return air.join(people, "zone_id")


@query(f"WITH {POINT}, {ZONE}, {JOINED}, {_POP} SELECT zone_id, " + ", ".join(f"sum(CASE WHEN cl = {k} THEN people ELSE 0 END)::bigint AS person_days_{k}" for k in range(5)) + ", round(max(pm), 6) AS worst, arg_min(day, (-pm, day)) AS worst_day FROM k GROUP BY zone_id")
def ag8_person_days(spark, d):
    return person_days(exposure(spark, d), "zone_id", "day", "pm", "people", ISPU).withColumn("worst", r6(F.col("worst")))


@query("WITH a AS (SELECT n_name AS name, sum(c_acctbal) AS area FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name) SELECT name, round(area, 6) AS area FROM a WHERE area >= 0.04::double * (SELECT sum(area) FROM a)")
def or2_material_zones(spark, d):
    c, n = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation"))
    a = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("name")).agg(F.sum("c_acctbal").alias("area"))
    return material_zones(a, "area", 0.04).select("name", r6(F.col("area")).alias("area"))


@query("SELECT p_name AS name, lower(trim(p_name)) NOT IN ('', '?', '-', '(unnamed)', 'none') AND NOT (lower(p_name) LIKE '%not available%' OR lower(p_name) LIKE '%unknown%' OR lower(p_name) LIKE '%unnamed%' OR lower(p_name) LIKE '%no data%' OR lower(p_name) LIKE '%n/a%') AS named FROM part")
def pr18_is_named(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("name"), is_named(F.col("p_name")).alias("named"))


# --- joins


@query(f"WITH {POINT}, t AS (SELECT s_suppkey AS stop, 100 + (s_suppkey * 53 % 1000)::double / 100 AS sx, -10 + (s_suppkey * 71 % 2000)::double / 100 AS sy FROM supplier), m AS (SELECT event_id, stop, sqrt((lon - sx) * (lon - sx) + (lat - sy) * (lat - sy)) AS dist FROM point JOIN t ON abs(lon - sx) <= 0.6 AND abs(lat - sy) <= 0.6), b AS (SELECT event_id, min((round(dist, 9), stop)) AS b FROM m WHERE dist <= 0.6 GROUP BY event_id) SELECT p.event_id AS event_id, b[2] AS stop, round(b[1], 6) AS distance FROM point p LEFT JOIN b ON p.event_id = b.event_id")
def jn4_nearest_stop(spark, d):
    stop = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey AS stop", "100 + cast(s_suppkey * 53 % 1000 as double) / cast(100 as double) AS sx", "-10 + cast(s_suppkey * 71 % 2000 as double) / cast(100 as double) AS sy")
    near = nearest(adapter(spark, d, "point").select("event_id", "lon", "lat"), stop, ["event_id"], "lon", "lat", "sx", "sy", "stop", 0.6, digits=9)
    return near.select("event_id", "stop", r6(F.col("distance")).alias("distance"))


@query(f"WITH {OBS}, v AS (SELECT r, c, count(*) AS n FROM obs GROUP BY r, c) SELECT a.r AS r, a.c AS c, sum(b.n)::bigint AS around, count(*) AS k FROM v a JOIN v b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY a.r, a.c")
def jn5_neighbour_sum(spark, d):
    v = adapter(spark, d, "obs").groupBy("r", "c").agg(F.count("*").alias("n"))
    return neighbours(v, "n").groupBy("r", "c").agg(F.sum("other").alias("around"), F.count("*").alias("k"))


@query(f"WITH {SCENE}, a AS (SELECT rel_orbit, max(CASE WHEN day <= date '1995-03-01' THEN (day, scene_id) END) AS b, min(CASE WHEN day > date '1995-03-01' THEN (day, scene_id) END) AS f FROM scene GROUP BY rel_orbit) SELECT rel_orbit, b[2] AS before_scene, b[1] AS before_day, f[2] AS after_scene, f[1] AS after_day FROM a")
def ja1_as_of(spark, d):
    a = adapter(spark, d, "scene").groupBy("rel_orbit").agg(*around(F.lit("1995-03-01").cast("date"), "day", "scene_id"))
    return a.select("rel_orbit", F.col("before.scene_id").alias("before_scene"), F.col("before.day").alias("before_day"), F.col("after.scene_id").alias("after_scene"), F.col("after.day").alias("after_day"))


_TRACK = "t AS (SELECT rel_orbit, orbit, scene_id, day, row_number() OVER (PARTITION BY rel_orbit, orbit ORDER BY day, scene_id) AS rn FROM scene WHERE cloud_pct < 10)"


@query(f"WITH {SCENE}, {_TRACK} SELECT a.rel_orbit AS rel_orbit, a.orbit AS orbit, a.scene_id AS scene_1, a.day AS day_1, b.scene_id AS scene_2, b.day AS day_2 FROM t a JOIN t b ON a.rel_orbit = b.rel_orbit AND a.orbit = b.orbit AND b.rn BETWEEN a.rn + 1 AND a.rn + 3 WHERE date_diff('day', a.day, b.day) <= 20")
def jr1_rank_pairs(spark, d):
    return rank_pairs(adapter(spark, d, "scene").where("cloud_pct < 10"), ["rel_orbit", "orbit"], "day", "scene_id", 3, 20)


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def je1_semi(spark, d):
    o, li = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    return o.join(li.where("l_quantity > 49"), o.o_orderkey == li.l_orderkey, "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def je2_anti(spark, d):
    o, li = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    return o.join(li.where("l_quantity > 40"), o.o_orderkey == li.l_orderkey, "left_anti").select("o_orderkey")


# --- statistics


@query(f"WITH {PAIRS}, s AS (SELECT cell, sum(years * phase) AS xy, sum(years * years) AS xx, count(*) AS n FROM pair_obs WHERE coh >= 0.3 GROUP BY cell) SELECT cell, n, round(CASE WHEN n >= 5 AND xx <> 0 THEN xy / xx END, 6) AS slope FROM s")
def ag16_velocity(spark, d, coherence=0.3, least_pairs=5):
    return slope_through_origin(adapter(spark, d, "pair_obs").where(F.col("coh") >= coherence), ["cell"], "years", "phase", least_pairs).withColumn("slope", r6(F.col("slope")))


@query(f"WITH {OBS}, v AS (SELECT r::double AS x, c::double AS y, avg(tir) + 0.3 * r + 0.1 * c AS z FROM obs GROUP BY r, c), m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM v), q AS (SELECT sum((x-mx)*(x-mx)) AS xx, sum((y-my)*(y-my)) AS yy, sum((x-mx)*(y-my)) AS xy, sum((x-mx)*(z-mz)) AS xz, sum((y-my)*(z-mz)) AS yz, sum((z-mz)*(z-mz)) AS zz, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz FROM v, m), f AS (SELECT *, (xz*yy - yz*xy) / (xx*yy - xy*xy) AS b, (yz*xx - xz*xy) / (xx*yy - xy*xy) AS c FROM q) SELECT round(mz - b*mx - c*my, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round((b*xz + c*yz) / zz, 6) AS r2 FROM f")
def ag17_plane_fit(spark, d):
    v = adapter(spark, d, "obs").groupBy("r", "c").agg((F.avg("tir") + 0.3 * F.col("r") + 0.1 * F.col("c")).alias("z"))
    v = v.select(F.col("r").cast("double").alias("x"), F.col("c").cast("double").alias("y"), "z")
    return plane(v, "x", "y", "z").select(*(r6(F.col(k)).alias(k) for k in ("a", "b", "c", "r2")))


@query("WITH m AS (SELECT event_type AS k, median(value) AS md FROM events GROUP BY 1) SELECT event_type AS sat, round(any_value(md), 6) AS median, round(median(abs(value - md)) * 1.4826, 6) AS mad FROM events JOIN m ON k = event_type GROUP BY event_type")
def ag19_robust_spread(spark, d):
    m = median_and_mad(adapter(spark, d, "point"), ["sat"], "value")
    return m.select("sat", r6(F.col("median")).alias("median"), r6(F.col("mad")).alias("mad"))


_KM = "sqrt(power((lon - 105) * 111.32 * cos(radians(0)), 2) + power(lat * 110.57, 2))"


@query(f"WITH {POINT} SELECT floor({_KM} / 150) * 150 AS bin, round(median(value), 6) AS median, round(quantile_cont(value, 0.1), 6) AS low, count(*) AS n FROM point GROUP BY 1 HAVING count(*) >= 30")
def ag20_distance_bins(spark, d):
    p = adapter(spark, d, "point")
    east, north = local_km(F.col("lon"), F.col("lat"), 105.0, 0.0)
    b = binned(p, F.hypot(east, north), 150.0, "value", 30)
    return b.select(F.col("bin").cast("double").alias("bin"), r6(F.col("median")).alias("median"), r6(F.col("low")).alias("low"), "n")


@query(f"WITH {PAIRS}, m AS (SELECT cell, avg(sin(phase)) AS s, avg(cos(phase)) AS k, count(*) AS n FROM pair_obs GROUP BY cell) SELECT cell, round(CASE WHEN sqrt(s*s + k*k) >= 0.15::double THEN atan2(s, k) END, 6) AS direction, round(sqrt(s*s + k*k), 6) AS length, n FROM m")
def ag21_circular_mean(spark, d):
    m = circular(adapter(spark, d, "pair_obs"), ["cell"], "phase", 0.15)
    return m.select("cell", r6(F.col("direction")).alias("direction"), r6(F.col("length")).alias("length"), "n")


@query(f"WITH {OBS}, v AS (SELECT r, c, avg(tir) AS v FROM obs GROUP BY r, c), a AS (SELECT r, c, v - (SELECT avg(v) FROM v) AS d FROM v), x AS (SELECT sum(p.d * q.d) AS num, count(*) AS np FROM a p JOIN a q ON abs(p.r - q.r) + abs(p.c - q.c) = 1) SELECT (SELECT count(*) FROM a) AS n, np AS n_pairs, round((SELECT count(*) FROM a) * num / (np * (SELECT sum(d * d) FROM a)), 6) AS i FROM x")
def ag23_morans_i(spark, d):
    v = adapter(spark, d, "obs").groupBy("r", "c").agg(F.avg("tir").alias("v"))
    return morans_i(v, "v").withColumn("i", r6(F.col("i")))


@query(f"WITH {OBS} SELECT round(corr(red, nir), 6) AS r, round(sqrt(avg((red - nir) * (red - nir))), 6) AS rms, round(quantile_cont(abs(red - nir), 0.95), 6) AS p95 FROM obs")
def ag24_agreement(spark, d):
    o = adapter(spark, d, "obs")
    return agreement(o, "red", "nir").select(*(r6(F.col(k)).alias(k) for k in ("r", "rms", "p95")))


@query("WITH l AS (SELECT l_quantity AS s, sum((l_returnflag = 'R')::int) AS p, sum((l_returnflag <> 'R')::int) AS n FROM lineitem GROUP BY 1), w AS (SELECT p, n, p * (sum(n) OVER (ORDER BY s) - n + n / 2) AS won FROM l) SELECT sum(p)::bigint AS n_pos, sum(n)::bigint AS n_neg, round(sum(won) / (sum(p) * sum(n)), 6) AS auc FROM w")
def ag25_auc(spark, d):
    return auc(spark.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", F.col("l_returnflag") == "R").withColumn("auc", r6(F.col("auc")))


@query("WITH y AS (SELECT o_orderpriority AS k, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT k, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN regr_slope(v, y) * 10 END, 4) AS per_decade, round(CASE WHEN count(*) >= 3 THEN arg_max(v, y) - arg_min(v, y) END, 6) AS change FROM y GROUP BY k")
def ch23_trend(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    return trend(o, ["k"], "y", "v").select("k", "n", F.round("per_decade", 4).alias("per_decade"), r6(F.col("change")).alias("change"))


@query("WITH h AS (SELECT least(greatest(floor(l_quantity / (50::double / 256)), 0), 255)::int AS bin, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT bin, n, (bin + 0.5) * (50::double / 256) AS mid FROM h), r AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS w0, sum(n * mid) OVER (ORDER BY bin) AS s0, sum(n) OVER () AS w, sum(n * mid) OVER () AS s FROM m), b AS (SELECT bin, w0 * (w - w0) * power(s0 / w0 - (s - s0) / (w - w0), 2) AS g FROM r WHERE w0 < w) SELECT (bin + 1) * (50::double / 256) AS threshold FROM b ORDER BY round(g, 6) DESC, bin LIMIT 1")
def gr6_otsu(spark, d):
    return otsu(spark.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", 0.0, 50.0)


_DAYS = "v AS (SELECT event_type AS sat, ts::date AS day, avg(value) AS v FROM events GROUP BY 1, 2)"


def day_means(spark, d):
    return adapter(spark, d, "point").groupBy("sat", "day").agg(F.avg("value").alias("v"))


@query(f"WITH {_DAYS}, b AS (SELECT sat, max(CASE WHEN NOT v > 46 THEN day END) AS br FROM v GROUP BY sat) SELECT v.sat AS sat, count(*) AS run_days, min(day) AS since FROM v JOIN b ON v.sat = b.sat WHERE br IS NULL OR day > br GROUP BY v.sat")
def ch34_trailing_episode(spark, d):
    return trailing_run(day_means(spark, d), ["sat"], "day", F.col("v") > 46)


@query(f"WITH {_DAYS}, m AS (SELECT *, sum((NOT v > 50)::int) OVER (PARTITION BY sat ORDER BY day) AS g FROM v) SELECT sat, count(*) AS n, min(day) AS first, max(day) AS last FROM m WHERE v > 50 GROUP BY sat, g")
def wn4_runs(spark, d):
    return runs(day_means(spark, d), ["sat"], "day", F.col("v") > 50)


@query(f"WITH {POINT} SELECT day, count(*) AS n, sum(count(*)) OVER (ORDER BY day)::bigint AS so_far, rank() OVER (ORDER BY count(*) DESC) AS rank FROM point GROUP BY day")
def wn8_running_counts(spark, d):
    """Windows over one row a day."""
    n = adapter(spark, d, "point").groupBy("day").agg(F.count("*").alias("n"))
    return n.select("day", "n", F.sum("n").over(Window.orderBy("day")).alias("so_far"), F.rank().over(Window.orderBy(F.desc("n"))).cast("long").alias("rank"))


@query(f"WITH {POINT}, m AS (SELECT sat, day, avg(value) AS v FROM point GROUP BY sat, day) SELECT sat, day, round(avg(v) OVER (PARTITION BY sat ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth, round(v - lag(v) OVER (PARTITION BY sat ORDER BY day), 6) AS step FROM m")
def wn5_smoothed(spark, d):
    w = Window.partitionBy("sat").orderBy("day")
    m = day_means(spark, d)
    return m.select("sat", "day", r6(F.avg("v").over(w.rowsBetween(-2, 2))).alias("smooth"), r6(F.col("v") - F.lag("v").over(w)).alias("step"))


@query(f"WITH {POINT} SELECT event_id, round(2 * 6371.0 * asin(sqrt(least(power(sin(radians(lat - 0) / 2), 2) + cos(radians(0)) * cos(radians(lat)) * power(sin(radians(lon - 105) / 2), 2), 1))), 6) AS km FROM point")
def fn17_haversine(spark, d):
    return adapter(spark, d, "point").select("event_id", r6(haversine_km(F.lit(105.0), F.lit(0.0), F.col("lon"), F.col("lat"))).alias("km"))


@query(f"WITH {POINT}, k AS (SELECT CASE WHEN value >= 40 THEN 0 WHEN value >= 30 THEN 1 WHEN value >= 20 THEN 2 WHEN value >= 10 THEN 3 WHEN value >= -1 THEN 4 END AS vhi, CASE WHEN value <= 15.5 THEN 0 WHEN value <= 55.4 THEN 1 WHEN value <= 150.4 THEN 2 WHEN value <= 250.4 THEN 3 ELSE 4 END AS ispu FROM point) SELECT vhi, ispu, count(*) AS n FROM k GROUP BY vhi, ispu")
def fn22_class_lookups(spark, d):
    p, v = adapter(spark, d, "point"), F.col("value")
    return p.groupBy(class_from_above(v, VHI).alias("vhi"), class_up_to(v, ISPU).alias("ispu")).agg(F.count("*").alias("n"))


_CELLS = "v AS (SELECT r, c, CASE WHEN avg(nir) + avg(red) <> 0 THEN (avg(nir) - avg(red)) / (avg(nir) + avg(red)) END AS v FROM obs GROUP BY r, c)"


@query(f"WITH {OBS}, {_CELLS}, p AS (SELECT quantile_cont(v, 0.9) AS p90, avg(v) AS m FROM v) SELECT count(*) AS n, round(avg(r), 6) AS row, round(avg(c), 6) AS col, round(any_value(p90), 6) AS p90, round(any_value(p90 / m), 6) AS skew FROM v, p WHERE v >= p90")
def ch32_top_pocket(spark, d):
    v = adapter(spark, d, "obs").groupBy("r", "c").agg(F.avg("nir").alias("nir"), F.avg("red").alias("red")).select("r", "c", index("NDVI").alias("v"))
    p = v.agg(F.percentile("v", 0.9).alias("p90"), F.avg("v").alias("m"))
    top = v.crossJoin(F.broadcast(p)).where("v >= p90")
    return top.agg(F.count("*").alias("n"), r6(F.avg("r")).alias("row"), r6(F.avg("c")).alias("col"), r6(F.first("p90")).alias("p90"), r6(F.first(F.col("p90") / F.col("m"))).alias("skew"))
