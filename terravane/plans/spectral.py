"""Queries: masks, indices, composites and change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classes import drought_class, population_class, population_pct
from ..functions.indices import decibels, index
from ..functions.masks import clear_qa, clear_scl, masked
from ..operators.change import (
    change_summary,
    condition_index,
    epochs,
    first_loss,
    first_over,
    latest_common_pair,
    optical_change,
    orbit_choice,
    window_z,
)
from ..operators.composite import block_sum, composite, daily, period_composite, solar_days, widened, yearly_recurrence
from ..sources.adapters import adapter, adapter_sql
from .registry import query, r6

BANDS = ["green", "red", "nir", "swir1", "swir2", "tir"]
CLEAR = "clear AS (SELECT r, c, cell, day, scene_id, " + ", ".join(f"CASE WHEN (qa & 31) = 0 THEN {b} END AS {b}" for b in BANDS) + " FROM obs)"
MEDIANS = "med AS (SELECT r, c, " + ", ".join(f"median({b}) AS {b}" for b in BANDS) + " FROM clear GROUP BY r, c)"


def clear(spark, d):
    obs = adapter(spark, d, "obs")
    return obs.select("r", "c", "cell", "day", "scene_id", *masked(clear_qa(F.col("qa")), BANDS))


def nd(a, b):
    return f"CASE WHEN {a} + {b} <> 0 THEN ({a} - {b}) / ({a} + {b}) END"


def sql(*ctes, select):
    return f"WITH {', '.join(ctes)} {select}"


OBS = adapter_sql("obs")
SCENE = adapter_sql("scene")


@query(f"WITH {SCENE} SELECT scene_id, day, cloud_pct FROM scene WHERE west < 110 AND west + 1 > 100 AND south < 0 AND south + 1 > -8 AND day >= date '1995-01-01' AND day < date '1996-01-01' AND cloud_pct <= 60")
def sc1_scenes(spark, d):
    s = adapter(spark, d, "scene")
    box = (F.col("west") < 110) & (F.col("west") + 1 > 100) & (F.col("south") < 0) & (F.col("south") + 1 > -8)
    when = (F.col("day") >= F.lit("1995-01-01").cast("date")) & (F.col("day") < F.lit("1996-01-01").cast("date"))
    return s.where(box & when & (F.col("cloud_pct") <= 60)).select("scene_id", "day", "cloud_pct")


@query(f"WITH {SCENE} SELECT scene_id, 'a' AS sensor FROM scene WHERE collection = '1-URGENT' AND cloud_pct < 30 UNION ALL SELECT scene_id, 'b' AS sensor FROM scene WHERE collection = '2-HIGH' AND cloud_pct < 30")
def sc3_archive_union(spark, d):
    s = adapter(spark, d, "scene").where("cloud_pct < 30")
    part = lambda name, sensor: s.where(F.col("collection") == name).select("scene_id", F.lit(sensor).alias("sensor"))
    return part("1-URGENT", "a").unionByName(part("2-HIGH", "b"))


@query(f"WITH {OBS} SELECT scl, count(*) AS n, count(CASE WHEN scl NOT IN (3, 8, 9, 10, 11) THEN red END) AS n_clear FROM obs GROUP BY scl")
def pr1_scene_class_mask(spark, d):
    return adapter(spark, d, "obs").groupBy("scl").agg(F.count("*").alias("n"), F.count(F.when(clear_scl(F.col("scl")), F.col("red"))).alias("n_clear"))


@query(sql(OBS, CLEAR, select="SELECT r, c, count(red) AS n_clear, count(*) AS n FROM clear GROUP BY r, c"))
def pr2_qa_mask(spark, d):
    return clear(spark, d).groupBy("r", "c").agg(F.count("red").alias("n_clear"), F.count("*").alias("n"))


ND = {"ndvi": ("nir", "red"), "ndbi": ("swir1", "nir"), "ndwi": ("green", "nir"), "nbr": ("nir", "swir2"), "ui": ("swir2", "nir"), "mndwi": ("green", "swir1")}


@query(sql(OBS, CLEAR, MEDIANS, select="SELECT r, c, " + ", ".join(f"round({nd(a, b)}, 6) AS {k}" for k, (a, b) in ND.items()) + " FROM med"))
def fn1_normalized_differences(spark, d):
    return composite(clear(spark, d), BANDS).select("r", "c", *(r6(index(k.upper())).alias(k) for k in ND))


SAVI = "CASE WHEN nir + red + 0.5::double <> 0 THEN (nir - red) * 1.5::double / (nir + red + 0.5::double) END"


@query(
    sql(
        OBS,
        CLEAR,
        MEDIANS,
        f"a AS (SELECT *, {SAVI} AS savi, {nd('swir1', 'nir')} AS ndbi, {nd('nir', 'red')} AS ndvi, {nd('green', 'swir1')} AS mndwi, least(greatest(tir / 50, 0), 1) AS heat FROM med)",
        "b AS (SELECT *, (savi + mndwi) / 2 AS x, ((mndwi + 1) / 2 + least(greatest(nir, 0), 1) + least(greatest(swir1, 0), 1)) / 3 AS y FROM a)",
        select=f"SELECT r, c, round(savi, 6) AS savi, round(ndbi - ndvi, 6) AS bu, round(least(greatest({nd('ndbi', 'x')}, -1), 1), 6) AS ibi, round(least(greatest({nd('heat', 'y')}, -1), 1), 6) AS ndisi, round((swir1 - nir) / (sqrt(greatest(swir1 + tir, 1e-6)) * 10) * 100, 6) AS ebbi FROM b",
    )
)
def fn2_built_up_indices(spark, d):
    return composite(clear(spark, d), BANDS).select("r", "c", *(r6(index(k.upper())).alias(k) for k in ("savi", "bu", "ibi", "ndisi", "ebbi")))


@query(f"WITH {OBS} SELECT r, c, round(10 * log10(avg(CASE WHEN vv > 0 THEN vv END)), 6) AS vv_db, round(10 * log10(avg(CASE WHEN vh > 0 THEN vh END)), 6) AS vh_db FROM obs GROUP BY r, c")
def fn15_backscatter_db(spark, d):
    power = lambda b: F.avg(F.when(F.col(b) > 0, F.col(b)))
    return adapter(spark, d, "obs").groupBy("r", "c").agg(*(r6(decibels(power(b))).alias(f"{b}_db") for b in ("vv", "vh")))


@query(sql(OBS, CLEAR, select="SELECT r, c, " + ", ".join(f"round(median({b}), 6) AS {b}" for b in BANDS) + ", count(red) AS n_obs FROM clear WHERE day >= date '1996-01-01' AND day < date '1997-01-01' GROUP BY r, c"))
def tc1_median_composite(spark, d):
    year = clear(spark, d).where("day >= date'1996-01-01' AND day < date'1997-01-01'")
    return composite(year, BANDS).select("r", "c", *(r6(F.col(b)).alias(b) for b in BANDS), "n_obs")


@query(sql(OBS, CLEAR, "g AS (SELECT DISTINCT r, c FROM obs), n AS (SELECT r, c, count(red) AS k FROM clear WHERE day >= date '1996-01-01' AND day < date '1996-03-01' GROUP BY r, c)", select="SELECT g.r AS r, g.c AS c, coalesce(k, 0) AS n_clear FROM g LEFT JOIN n ON g.r = n.r AND g.c = n.c"))
def tc2_clear_counts(spark, d):
    cells = clear(spark, d)
    when = F.col("day").between(F.lit("1996-01-01").cast("date"), F.lit("1996-02-29").cast("date"))
    return cells.groupBy("r", "c").agg(F.count(F.when(when, F.col("red"))).alias("n_clear"))


@query(sql(OBS, CLEAR, select="SELECT r, c, round(avg(tir), 6) AS mean, max(tir) AS most, min(tir) AS least, round(sum(tir), 6) AS total, count(tir) AS n FROM clear GROUP BY r, c"))
def tc3_reducers(spark, d):
    return clear(spark, d).groupBy("r", "c").agg(r6(F.avg("tir")).alias("mean"), F.max("tir").alias("most"), F.min("tir").alias("least"), r6(F.sum("tir")).alias("total"), F.count("tir").alias("n"))


@query(sql(OBS, CLEAR, select=f"SELECT r, c, round(median({nd('nir', 'red')}), 6) AS median_of_index, round({nd('median(nir)', 'median(red)')}, 6) AS index_of_median FROM clear GROUP BY r, c"))
def tc4_median_of_index(spark, d):
    cells = clear(spark, d).withColumn("ndvi", index("NDVI"))
    return composite(cells, ["ndvi", "nir", "red"]).select("r", "c", r6(F.col("ndvi")).alias("median_of_index"), r6(index("NDVI")).alias("index_of_median"))


@query("WITH cal AS (SELECT unnest(generate_series(date '1992-01-01', date '1992-03-31', interval 1 day))::date AS day), n AS (SELECT l_shipdate::date AS day, avg(l_quantity) AS m, sum(l_quantity) AS s FROM lineitem GROUP BY 1) SELECT cal.day AS day, round(m, 6) AS mean, coalesce(s, 0::double) AS total FROM cal LEFT JOIN n USING (day)")
def tc5_daily_series(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.to_date("l_shipdate").alias("day"), "l_quantity")
    series = lambda how: daily(rows, "day", "l_quantity", "1992-01-01", "1992-04-01", how)
    return series("mean").select("day", r6(F.col("value")).alias("mean")).join(series("sum").withColumnRenamed("value", "total"), "day")


@query(sql(OBS, "y AS (SELECT r, c, year(day) AS y, max((nir < 0.05)::int) AS hit FROM obs GROUP BY r, c, year(day))", select="SELECT r, c, sum(hit)::bigint AS years_hit FROM y GROUP BY r, c"))
def tc7_recurrence(spark, d):
    return yearly_recurrence(adapter(spark, d, "obs"), F.col("nir") < 0.05)


@query(sql(OBS, "f AS (SELECT *, abs(year(day) - 1999) AS away FROM obs), p AS (SELECT CASE WHEN away <= 0 THEN 0 WHEN away <= 1 THEN 1 WHEN away <= 2 THEN 2 END AS pad, * FROM f), q AS (SELECT * FROM p WHERE pad <= (SELECT min(pad) FROM p))", select="SELECT r, c, count(*) AS n FROM q GROUP BY r, c"))
def tc9_widened_window(spark, d):
    return widened(adapter(spark, d, "obs"), 1999).groupBy("r", "c").agg(F.count("*").alias("n"))


@query(sql(OBS, CLEAR, "s AS (SELECT r, c, day, avg(red) AS red, avg(nir) AS nir FROM clear GROUP BY r, c, day)", select="SELECT r, c, round(median(red), 6) AS red, round(median(nir), 6) AS nir, count(coalesce(red, nir)) AS n_obs FROM s GROUP BY r, c"))
def tc10_solar_day_median(spark, d):
    return composite(solar_days(clear(spark, d), ["red", "nir"]), ["red", "nir"]).select("r", "c", r6(F.col("red")).alias("red"), r6(F.col("nir")).alias("nir"), "n_obs")


@query(sql(OBS, select="SELECT (r // 3)::int AS r, (c // 3)::int AS c, count(*) AS n FROM obs WHERE r < 18 AND c < 18 GROUP BY 1, 2"))
def tc13_block_sum(spark, d):
    counts = adapter(spark, d, "obs").groupBy("r", "c").agg(F.count("*").alias("n"))
    return block_sum(counts, "n", 3, 20, 20)


_SIDES = "s AS (SELECT r, c, " + ", ".join(f"median(CASE WHEN day {'>=' if k else '<'} date '1998-01-01' THEN {b} END) AS {b}_{k}" for k in (0, 1) for b in ("green", "red", "nir", "swir1")) + ", count(CASE WHEN day < date '1998-01-01' THEN red END) AS n_0, count(CASE WHEN day >= date '1998-01-01' THEN red END) AS n_1 FROM clear GROUP BY r, c)"
_DELTA = f"k AS (SELECT *, n_0 >= 2 AND n_1 >= 2 AND NOT coalesce(({nd('green_0', 'swir1_0')}) >= 0 AND ({nd('green_1', 'swir1_1')}) >= 0, false) AS kept FROM s), d AS (SELECT *, CASE WHEN kept THEN ({nd('nir_1', 'red_1')}) - ({nd('nir_0', 'red_0')}) END AS delta FROM k)"


@query(sql(OBS, CLEAR, _SIDES, _DELTA, select="SELECT r, c, n_0, n_1, kept, round(delta, 6) AS delta, delta < -0.15::double AS affected, delta < -0.3::double AS severe FROM d"))
def ch1_change_cells(spark, d):
    return optical_change(clear(spark, d), "1998-01-01").withColumn("delta", r6(F.col("delta")))


@query(sql(OBS, CLEAR, _SIDES, _DELTA, select="SELECT count(delta) AS n_valid, round(avg(delta), 6) AS mean_delta, round(100 * avg((delta < -0.15::double)::int), 6) AS pct_affected, round(100 * avg((delta < -0.3::double)::int), 6) AS pct_severe, round(100 * avg((NOT kept)::int), 6) AS pct_dropped FROM d"))
def ch1_change_summary(spark, d):
    s = change_summary(optical_change(clear(spark, d), "1998-01-01"))
    return s.select("n_valid", *(r6(F.col(x)).alias(x) for x in ("mean_delta", "pct_affected", "pct_severe", "pct_dropped")))


@query(sql(OBS, "p AS (SELECT r, c, vh, CASE WHEN year(day) <= 1994 THEN 'p0' WHEN year(day) <= 1996 THEN 'p1' ELSE 'p2' END AS p FROM obs)", select="SELECT r, c, " + ", ".join(f"round(10 * log10(avg(CASE WHEN p = '{p}' AND vh > 0 THEN vh END)), 6) AS {p}" for p in ("p0", "p1", "p2")) + " FROM p GROUP BY r, c"))
def ch2_period_composite(spark, d):
    obs = adapter(spark, d, "obs").withColumn("vh", F.when(F.col("vh") > 0, F.col("vh")))
    period = F.when(F.year("day") <= 1994, "p0").when(F.year("day") <= 1996, "p1").otherwise("p2")
    return period_composite(obs, "vh", period, ["p0", "p1", "p2"]).select("r", "c", *(r6(decibels(F.col(p))).alias(p) for p in ("p0", "p1", "p2")))


@query(sql(OBS, CLEAR, "e AS (SELECT r, c, " + ", ".join(f"median(CASE WHEN {w} THEN {nd('swir1', 'nir')} END) AS e{k}" for k, w in enumerate(("year(day) <= 1994", "year(day) BETWEEN 1995 AND 1996", "year(day) >= 1997"))) + " FROM clear GROUP BY r, c)", select="SELECT count(CASE WHEN e0 > 0 THEN 1 END) AS built_0, count(CASE WHEN e1 > 0 THEN 1 END) AS built_1, count(CASE WHEN e2 > 0 THEN 1 END) AS built_2, count(CASE WHEN e2 > 0 AND NOT e0 > 0 THEN 1 END) AS new FROM e"))
def ch5_urban_trend(spark, d, built=0.0):
    y = F.year("day")
    e = epochs(clear(spark, d), index("NDBI"), F.when(y <= 1994, 0).when(y <= 1996, 1).otherwise(2), 3)
    over = lambda k: F.col(f"e{k}") > built
    return e.agg(*(F.count(F.when(over(k), 1)).alias(f"built_{k}") for k in range(3)), F.count(F.when(over(2) & ~over(0), 1)).alias("new"))


_ORBIT = "o AS (SELECT orbit, sum((day < date '1993-01-01')::int)::bigint AS n_0, sum((day >= date '1997-06-01')::int)::bigint AS n_1 FROM scene GROUP BY orbit)"


@query(f"WITH {SCENE}, {_ORBIT} SELECT orbit, n_0, n_1, n_0 > 0 AND n_1 > 0 AS covers_all, n_0 + n_1 AS n_scenes FROM o ORDER BY covers_all DESC, n_scenes DESC, orbit LIMIT 1")
def ch8_orbit_choice(spark, d):
    day = F.col("day")
    return orbit_choice(adapter(spark, d, "scene"), "orbit", [day < F.lit("1993-01-01").cast("date"), day >= F.lit("1997-06-01").cast("date")])


@query(f"WITH {SCENE}, p AS (SELECT rel_orbit, max(CASE WHEN day < date '1995-06-15' THEN (day, scene_id) END) AS pre, min(CASE WHEN day >= date '1995-06-15' THEN (day, scene_id) END) AS post FROM scene GROUP BY rel_orbit) SELECT rel_orbit, pre[1] AS pre_day, pre[2] AS pre_scene, post[1] AS post_day, post[2] AS post_scene FROM p WHERE pre IS NOT NULL AND post IS NOT NULL ORDER BY post_day DESC, rel_orbit LIMIT 1")
def ch9_common_pair(spark, d):
    return latest_common_pair(adapter(spark, d, "scene"), "rel_orbit", "1995-06-15")


@query(f"WITH {SCENE}, s AS (SELECT scene_id, day, cloud_pct, count(*) OVER () > 200 AS truncated FROM scene WHERE cloud_pct < 20) SELECT * FROM s ORDER BY day, scene_id LIMIT 200")
def ch10_inventory(spark, d):
    """A report of 200 scenes; whether there are more comes from a count, not from a window over all rows."""
    s = adapter(spark, d, "scene").where("cloud_pct < 20")
    n = s.agg((F.count("*") > 200).alias("truncated"))
    return s.orderBy("day", "scene_id").limit(200).crossJoin(F.broadcast(n)).select("scene_id", "day", "cloud_pct", "truncated")


_EPOCHS = "e AS (SELECT r, c, " + ", ".join(f"median(CASE WHEN year(day) = {1992 + k} THEN {nd('nir', 'red')} END) AS e{k}" for k in range(6)) + " FROM clear GROUP BY r, c)"
_LOSS = "CASE " + " ".join(f"WHEN e0 - e{k} > 0.2::double THEN {k}" for k in range(1, 6)) + " END"


@query(sql(OBS, CLEAR, _EPOCHS, select=f"SELECT r, c, e0 > 0.3::double AS was_forest, CASE WHEN e0 > 0.3::double THEN {_LOSS} END AS loss_epoch FROM e"))
def ch11_forest_loss(spark, d, baseline=0.3, drop=0.2):
    e = epochs(clear(spark, d), index("NDVI"), F.year("day") - 1992, 6)
    return first_loss(e, 6, baseline, drop).select("r", "c", "was_forest", "loss_epoch")


@query(sql(OBS, CLEAR, _EPOCHS, select="SELECT r, c, CASE " + " ".join(f"WHEN e{k} > 0.35::double THEN {k}" for k in range(6)) + " END AS first_built FROM e"))
def ch12_first_built(spark, d):
    e = epochs(clear(spark, d), index("NDVI"), F.year("day") - 1992, 6)
    return e.select("r", "c", first_over(e, 6, 0.35).alias("first_built"))


_POP = "p AS (SELECT r, c, sum(CASE WHEN year(day) = 1993 THEN tir ELSE 0 END) AS p1, sum(CASE WHEN year(day) = 1997 THEN tir ELSE 0 END) AS p2 FROM obs GROUP BY r, c), q AS (SELECT *, CASE WHEN p1 > 0 THEN 100 * (p2 - p1) / p1 WHEN p2 > 0 THEN 999 ELSE 0 END AS pct FROM p)"


@query(sql(OBS, _POP, select="SELECT r, c, round(pct, 6) AS pct, CASE WHEN greatest(p1, p2) < 50 THEN 0 WHEN pct > 10 THEN 2 WHEN pct < -10 THEN 3 ELSE 1 END AS class FROM q"))
def ch14_population_class(spark, d, neutral_pct=10, least=50):
    year = lambda y: F.sum(F.when(F.year("day") == y, F.col("tir")).otherwise(0.0))
    p = adapter(spark, d, "obs").groupBy("r", "c").agg(year(1993).alias("p1"), year(1997).alias("p2"))
    return p.select("r", "c", r6(population_pct(F.col("p1"), F.col("p2"))).alias("pct"), population_class(F.col("p1"), F.col("p2"), neutral_pct, least).alias("class"))


_Z = "y AS (SELECT r, c, year(day) AS y, avg(red) AS red, avg(tir) AS tir FROM clear WHERE month(day) BETWEEN 6 AND 8 GROUP BY r, c, year(day)), z AS (SELECT r, c, " + ", ".join(
    f"CASE WHEN stddev_pop(CASE WHEN y <> 1997 THEN {b} END) <> 0 THEN (max(CASE WHEN y = 1997 THEN {b} END) - avg(CASE WHEN y <> 1997 THEN {b} END)) / stddev_pop(CASE WHEN y <> 1997 THEN {b} END) END AS {b}_z" for b in ("red", "tir")
) + " FROM y GROUP BY r, c)"


@query(sql(OBS, CLEAR, _Z, select="SELECT r, c, round(red_z, 6) AS z FROM z"))
def ch17_window_z(spark, d):
    summer = clear(spark, d).where(F.month("day").between(6, 8))
    return window_z(summer, ["r", "c"], F.year("day"), "red", 1997).select("r", "c", r6(F.col("z")).alias("z"))


_VCI = "v AS (SELECT r, c, avg(CASE WHEN year(day) = 1997 THEN nir END) AS now, min(CASE WHEN year(day) <> 1997 THEN nir END) AS lo, max(CASE WHEN year(day) <> 1997 THEN nir END) AS hi, avg(CASE WHEN year(day) = 1997 THEN tir END) AS tnow, min(CASE WHEN year(day) <> 1997 THEN tir END) AS tlo, max(CASE WHEN year(day) <> 1997 THEN tir END) AS thi FROM clear GROUP BY r, c), w AS (SELECT r, c, CASE WHEN hi <> lo AND now IS NOT NULL THEN least(greatest((now - lo) / (hi - lo) * 100, 0), 100) END AS vci, CASE WHEN thi <> tlo AND tnow IS NOT NULL THEN least(greatest(100 - (tnow - tlo) / (thi - tlo) * 100, 0), 100) END AS tci FROM v)"


@query(sql(OBS, CLEAR, _VCI, select="SELECT r, c, round(vci, 6) AS vci, round(tci, 6) AS tci, round((vci + tci) / 2, 6) AS vhi FROM w"))
def ch16_vegetation_health(spark, d):
    cells, now = clear(spark, d), F.year("day") == 1997
    v = condition_index(cells, ["r", "c"], now, "nir").select("r", "c", F.col("condition").alias("vci"))
    t = condition_index(cells, ["r", "c"], now, "tir", inverted=True).select("r", "c", F.col("condition").alias("tci"))
    return v.join(t, ["r", "c"]).select("r", "c", r6(F.col("vci")).alias("vci"), r6(F.col("tci")).alias("tci"), r6((F.col("vci") + F.col("tci")) / 2).alias("vhi"))


@query(sql(OBS, CLEAR, _Z, _VCI, "j AS (SELECT z.r AS r, z.c AS c, red_z, tir_z, (vci + tci) / 2 AS vhi FROM z JOIN w ON z.r = w.r AND z.c = w.c), k AS (SELECT CASE WHEN NOT red_z < -1 AND (tir_z < -1 OR vhi < 40) THEN 4 WHEN red_z < -1 AND tir_z < -1 AND vhi < 40 THEN 3 WHEN red_z < -1 AND tir_z < -1 THEN 2 WHEN red_z < -1 THEN 1 ELSE 0 END AS cdi FROM j)", select="SELECT cdi, count(*) AS n FROM k GROUP BY cdi"))
def ch15_combined_drought(spark, d, year=1997):
    cells, now = clear(spark, d), F.year("day") == year
    summer = cells.where(F.month("day").between(6, 8))
    z = lambda b: window_z(summer, ["r", "c"], F.year("day"), b, year).select("r", "c", F.col("z").alias(b))
    v = condition_index(cells, ["r", "c"], now, "nir").select("r", "c", F.col("condition").alias("vci"))
    t = condition_index(cells, ["r", "c"], now, "tir", inverted=True).select("r", "c", F.col("condition").alias("tci"))
    j = z("red").join(z("tir"), ["r", "c"]).join(v, ["r", "c"]).join(t, ["r", "c"])
    return j.groupBy(drought_class(F.col("red"), F.col("tir"), (F.col("vci") + F.col("tci")) / 2).alias("cdi")).agg(F.count("*").alias("n"))
