"""Queries: scene and file tables, series, names and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.masks import clear_thermal, no_nan
from ..operators.assess import dipole, rain_by_year
from ..operators.composite import daily
from ..operators.quantiles import quantiles
from ..operators.stacks import scenes_needed, swept
from ..sources.adapters import WEATHER, adapter, adapter_sql, weather
from .registry import query, r6
from .spectral import CLEAR, clear
from .zonal import JOINED, zoned_points

#: Kinds of events, the columns of a wide table.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
OBS, SCENE, POINT, ZONE, PAIRS = (adapter_sql(x) for x in ("obs", "scene", "point", "zone", "pair_obs"))


@query(f"WITH {SCENE} SELECT collection, orbit, count(*) AS n, min(day) AS first, max(day) AS last FROM scene WHERE cloud_pct < 30 AND day >= date '1994-01-01' AND day < date '1995-01-01' GROUP BY collection, orbit")
def sc2_scene_counts(spark, d):
    s = adapter(spark, d, "scene").where("cloud_pct < 30 AND day >= date'1994-01-01' AND day < date'1995-01-01'")
    return s.groupBy("collection", "orbit").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


@query(f"WITH {SCENE}, p AS (SELECT *, CASE WHEN rel_orbit % 2 = 0 THEN ['VV', 'VH'] ELSE ['HH'] END AS pols FROM scene) SELECT scene_id, day FROM p WHERE list_contains(pols, 'VH') AND orbit = 'F'")
def sc4_radar_scenes(spark, d):
    pols = F.when(F.col("rel_orbit") % 2 == 0, F.array(F.lit("VV"), F.lit("VH"))).otherwise(F.array(F.lit("HH")))
    return adapter(spark, d, "scene").withColumn("pols", pols).where(F.array_contains("pols", "VH") & (F.col("orbit") == "F")).select("scene_id", "day")


@query("WITH f AS (SELECT 'gdas1.' || strftime(o_orderdate, '%b%y') || '.w' || least((day(o_orderdate) - 1) // 7 + 1, 5) AS name FROM orders), k AS (SELECT lower(name) AS name, regexp_extract(name, '\\.w([1-5])$', 1)::int AS week FROM f) SELECT week, count(*) AS n, count(DISTINCT name) AS files FROM k GROUP BY week")
def sc20_archive_listing(spark, d):
    day = F.col("o_orderdate")
    name = F.lower(F.concat(F.lit("gdas1."), F.date_format(day, "MMMyy"), F.lit(".w"), F.least(F.floor((F.dayofmonth(day) - 1) / 7) + 1, F.lit(5)).cast("string")))
    k = spark.read.parquet(f"{d}/orders.parquet").select(name.alias("name")).withColumn("week", F.regexp_extract("name", r"\.w([1-5])$", 1).cast("int"))
    return k.groupBy("week").agg(F.count("*").alias("n"), F.count_distinct("name").alias("files"))


@query("SELECT p_partkey AS k, try_cast(regexp_extract(p_name || ' Baseline: ' || p_size || '.5 m', 'Baseline: ([-0-9.]+)', 1) AS double) AS baseline FROM part")
def sc24_baselines(spark, d):
    text = F.concat("p_name", F.lit(" Baseline: "), F.col("p_size").cast("string"), F.lit(".5 m"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), F.regexp_extract(text, r"Baseline: ([-0-9.]+)", 1).try_cast("double").alias("baseline"))


@query(f"WITH {OBS} SELECT r, c, count(CASE WHEN (qa & 26) = 0 AND (qa & 128) = 0 AND tir > 22 AND tir < 33 THEN tir END) AS n, round(avg(CASE WHEN (qa & 26) = 0 AND (qa & 128) = 0 AND tir > 22 AND tir < 33 THEN tir END), 6) AS lst FROM obs GROUP BY r, c")
def pr3_thermal_mask(spark, d):
    t = F.when(clear_thermal(F.col("qa"), F.col("tir"), 22, 33), F.col("tir"))
    return adapter(spark, d, "obs").groupBy("r", "c").agg(F.count(t).alias("n"), r6(F.avg(t)).alias("lst"))


@query(f"WITH {OBS}, x AS (SELECT r, c, CASE WHEN nir < 0.1 THEN NULL ELSE nir END AS v FROM obs) SELECT count(*) AS n, count(v) AS valid, round(100 * avg((v IS NOT NULL)::int), 6) AS pct, round(100 * avg((v IS NOT NULL)::int), 6) < 2 AS nearly_empty FROM x")
def pr8_valid_share(spark, d):
    v = no_nan(F.when(F.col("nir") < 0.1, F.lit(float("nan"))).otherwise(F.col("nir")))
    x = adapter(spark, d, "obs").select(v.alias("v"))
    pct = 100 * F.avg(F.col("v").isNotNull().cast("int"))
    return x.agg(F.count("*").alias("n"), F.count("v").alias("valid"), r6(pct).alias("pct"), (r6(pct) < 2).alias("nearly_empty"))


@query("WITH h AS (SELECT ts::date AS day, count(DISTINCT hour(ts)) AS hours FROM events GROUP BY 1) SELECT (SELECT max(day) FROM h WHERE hours >= 24) AS last_complete, count(*) AS days, count(CASE WHEN hours < 24 THEN 1 END) AS incomplete FROM h")
def pr19_coverage(spark, d):
    h = spark.read.parquet(f"{d}/events.parquet").groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct(F.hour("ts")).alias("hours"))
    whole = F.col("hours") >= 24
    return h.agg(F.max(F.when(whole, F.col("day"))).alias("last_complete"), F.count("*").alias("days"), F.count(F.when(~whole, 1)).alias("incomplete"))


@query("SELECT p_partkey AS k, CASE WHEN trim(p_brand) = '' OR p_brand IS NULL THEN 'outside' WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'conservation' ELSE upper(p_brand[1]) || lower(p_brand[2:]) END AS grp FROM part")
def fn23_groups(spark, d):
    b = F.col("p_brand")
    grp = F.when(b.isNull() | (F.trim(b) == ""), "outside").when(b.isin("Brand#11", "Brand#12"), "conservation").otherwise(F.initcap(b))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), grp.alias("grp"))


@query("SELECT n_nationkey AS k, n_nationkey || CASE WHEN n_nationkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n_nationkey % 10 = 1 THEN 'st' WHEN n_nationkey % 10 = 2 THEN 'nd' WHEN n_nationkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal FROM nation")
def fn25_ordinals(spark, d):
    k = F.col("n_nationkey")
    end = F.when((k % 100).between(11, 13), "th").when(k % 10 == 1, "st").when(k % 10 == 2, "nd").when(k % 10 == 3, "rd").otherwise("th")
    return spark.read.parquet(f"{d}/nation.parquet").select(k.alias("k"), F.concat(k.cast("string"), end).alias("ordinal"))


@query(f"WITH {ZONE} SELECT zone_id, i::int AS i, split_part(spec, ',', 1) AS name, split_part(spec, ',', 2)::double AS lon, split_part(spec, ',', 3)::double AS lat FROM (SELECT zone_id, unnest([name || ',' || w || ',' || s, name || ' far,' || e || ',' || n]) AS spec, unnest([0, 1]) AS i FROM zone)")
def fn31_receptors(spark, d):
    """Parses lists of Name,lon,lat entries; an entry that isn't one raises an error with its number."""
    z = adapter(spark, d, "zone").withColumn("spec", F.concat(F.concat_ws(",", "name", "w", "s"), F.lit(";"), F.concat(F.col("name"), F.lit(" far")), F.lit(","), F.concat_ws(",", "e", "n")))
    e = z.select("zone_id", F.posexplode(F.split("spec", ";")).alias("i", "entry")).withColumn("p", F.split("entry", ","))
    bad = (F.size("p") != 3) | F.get("p", F.lit(1)).try_cast("double").isNull() | F.get("p", F.lit(2)).try_cast("double").isNull()
    e = e.withColumn("p", F.when(bad, F.raise_error(F.concat(F.lit("entry "), F.col("i").cast("string"), F.lit(" isn't Name,lon,lat")))).otherwise(F.col("p")))
    return e.select("zone_id", "i", F.col("p")[0].alias("name"), F.col("p")[1].cast("double").alias("lon"), F.col("p")[2].cast("double").alias("lat"))


@query(f"WITH {PAIRS}, s AS (SELECT cell, stddev_samp(phase) AS sigma, count(CASE WHEN d1 < date '1996-01-01' THEN 1 END) AS n_pre FROM pair_obs GROUP BY cell) SELECT cell, n_pre, (SELECT min(n) FROM range(1, 201) t(n) WHERE 2 * sigma * sqrt(1 / n_pre::double + 1 / n::double) <= 1)::int AS needed FROM s WHERE n_pre > 0")
def fn34_scenes_needed(spark, d):
    """By cell: the least number of scenes after an event for which two standard errors of a step come within 1, from the scatter of its phases."""
    s = adapter(spark, d, "pair_obs").groupBy("cell").agg(F.stddev_samp("phase").alias("sigma"), F.count(F.when(F.col("d1") < F.lit("1996-01-01").cast("date"), 1)).alias("n_pre"))
    return s.where("n_pre > 0").select("cell", "n_pre", scenes_needed(F.col("sigma"), F.col("n_pre"), 1.0, 200).alias("needed"))


@query("SELECT user_id AS k, arg_max(value, (ts, event_id)) AS latest, max(ts)::date AS day FROM events GROUP BY user_id")
def tc6_latest(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("k")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"), F.to_date(F.max("ts")).alias("day"))


@query("SELECT user_id AS k, " + ", ".join(f"round(avg(CASE WHEN event_type = '{t}' THEN value END), 6) AS {t}" for t in EVENT_TYPES) + " FROM events GROUP BY user_id")
def tc8_wide(spark, d):
    wide = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("k")).pivot("event_type", list(EVENT_TYPES)).agg(F.avg("value"))
    return wide.select("k", *(r6(F.col(t)).alias(t) for t in EVENT_TYPES))


@query("SELECT user_id AS k, (ts + interval 12 hours)::date AS day, round(sum(value), 6) AS rain FROM events GROUP BY 1, 2")
def tc12_rain_to_noon(spark, d):
    """Sums of the 24 hours that end at noon of a day."""
    day = F.to_date(F.col("ts") + F.expr("INTERVAL 12 HOURS"))
    return spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("k"), day.alias("day")).agg(r6(F.sum("value")).alias("rain"))


@query(f"WITH weather AS ({WEATHER}), y AS (SELECT week(day) AS y, sum(rain) AS rain FROM weather GROUP BY 1), s AS (SELECT y, rain, avg(rain) OVER () AS m, stddev_pop(rain) OVER () AS sd FROM y) SELECT y, round((rain - m) / sd, 6) AS z, round(100 * rain / m, 6) AS pct, rank() OVER (ORDER BY round(rain, 6)) AS driest FROM s")
def ch18_rain_anomaly(spark, d):
    """Weeks stand for years."""
    return rain_by_year(weather(spark, d), F.weekofyear("day"), "rain", 6).select("y", r6(F.col("z")).alias("z"), r6(F.col("pct")).alias("pct"), "driest")


@query(f"WITH {POINT}, m AS (SELECT day, avg(CASE WHEN lon < 103 THEN value END) AS west, avg(CASE WHEN lon >= 107 THEN value END) AS east FROM point GROUP BY day) SELECT day, round((west - avg(west) OVER ()) - (east - avg(east) OVER ()), 6) AS dipole FROM m")
def ch20_dipole(spark, d):
    return dipole(adapter(spark, d, "point"), F.col("lon") < 103, F.col("lon") >= 107, "day", "value").withColumn("dipole", r6(F.col("dipole")))


@query(f"WITH {OBS}, {CLEAR}, y AS (SELECT r, c, year(day) AS y, avg(tir) AS v FROM clear WHERE tir IS NOT NULL GROUP BY r, c, year(day)) SELECT r, c, round(CASE WHEN count(CASE WHEN y <= 1993 THEN 1 END) >= 2 AND count(CASE WHEN y >= 1997 THEN 1 END) >= 2 THEN avg(CASE WHEN y >= 1997 THEN v END) - avg(CASE WHEN y <= 1993 THEN v END) END, 6) AS change FROM y GROUP BY r, c")
def ch22_decadal_change(spark, d):
    y = clear(spark, d).where("tir IS NOT NULL").groupBy("r", "c", F.year("day").alias("y")).agg(F.avg("tir").alias("v"))
    early, late = F.when(F.col("y") <= 1993, F.col("v")), F.when(F.col("y") >= 1997, F.col("v"))
    gate = (F.count(early) >= 2) & (F.count(late) >= 2)
    return y.groupBy("r", "c").agg(r6(F.when(gate, F.avg(late) - F.avg(early))).alias("change"))


@query(f"WITH {POINT}, {ZONE}, {JOINED}, n AS (SELECT country, year(day) * 100 + week(day) AS w, count(*) AS n FROM j WHERE zone_id IS NOT NULL GROUP BY 1, 2) SELECT country, w, n, round(100 * n / sum(n) OVER (PARTITION BY w), 6) AS pct, rank() OVER (PARTITION BY w ORDER BY n DESC) AS rank FROM n")
def ag12_area_ranking(spark, d):
    n = zoned_points(spark, d).where("zone_id IS NOT NULL").groupBy("country", (F.year("day") * 100 + F.weekofyear("day")).cast("long").alias("w")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("w")
    return n.select("country", "w", "n", r6(100 * F.col("n") / F.sum("n").over(w)).alias("pct"), F.rank().over(w.orderBy(F.desc("n"))).cast("long").alias("rank"))


@query(f"WITH {OBS}, k AS (SELECT scene_id, count(*) AS k FROM obs GROUP BY scene_id), n AS (SELECT k, count(*) AS n FROM k GROUP BY k) SELECT arg_max(k, (n, -k)) AS modal, max(k) - min(k) AS spread FROM n")
def ag31_modal_size(spark, d):
    """The commonest size, the smallest among equals."""
    k = adapter(spark, d, "obs").groupBy("scene_id").agg(F.count("*").alias("k"))
    n = k.groupBy("k").agg(F.count("*").alias("n"))
    return n.agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("modal"), (F.max("k") - F.min("k")).alias("spread"))


@query(f"WITH {POINT} SELECT round(quantile_cont(lon, 0.01), 6) AS w, round(quantile_cont(lon, 0.99), 6) AS e, round(quantile_cont(lat, 0.01), 6) AS s, round(quantile_cont(lat, 0.99), 6) AS n FROM point WHERE conf >= 60")
def ag32_robust_box(spark, d):
    p = adapter(spark, d, "point").where("conf >= 60")
    sides = quantiles(p, "lon", {"w": 0.01, "e": 0.99}).drop("n").crossJoin(quantiles(p, "lat", {"s": 0.01, "n_": 0.99}).drop("n"))  # one row each
    return sides.select(r6(F.col("w")).alias("w"), r6(F.col("e")).alias("e"), r6(F.col("s")).alias("s"), r6(F.col("n_")).alias("n"))


@query(f"WITH cal AS (SELECT unnest(generate_series(date '2023-12-30', date '2024-01-09', interval 1 day))::date AS day), {POINT}, n AS (SELECT day, count(*) AS n FROM point GROUP BY day) SELECT cal.day AS day, coalesce(n, 0) AS n FROM cal LEFT JOIN n USING (day)")
def jf1_calendar(spark, d):
    return daily(adapter(spark, d, "point"), "day", "event_id", "2023-12-30", "2024-01-10", "count").withColumnRenamed("value", "n")


@query("WITH c AS (SELECT * FROM (VALUES (1, 0::double, 1000::double), (2, 1000::double, 5000::double), (3, 5000::double, 1e9::double)) t(code, lo, hi)) SELECT code, count(*) AS n FROM customer JOIN c ON c_acctbal >= lo AND c_acctbal < hi GROUP BY code")
def jr2_class_intervals(spark, d):
    """A class table of three rows, joined by range."""
    c = spark.createDataFrame([(1, 0.0, 1000.0), (2, 1000.0, 5000.0), (3, 5000.0, 1e9)], "code int, lo double, hi double")
    cust = spark.read.parquet(f"{d}/customer.parquet")
    return cust.join(F.broadcast(c), (F.col("c_acctbal") >= F.col("lo")) & (F.col("c_acctbal") < F.col("hi"))).groupBy("code").agg(F.count("*").alias("n"))


@query(f"WITH {OBS}, v AS (SELECT r, avg(red) AS v FROM obs GROUP BY r), m AS (SELECT depth, lat, avg(power(v - depth / sqrt(depth * depth + power(r - lat, 2)), 2)) AS misfit FROM v, (SELECT unnest(range(1, 11))::double AS depth), (SELECT unnest(range(0, 20))::double AS lat) GROUP BY depth, lat) SELECT depth::int AS depth, lat::int AS lat, round(misfit, 6) AS misfit FROM m")
def jx1_sweep(spark, d):
    """Misfit of a buried source's profile to the rows' means, for each depth and place of two short lists."""
    v = adapter(spark, d, "obs").groupBy("r").agg(F.avg("red").alias("v"))
    m = swept(v, {"depth": range(1, 11), "lat": range(20)})
    model = F.col("depth") / F.sqrt(F.col("depth") * F.col("depth") + F.pow(F.col("r") - F.col("lat"), F.lit(2.0)))
    return m.groupBy("depth", "lat").agg(r6(F.avg(F.pow(F.col("v") - model, F.lit(2.0)))).alias("misfit"))


@query("WITH o AS (SELECT o_orderkey AS k, 'v2:' || o_orderkey AS name, 'old-' || o_orderkey AS legacy FROM orders), j AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'v2:' || l_orderkey ELSE 'old-' || l_orderkey END AS name FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 > 0 GROUP BY 1) SELECT o.k AS k, CASE WHEN a.name IS NOT NULL THEN 'known' WHEN b.name IS NOT NULL THEN 'legacy' ELSE 'missing' END AS state FROM o LEFT JOIN j a ON a.name = o.name LEFT JOIN j b ON b.name = o.legacy")
def je3_legacy_names(spark, d):
    k = F.col("o_orderkey").cast("string")
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("v2:"), k).alias("name"), F.concat(F.lit("old-"), k).alias("legacy"))
    key = F.col("l_orderkey").cast("string")
    j = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber = 1 AND l_orderkey % 3 > 0").select(F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("v2:"), key)).otherwise(F.concat(F.lit("old-"), key)).alias("job")).distinct()
    a, b = j.select(F.col("job").alias("a")), j.select(F.col("job").alias("b"))
    found = o.join(a, o.name == F.col("a"), "left").join(b, o.legacy == F.col("b"), "left")
    return found.select("k", F.when(F.col("a").isNotNull(), "known").when(F.col("b").isNotNull(), "legacy").otherwise("missing").alias("state"))


@query("WITH f AS (SELECT event_id, ts, unnest(generate_series(time_bucket(interval 6 hours, ts) + interval 6 hours, time_bucket(interval 6 hours, ts) + interval 12 hours, interval 6 hours)) AS frame FROM events) SELECT frame, count(*) AS n FROM f WHERE ts > frame - interval 12 hours GROUP BY frame")
def wn7_trailing_frames(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"))
    six = F.expr("INTERVAL 6 HOURS")
    start = F.window("ts", "6 hours").start
    frames = e.select("ts", start.alias("s")).select("ts", F.explode(F.array(F.col("s") + six, F.col("s") + six + six)).alias("frame"))
    kept = frames.where(F.col("ts") > F.col("frame") - six - six)
    return kept.groupBy(F.col("frame").cast("timestamp_ntz").alias("frame")).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k, round(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) / greatest(count(*), 1e-6), 6) AS young, count(*) AS people FROM customer GROUP BY c_nationkey")
def su1_age_share(spark, d):
    young = F.sum(F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0))
    return spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_nationkey").alias("k")).agg(r6(young / F.greatest(F.count("*"), F.lit(1e-6))).alias("young"), F.count("*").alias("people"))


@query(f"WITH {POINT} SELECT sat, count(*) AS n FROM point WHERE day >= (SELECT max(day) FROM point) - 6 GROUP BY sat")
def su4_last_week(spark, d):
    p = adapter(spark, d, "point")
    newest = p.agg(F.max("day").alias("newest"))
    return p.join(F.broadcast(newest), F.col("day") >= F.date_sub("newest", 6)).groupBy("sat").agg(F.count("*").alias("n"))


@query("WITH y AS (SELECT o_orderpriority AS k, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT k, round(arg_max(v, y) / arg_min(v, y), 6) AS ratio FROM y GROUP BY k")
def su39_first_to_last(spark, d):
    y = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    return y.groupBy("k").agg(r6(F.max_by("v", "y") / F.min_by("v", "y")).alias("ratio"))


@query("WITH p AS (SELECT l_orderkey AS k, avg(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END) AS a, avg(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END) AS b FROM lineitem GROUP BY l_orderkey) SELECT round(median(a), 6) AS before, round(median(b), 6) AS after, round(100 * avg((b < a)::int), 6) AS pct_improved FROM p WHERE a IS NOT NULL AND b IS NOT NULL")
def su40_correction_effect(spark, d):
    side = lambda odd: F.avg(F.when(F.col("l_linenumber") % 2 == odd, F.col("l_quantity")))
    p = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(side(1).alias("a"), side(0).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    middle = lambda c, name: quantiles(p, c, {name: 0.5}).select(r6(F.col(name)).alias(name))
    better = p.agg(r6(100 * F.avg((F.col("b") < F.col("a")).cast("int"))).alias("pct_improved"))
    return middle("a", "before").crossJoin(middle("b", "after")).crossJoin(better)  # one row each
