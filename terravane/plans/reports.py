"""Queries: runs of haze, names and texts of reports, numbers for display, and what is due."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.fire import DC_DAYLENGTH, DC_TROPICS, DMC_DAYLENGTH, DMC_TROPICS, day_length, wet_bulb
from ..functions.geodesy import FEEDS, earth_radius, feed, geodetic, next_pass, nice_step
from ..functions.indices import METHODS, index
from ..operators.assess import haze_run, newest
from ..operators.checks import resolved
from ..operators.quantiles import quantiles
from ..operators.stats import trend
from ..operators.summaries import annual_heat, auto_cell_km, bands_by_count, best_and_worst, by_fractions, captions, cumulative_months, daily_stack, decayed_frames, display_frame, equal_bins, hour_completeness, newest_files, priced, record_years, strongest, worst_days
from ..sources.adapters import adapter, adapter_sql
from .registry import query, r6
from .zonal import JOINED, zoned_points

OBS, SCENE, POINT, ZONE, PAIRS = (adapter_sql(x) for x in ("obs", "scene", "point", "zone", "pair_obs"))


# --- haze


_DAILY = "dd AS (SELECT day, avg(value) AS pm FROM point GROUP BY day)"


@query(f"WITH {POINT}, {_DAILY} SELECT count(*) AS days, round(avg(pm), 6) AS mean, round(max(pm), 6) AS most, arg_max(day, (pm, day)) AS worst_day, arg_max(pm, day) IS NOT NULL AS has_latest, round(arg_max(pm, day), 6) AS latest, " + ", ".join(f"count(CASE WHEN {w} THEN 1 END) AS class_{k}" for k, w in enumerate(("pm <= 15.5", "pm > 15.5 AND pm <= 55.4", "pm > 55.4 AND pm <= 150.4", "pm > 150.4 AND pm <= 250.4", "pm > 250.4"))) + ", count(CASE WHEN pm > 15 THEN 1 END) AS above_who FROM dd")
def su3_haze_run(spark, d, who=15.0):
    daily = adapter(spark, d, "point").groupBy("day").agg(F.avg("value").alias("pm"))
    h = haze_run(daily, "day", "pm", who=who)
    return h.withColumns({x: r6(F.col(x)) for x in ("mean", "most", "latest")})


@query(f"WITH {SCENE} SELECT collection, max(day) AS newest, max(day) - 1 AS default_end, date_diff('day', max(day), date '1998-08-20') > 21 AS stale FROM scene GROUP BY collection")
def su5_newest(spark, d):
    """Newest date by collection, the day before it as a default end, and whether it is more than 21 days old."""
    return newest(adapter(spark, d, "scene"), ["collection"], "day", "1998-08-20")


@query("SELECT unnest(range(greatest(1993, year(min(o_orderdate))), year(max(o_orderdate)) + 1))::bigint AS y FROM orders")
def su6_record_years(spark, d):
    """Years of a record from 1993 on, clamped to what the archive holds."""
    return record_years(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate", 1993)


@query(f"WITH {POINT} SELECT event_id, lon, lat FROM point WHERE conf >= 60 QUALIFY row_number() OVER (PARTITION BY sat ORDER BY value DESC, event_id) <= 5")
def su16_forward_seeds(spark, d):
    """The five strongest detections of each satellite, where forward runs start."""
    return strongest(adapter(spark, d, "point").where("conf >= 60"), ["sat"], "value", "event_id").select("event_id", "lon", "lat")


@query(f"WITH {POINT}, {ZONE}, {JOINED}, w AS (SELECT zone_id, day, avg(value) AS pm FROM j WHERE zone_id IS NOT NULL GROUP BY zone_id, day), b AS (SELECT zone_id, max(pm) AS pm, arg_max(day, (pm, day)) AS day FROM w GROUP BY zone_id) SELECT zone_id, round(pm, 6) AS pm, day FROM b ORDER BY pm DESC, zone_id LIMIT 3")
def su16_backward_seeds(spark, d):
    """The three worst receptors with their worst days, where backward runs start."""
    w = zoned_points(spark, d).where("zone_id IS NOT NULL").groupBy("zone_id", "day").agg(F.avg("value").alias("pm"))
    return worst_days(w, "zone_id", "day", "pm").select("zone_id", r6(F.col("pm")).alias("pm"), "day")


@query("WITH h AS (SELECT ts::date AS day, count(DISTINCT hour(ts)) AS hours, count(*) AS n FROM events GROUP BY 1) SELECT day, n, hours, hours = 24 AS complete FROM h")
def su15_hour_completeness(spark, d):
    return hour_completeness(spark.read.parquet(f"{d}/events.parquet"), "ts")


@query("WITH s AS (SELECT event_type AS source, max(ts) AS newest FROM events GROUP BY 1), h AS (SELECT event_type AS source, ts::date AS day, count(DISTINCT hour(ts)) AS hours FROM events GROUP BY 1, 2) SELECT s.source AS source, date_diff('hour', newest, (SELECT max(ts) FROM events)) AS lag_hours, max(CASE WHEN hours >= 20 THEN day END) AS complete_to FROM s JOIN h ON s.source = h.source GROUP BY s.source, newest")
def st5_source_lag(spark, d):
    """By source: hours behind the newest of all, and its newest day that is complete."""
    e = spark.read.parquet(f"{d}/events.parquet")
    days = e.groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("day")).agg(F.count_distinct(F.hour("ts")).alias("hours"), F.max("ts").alias("newest"))
    s = days.groupBy("source").agg(F.max("newest").alias("newest"), F.max(F.when(F.col("hours") >= 20, F.col("day"))).alias("complete_to"))
    hour = lambda x: F.floor(F.unix_timestamp(x.cast("timestamp")) / 3600)
    all_ = F.max("newest").over(Window.partitionBy(F.lit(0)))
    return s.select("source", (hour(all_) - hour(F.col("newest"))).alias("lag_hours"), "complete_to")


_CAP = "nm AS (SELECT n_regionkey AS k, n_name AS name, sum(length(n_name) + 2) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 2 AS until, n_nationkey AS o FROM nation)"


@query(f"WITH {_CAP} SELECT k, string_agg(name, ', ' ORDER BY o) AS caption, count(*) AS n FROM nm WHERE until <= 30 GROUP BY k")
def su14_captions(spark, d):
    """Names joined as long as whole ones fit into the budget of a caption."""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("o"))
    return captions(n, "k", "name", "o", 30)


# --- briefs


_BRIEF = "ar AS (SELECT n_name AS zone, sum(c_acctbal) AS area, avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0 END) AS dry FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), sh AS (SELECT *, 100 * area / sum(area) OVER () AS pct FROM ar)"


@query(f"WITH {_BRIEF}, m AS (SELECT * FROM sh WHERE pct >= 1) SELECT count(*) AS zones, arg_max(zone, (dry, zone)) AS driest, printf('%s is driest (%.1f %% of its area) among %d zones', arg_max(zone, (dry, zone)), round(100 * max(dry), 1), count(*)) AS claim FROM m")
def or2_brief_claims(spark, d):
    """A sentence from numbers; zones with under 1 percent of the area aren't in it."""
    c, n = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation"))
    a = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("zone")).agg(F.sum("c_acctbal").alias("area"), F.avg(F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0)).alias("dry"))
    m = a.withColumn("pct", 100 * F.col("area") / F.sum("area").over(Window.partitionBy(F.lit(0)))).where("pct >= 1")
    best = F.max_by("zone", F.struct("dry", "zone"))
    return m.agg(F.count("*").alias("zones"), best.alias("driest"), F.format_string("%s is driest (%.1f %% of its area) among %d zones", best, F.round(100 * F.max("dry"), 1), F.count("*")).alias("claim"))


@query("SELECT o_orderpriority AS zone, CASE WHEN min(CASE WHEN o_totalprice > 300000 THEN o_orderdate END) IS NULL THEN 'never' WHEN min(CASE WHEN o_totalprice > 300000 THEN o_orderdate END)::date <= (SELECT min(o_orderdate)::date FROM orders) THEN 'on or before the first day' ELSE 'on ' || min(CASE WHEN o_totalprice > 300000 THEN o_orderdate END)::date END AS crossed FROM orders GROUP BY 1")
def or2_censored_crossings(spark, d):
    """A crossing on the first day of a record is only known to be no later."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    first = o.agg(F.to_date(F.min("o_orderdate")).alias("first"))  # one row
    z = o.groupBy(F.col("o_orderpriority").alias("zone")).agg(F.to_date(F.min(F.when(F.col("o_totalprice") > 300000, F.col("o_orderdate")))).alias("day"))
    text = F.when(F.col("day").isNull(), "never").when(F.col("day") <= F.col("first"), "on or before the first day").otherwise(F.concat(F.lit("on "), F.col("day").cast("string")))
    return z.crossJoin(F.broadcast(first)).select("zone", text.alias("crossed"))


@query(f"WITH {SCENE}, s AS (SELECT rel_orbit, count(CASE WHEN day <= date '1995-03-01' THEN 1 END) AS nb, max(CASE WHEN day <= date '1995-03-01' THEN day END) AS before, min(CASE WHEN day > date '1995-03-01' THEN day END) AS after FROM scene WHERE cloud_pct < 2 AND day <= date '1995-03-20' GROUP BY rel_orbit) SELECT rel_orbit, before, after, CASE WHEN before IS NULL THEN 'no scene before the event' WHEN after IS NULL THEN 'no scene after the event yet' WHEN date_diff('day', before, after) > 24 THEN 'span of ' || date_diff('day', before, after) || ' days' WHEN nb < 2 THEN 'no second scene before the event' END AS reason FROM s")
def or4_refusals(spark, d):
    """By track: the scenes around an event (that of its day counts as before), and why a pair is refused: too long a span, or no second
    earlier scene, which coherence needs."""
    event = F.lit("1995-03-01").cast("date")
    early = F.col("day") <= event
    s = adapter(spark, d, "scene").where("cloud_pct < 2 AND day <= date'1995-03-20'")
    t = s.groupBy("rel_orbit").agg(F.count(F.when(early, 1)).alias("nb"), F.max(F.when(early, F.col("day"))).alias("before"), F.min(F.when(~early, F.col("day"))).alias("after"))
    span = F.datediff("after", "before")
    reason = F.when(F.col("before").isNull(), "no scene before the event").when(F.col("after").isNull(), "no scene after the event yet")
    reason = reason.when(span > 24, F.concat(F.lit("span of "), span.cast("string"), F.lit(" days"))).when(F.col("nb") < 2, "no second scene before the event")
    return t.select("rel_orbit", "before", "after", reason.alias("reason"))


@query("SELECT o_orderpriority AS k, coalesce(price, 10) * count(*) AS cost FROM orders LEFT JOIN (VALUES ('1-URGENT', 15), ('2-HIGH', 12)) p(name, price) ON o_orderpriority = name GROUP BY o_orderpriority, price")
def su18_costs(spark, d):
    """Prices by name from a short table, a constant for those it lacks."""
    return priced(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("k")), "k", {"1-URGENT": 15, "2-HIGH": 12}, 10)


@query(f"WITH {ZONE} SELECT zone_id, round(least(greatest((e - w) * 111.32::double * cos(radians((s + n) / 2)) / 380, 1), 25), 6) AS cell_km FROM zone")
def su19_cell_size(spark, d):
    return adapter(spark, d, "zone").select("zone_id", r6(auto_cell_km(*map(F.col, "wsen"))).alias("cell_km"))


@query("SELECT n_regionkey AS region, count(*) AS n, round(sum(c_acctbal), 4) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT NULL, count(*), round(sum(c_acctbal), 4) FROM customer JOIN nation ON c_nationkey = n_nationkey")
def su20_roll_up(spark, d):
    """Sums by region and, without one, of the whole."""
    c, n = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation"))
    return c.join(n, c.c_nationkey == n.n_nationkey).rollup(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 4).alias("total"))


@query("WITH b AS (SELECT p_partkey AS k, list_transform(range(1, CASE WHEN p_size % 3 = 0 THEN 9 ELSE 5 END), lambda i: 'b' || i) AS bands FROM part) SELECT k, bands[CASE WHEN len(bands) >= 8 THEN 6 ELSE 3 END] AS red, bands[CASE WHEN len(bands) >= 8 THEN 8 ELSE 4 END] AS nir FROM b")
def su23_bands_by_count(spark, d):
    """Red and near infrared by the number of bands: sensors with eight have them elsewhere than those with four."""
    n = F.when(F.col("p_size") % 3 == 0, 8).otherwise(4)
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("b"), i.cast("string"))).alias("bands"))
    red, nir = bands_by_count(F.col("bands"))
    return p.select("k", red.alias("red"), nir.alias("nir"))


_HORN = ", ".join(f"max(CASE WHEN b.r - a.r = {i} AND b.c - a.c = {j} THEN b.v END) AS {n}" for n, i, j in (("nw", 1, -1), ("n", 1, 0), ("ne", 1, 1), ("w", 0, -1), ("e", 0, 1), ("sw", -1, -1), ("s", -1, 0), ("se", -1, 1)))


@query(f"WITH {OBS}, k AS (SELECT r, c, avg(tir) * 100 AS v FROM obs GROUP BY r, c), w AS (SELECT a.r AS r, a.c AS c, {_HORN} FROM k a JOIN k b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c), g AS (SELECT r, c, (ne + 2 * e + se - nw - 2 * w - sw) / 240 AS gx, (nw + 2 * n + ne - sw - 2 * s - se) / 240 AS gy FROM w) SELECT r, c, round(greatest((sin(radians(45)) - gx * cos(radians(45)) * sin(radians(315)) - gy * cos(radians(45)) * cos(radians(315))) / sqrt(1 + gx * gx + gy * gy), 0), 6) AS shade FROM g WHERE gx IS NOT NULL AND gy IS NOT NULL")
def su26_hillshade(spark, d):
    """Light on a slope by Horn's gradients, from the north-west at 45 degrees; cells without all eight neighbours have none."""
    v = adapter(spark, d, "obs").groupBy("r", "c").agg((F.avg("tir") * 100).alias("v"))
    places = {"nw": (1, -1), "n": (1, 0), "ne": (1, 1), "w": (0, -1), "e": (0, 1), "sw": (-1, -1), "s": (-1, 0), "se": (-1, 1)}
    sent = v.select("r", "c", "v")
    joined = v.select("r", "c")
    for name, (i, j) in places.items():
        joined = joined.join(sent.select((F.col("r") - i).alias("r"), (F.col("c") - j).alias("c"), F.col("v").alias(name)), ["r", "c"])
    c = F.col
    gx = (c("ne") + 2 * c("e") + c("se") - c("nw") - 2 * c("w") - c("sw")) / 240
    gy = (c("nw") + 2 * c("n") + c("ne") - c("sw") - 2 * c("s") - c("se")) / 240
    rad = lambda x: F.radians(F.lit(float(x)))
    light = (F.sin(rad(45)) - gx * F.cos(rad(45)) * F.sin(rad(315)) - gy * F.cos(rad(45)) * F.cos(rad(315))) / F.sqrt(1 + gx * gx + gy * gy)
    return joined.select("r", "c", r6(F.greatest(light, F.lit(0.0))).alias("shade"))


@query(f"WITH {OBS}, k AS (SELECT r, c, avg(tir) * 60 AS v FROM obs GROUP BY r, c) SELECT greatest(1200, round(quantile_cont(v, 0.999) / 100) * 100)::double AS ceiling, least(greatest(floor(log2(360 * 1024 / (256 * 10.0::double))), 1), 14)::int AS zoom FROM k")
def su27_height_ceiling(spark, d):
    """Upper end of a height scale, and the tile zoom at which a span of 10 degrees has some 1,024 pixels."""
    k = adapter(spark, d, "obs").groupBy("r", "c").agg((F.avg("tir") * 60).alias("v"))
    zoom = F.least(F.greatest(F.floor(F.log2(F.lit(360 * 1024 / (256 * 10.0)))), F.lit(1)), F.lit(14)).cast("int")
    return quantiles(k, "v", {"top": 0.999}).select(F.greatest(F.lit(1200.0), F.round(F.col("top") / 100) * 100).alias("ceiling"), zoom.alias("zoom"))


@query("WITH m AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2) SELECT y, m, n, sum(n) OVER (PARTITION BY y ORDER BY m)::bigint AS so_far FROM m")
def su37_cumulative_months(spark, d):
    return cumulative_months(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate")


@query("WITH p AS (SELECT l_orderkey AS k, avg(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END) - avg(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END) AS gain FROM lineitem GROUP BY 1), q AS (SELECT k, gain, row_number() OVER (ORDER BY gain DESC, k) AS a, row_number() OVER (ORDER BY gain, k) AS b FROM p WHERE gain IS NOT NULL) SELECT CASE WHEN a <= 3 THEN 'best' ELSE 'worst' END AS side, k, round(gain, 6) AS gain FROM q WHERE a <= 3 OR b <= 3")
def su40_best_and_worst(spark, d):
    """The three pairs that a correction improved most and least, as two top-k's."""
    side = lambda odd: F.avg(F.when(F.col("l_linenumber") % 2 == odd, F.col("l_quantity")))
    p = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("k")).agg((side(1) - side(0)).alias("gain"))
    return best_and_worst(p, "k", "gain").withColumn("gain", r6(F.col("gain")))


@query(f"WITH {OBS}, m AS (SELECT r, c, year(day) AS y, month(day) AS m, avg(tir) AS t, max(tir) AS hot, avg(nir) * 100 AS h FROM obs GROUP BY 1, 2, 3, 4), yy AS (SELECT y, max(hot) AS hot, avg(t) AS t, avg(h) AS h FROM m GROUP BY y) SELECT y, round(t, 6) AS mean, round(hot, 6) AS hottest FROM yy")
def su9_annual_heat(spark, d):
    """Annual mean of monthly means, and the highest monthly maximum."""
    return annual_heat(adapter(spark, d, "obs"), ["r", "c"], "day", "tir").withColumns({k: r6(F.col(k)) for k in ("mean", "hottest")})


_STULL = "t * atan(0.151977::double * sqrt(h + 8.313659::double)) + atan(t + h) - atan(h - 1.676331::double) + 0.00391838::double * power(h, 1.5) * atan(0.023101::double * h) - 4.686035::double"


@query(f"WITH {OBS}, yy AS (SELECT year(day) AS y, max(tir) AS t, least(greatest(avg(nir) * 100, 1), 100) AS h FROM obs GROUP BY 1) SELECT y, round({_STULL}, 6) AS peak FROM yy")
def su9_peak_wet_bulb(spark, d):
    """The year's highest temperature with its mean humidity; not the highest of the days' own wet bulbs."""
    y = adapter(spark, d, "obs").groupBy(F.year("day").cast("long").alias("y")).agg(F.max("tir").alias("t"), (F.avg("nir") * 100).alias("h"))
    return y.select("y", r6(wet_bulb(F.col("t"), F.col("h"))).alias("peak"))


_WET2 = "wv AS (SELECT r, c, year(day) AS y, median(nir) AS nir, median(red) AS red, median(green) AS green, median(swir1) AS swir1 FROM obs WHERE (qa & 31) = 0 GROUP BY 1, 2, 3)"


@query(f"WITH {OBS}, {_WET2} SELECT y, count(*) AS cells, count(CASE WHEN green + swir1 <> 0 AND (green - swir1) / (green + swir1) >= 0 THEN 1 END) AS wet, round(avg(CASE WHEN NOT coalesce((green - swir1) / nullif(green + swir1, 0) >= 0, false) THEN (nir - red) / nullif(nir + red, 0) END), 6) AS ndvi FROM wv GROUP BY y")
def su8_dry_epochs(spark, d):
    """Vegetation by epoch, without the cells that are water in it."""
    o = adapter(spark, d, "obs").where(F.col("qa").bitwiseAND(31) == 0).groupBy("r", "c", F.year("day").cast("long").alias("y")).agg(*(F.median(b).alias(b) for b in ("nir", "red", "green", "swir1")))
    nd = lambda a, b: F.try_divide(F.col(a) - F.col(b), F.col(a) + F.col(b))
    wet = F.coalesce(nd("green", "swir1") >= 0, F.lit(False))
    return o.groupBy("y").agg(F.count("*").alias("cells"), F.count(F.when(wet, 1)).alias("wet"), r6(F.avg(F.when(~wet, nd("nir", "red")))).alias("ndvi"))


@query(f"WITH {POINT}, {ZONE}, {JOINED}, y AS (SELECT zone_id, week(day) AS w, avg(value) AS v FROM j WHERE zone_id IS NOT NULL GROUP BY 1, 2) SELECT zone_id, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN regr_slope(v, w) * 10 END, 6) AS per_decade, round(CASE WHEN count(*) >= 3 THEN arg_max(v, w) - arg_min(v, w) END, 6) AS change FROM y GROUP BY zone_id UNION ALL SELECT NULL, count(*), round(regr_slope(v, w) * 10, 6), round(arg_max(v, w) - arg_min(v, w), 6) FROM (SELECT week(day) AS w, avg(value) AS v FROM j WHERE zone_id IS NOT NULL GROUP BY 1)")
def su10_shared_series(spark, d):
    """Trends of each zone's own series and, without a zone, of the one that all share."""
    p = zoned_points(spark, d).where("zone_id IS NOT NULL").withColumn("w", F.weekofyear("day").cast("long"))
    own = trend(p.groupBy("zone_id", "w").agg(F.avg("value").alias("v")), ["zone_id"], "w", "v")
    shared = trend(p.groupBy("w").agg(F.avg("value").alias("v")).withColumn("zone_id", F.lit(None).cast("int")), ["zone_id"], "w", "v")
    return own.union(shared).select("zone_id", "n", r6(F.col("per_decade")).alias("per_decade"), r6(F.col("change")).alias("change"))


@query(f"WITH {POINT}, q AS (SELECT least(quantile_cont(lon, 0.02), 101) AS w, greatest(quantile_cont(lon, 0.98), 103) AS e, least(quantile_cont(lat, 0.02), -2) AS s, greatest(quantile_cont(lat, 0.98), 2) AS n FROM point), p AS (SELECT w - 0.1 * (e - w) AS w, e + 0.1 * (e - w) AS e, s - 0.1 * (n - s) AS s, n + 0.1 * (n - s) AS n FROM q), g AS (SELECT *, greatest((n - s) * 1.5 - (e - w), 0) / 2 AS gx, greatest((e - w) / 1.5 - (n - s), 0) / 2 AS gy FROM p) SELECT round(greatest(w - gx, -180), 6) AS w, round(greatest(s - gy, -90), 6) AS s, round(least(e + gx, 180), 6) AS e, round(least(n + gy, 90), 6) AS n FROM g")
def su13_display_frame(spark, d):
    """2nd to 98th percentile of path points with the area, 10 percent around it, the shorter side grown to 3:2, within the globe."""
    b = display_frame(adapter(spark, d, "point"), "lon", "lat", (101.0, -2.0, 103.0, 2.0))
    return b.select(*(r6(F.col(k)).alias(k) for k in "wsen"))


# --- series


_UNW = "p AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity >= 10 AS good FROM lineitem), g AS (SELECT *, sum((NOT good)::int) OVER (PARTITION BY k ORDER BY i) AS cut FROM p), q AS (SELECT k, cut, count(*) AS n FROM g WHERE good GROUP BY k, cut)"


@query(f"WITH {_UNW} SELECT k, max(n) AS longest FROM q GROUP BY k")
def rc7_longest_run(spark, d):
    """Longest run of usable places along each transect, between gaps."""
    p = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_quantity") >= 10).alias("good"))
    g = p.withColumn("cut", F.sum((~F.col("good")).cast("int")).over(Window.partitionBy("k").orderBy("i"))).where("good")
    return g.groupBy("k", "cut").agg(F.count("*").alias("n")).groupBy("k").agg(F.max("n").alias("longest"))


@query(f"WITH {SCENE}, t AS (SELECT rel_orbit, row_number() OVER (PARTITION BY rel_orbit ORDER BY day, scene_id) AS k, day FROM scene WHERE cloud_pct < 20), p AS (SELECT rel_orbit, k, CASE WHEN lead(day) OVER w - day <= 12 THEN 1 ELSE 0 END AS short FROM t WINDOW w AS (PARTITION BY rel_orbit ORDER BY k)), s AS (SELECT rel_orbit, k AS first, sum(short) OVER (PARTITION BY rel_orbit ORDER BY k ROWS BETWEEN CURRENT ROW AND 18 FOLLOWING)::bigint AS covered FROM p) SELECT rel_orbit, arg_max(first, (covered, -first)) AS first, max(covered) AS covered FROM s GROUP BY rel_orbit")
def wn6_covered_pairs(spark, d):
    """The 20 consecutive scenes of each track that hold most pairs of at most 12 days."""
    w = Window.partitionBy("rel_orbit").orderBy("day", "scene_id")
    t = adapter(spark, d, "scene").where("cloud_pct < 20").select("rel_orbit", F.row_number().over(w).cast("long").alias("first"), F.when(F.datediff(F.lead("day").over(w), "day") <= 12, 1).otherwise(0).alias("short"))
    s = t.withColumn("covered", F.sum("short").over(Window.partitionBy("rel_orbit").orderBy("first").rowsBetween(0, 18)))
    return s.groupBy("rel_orbit").agg(F.max_by("first", F.struct("covered", -F.col("first"))).alias("first"), F.max("covered").alias("covered"))


@query("WITH f AS (SELECT ts, unnest(generate_series(time_bucket(interval 6 hours, ts) + interval 6 hours, time_bucket(interval 6 hours, ts) + interval 12 hours, interval 6 hours)) AS frame FROM events) SELECT frame, count(*) AS n, round(sum(1 - (epoch(frame) - floor(epoch(ts))) / 43200), 6) AS weight FROM f WHERE ts > frame - interval 12 hours GROUP BY frame")
def wn7_decayed_frames(spark, d):
    """Frames of the trailing 12 hours in which an event counts the less the older it is."""
    f = decayed_frames(spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts")), "ts")
    return f.select(F.col("frame").cast("timestamp_ntz").alias("frame"), "n", r6(F.col("weight")).alias("weight"))


@query(f"WITH {OBS}, k AS (SELECT r, c, avg(nir) AS v FROM obs GROUP BY r, c), e AS (SELECT quantile_cont(v, 0.2) AS a, quantile_cont(v, 0.4) AS b, quantile_cont(v, 0.6) AS c, quantile_cont(v, 0.8) AS d FROM k) SELECT ((v > e.a)::int + (v > e.b)::int + (v > e.c)::int + (v > e.d)::int)::int AS bin, count(*) AS n, round(min(v), 6) AS low, round(max(v), 6) AS high FROM k, e GROUP BY 1")
def wn9_equal_bins(spark, d):
    """Five classes of equal count, by their edges."""
    k = adapter(spark, d, "obs").groupBy("r", "c").agg(F.avg("nir").alias("v"))
    return equal_bins(k, "v").select("bin", "n", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


@query("SELECT user_id AS k, " + ", ".join(f"round(avg(CASE WHEN ts::date = date '2024-01-0{k}' THEN value END), 6) AS day_{k}" for k in range(1, 8)) + " FROM events GROUP BY user_id")
def tc8_daily_stack(spark, d):
    """One column for each day of a week, for output; everything else stays long."""
    e = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("k"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    s = daily_stack(e, "k", "day", "v", [f"2024-01-0{n}" for n in range(1, 8)])
    return s.select("k", *(r6(F.col(x)).alias(x) for x in s.columns[1:]))


@query("SELECT user_id AS k, ts::date AS day, round(avg(value), 6) AS mean, count(*) AS steps FROM events GROUP BY 1, 2")
def tc11_day_means(spark, d):
    """Means of the steps of a day's forecasts."""
    return spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("k"), F.to_date("ts").alias("day")).agg(r6(F.avg("value")).alias("mean"), F.count("*").alias("steps"))


@query(f"WITH {PAIRS}, t AS (SELECT cell, regr_slope(phase, years) AS rate, regr_r2(phase, years) AS r2, count(*) AS n FROM pair_obs GROUP BY cell) SELECT cell, round(rate, 6) AS rate, n, round(CASE WHEN n > 2 AND r2 < 1 THEN rate / sqrt((1 - r2) / r2 / (n - 2)) / abs(rate) END, 6) AS t FROM t WHERE abs(rate) <= 30 AND n >= 3 AND rate <> 0")
def ag26_transects(spark, d):
    """Rate of each transect with its t value; rates beyond 30 and transects with under three points are dropped."""
    t = adapter(spark, d, "pair_obs").groupBy("cell").agg(F.regr_slope("phase", "years").alias("rate"), F.regr_r2("phase", "years").alias("r2"), F.count("*").alias("n"))
    t = t.where("abs(rate) <= 30 AND n >= 3 AND rate <> 0")
    value = F.when(F.col("r2") < 1, F.col("rate") / F.sqrt((1 - F.col("r2")) / F.col("r2") / (F.col("n") - 2)) / F.abs("rate"))
    return t.select("cell", r6(F.col("rate")).alias("rate"), "n", r6(value).alias("t"))


@query("SELECT c_nationkey AS k, year, round(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) / greatest(count(*), 1e-6) * any_value(total), 6) AS young, round(sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END) / greatest(count(*), 1e-6) * any_value(total), 6) AS old FROM customer JOIN (SELECT s_nationkey, 2024 AS year, sum(s_acctbal) AS total FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey GROUP BY 1, 2")
def su1_people_by_age(spark, d):
    """A year's total by the age fractions of another one: the young and the old."""
    people = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("k"), "c_mktsegment")
    total = spark.read.parquet(f"{d}/supplier.parquet").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("total"))
    out = by_fractions(total, people, "k", "total", "c_mktsegment", {"young": "BUILDING", "old": "MACHINERY"})
    return out.select("k", F.lit(2024).alias("year"), r6(F.col("young")).alias("young"), r6(F.col("old")).alias("old"))


# --- scalars


_METHOD_ROWS = ", ".join(f"('{n}', '{w}', {a}::double, {b}::double, {v}::double)" for n, (w, a, b, v) in METHODS.items())
_SIDE = "side AS (SELECT r, c, year(day) >= 1996 AS late, " + ", ".join(f"avg({b}) AS {b}" for b in ("green", "red", "nir", "swir1", "swir2")) + " FROM obs GROUP BY 1, 2, 3)"
_INDEX = "idx AS (SELECT *, (swir1 - nir) / (swir1 + nir) - (nir - red) / (nir + red) AS bu, ((nir - red) * 1.5 / (nir + red + 0.5) + (green - swir1) / (green + swir1)) / 2 AS built, (swir1 - nir) / (swir1 + nir) AS ndbi FROM side)"
_EACH = {"NDVI": "(nir - red) / (nir + red)", "NDBI": "ndbi", "UI": "(swir2 - nir) / (swir2 + nir)", "BU": "bu", "IBI": "least(greatest((ndbi - built) / (ndbi + built), -1), 1)", "NDWI": "(green - nir) / (green + nir)", "NBR": "(nir - swir2) / (nir + swir2)"}
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{k}' AS name, r, c, max(CASE WHEN late THEN {x} END) - max(CASE WHEN NOT late THEN {x} END) AS delta FROM idx GROUP BY r, c" for k, x in _EACH.items()) + ")"


@query(f"WITH {OBS}, {_SIDE}, {_INDEX}, {_LONG}, t AS (SELECT name, direction, CASE WHEN name = 'NBR' THEN -0.02::double ELSE affected / 10 END AS affected, severe / 10 AS severe, shown FROM (VALUES {_METHOD_ROWS}) t(name, direction, affected, severe, shown)) SELECT t.name AS name, any_value(direction) AS direction, round(any_value(affected), 6) AS affected, round(any_value(severe), 6) AS severe, count(CASE WHEN CASE WHEN direction = 'loss' THEN delta < affected ELSE delta > affected END THEN 1 END) AS cells_affected, count(CASE WHEN CASE WHEN direction = 'loss' THEN delta < severe ELSE delta > severe END THEN 1 END) AS cells_severe FROM t JOIN long ON long.name = t.name GROUP BY t.name")
def fn7_method_table(spark, d):
    """Cells that each change method calls affected and severe, by its own direction and thresholds: a tenth of the defaults, which suits means of years, and one of them overridden."""
    rows = [(n, w, -0.02 if n == "NBR" else a / 10, s / 10) for n, (w, a, s, _) in METHODS.items()]
    t = spark.createDataFrame(rows, "name string, direction string, affected double, severe double")
    side = adapter(spark, d, "obs").groupBy("r", "c", (F.year("day") >= 1996).alias("late")).agg(*(F.avg(b).alias(b) for b in ("green", "red", "nir", "swir1", "swir2")))
    each = side.select("r", "c", "late", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), index(n).alias("v")) for n in METHODS))).alias("m"))
    delta = each.groupBy(F.col("m.name").alias("name"), "r", "c").agg((F.max(F.when(F.col("late"), F.col("m.v"))) - F.max(F.when(~F.col("late"), F.col("m.v")))).alias("delta"))
    past = lambda bound: F.count(F.when(F.when(F.col("direction") == "loss", F.col("delta") < F.col(bound)).otherwise(F.col("delta") > F.col(bound)), 1))
    return delta.join(F.broadcast(t), "name").groupBy("name", "direction", r6(F.col("affected")).alias("affected"), r6(F.col("severe")).alias("severe")).agg(past("affected").alias("cells_affected"), past("severe").alias("cells_severe"))


_DMC, _DC = ("[" + ", ".join(f"{float(x)}::double" for x in t) + "]" for t in (DMC_DAYLENGTH, DC_DAYLENGTH))


@query(f"WITH {POINT}, l AS (SELECT event_id, lat * 4 AS lat, month(day + (event_id % 360)::int) AS m FROM point) SELECT event_id, CASE WHEN abs(lat) < 15 THEN {float(DMC_TROPICS)}::double ELSE ({_DMC})[m] END AS dmc, CASE WHEN abs(lat) < 15 THEN {float(DC_TROPICS)}::double ELSE ({_DC})[m] END AS dc FROM l")
def fn14_day_lengths(spark, d):
    """Day-length factors of places and days: constant near the equator, by table elsewhere."""
    p = adapter(spark, d, "point").select("event_id", (F.col("lat") * 4).alias("lat"), F.date_add("day", (F.col("event_id") % 360).cast("int")).alias("on"))
    return p.select("event_id", *(day_length(F.col("lat"), F.col("on"), k).cast("double").alias(k) for k in ("dmc", "dc")))


@query("WITH s AS (SELECT p_partkey AS k, p_retailprice AS v FROM part), q AS (SELECT k, v, v / 5 AS raw, power(10, floor(log10(v / 5))) AS p FROM s) SELECT k, CASE WHEN raw / p <= 1 THEN p WHEN raw / p <= 2 THEN 2 * p WHEN raw / p <= 5 THEN 5 * p ELSE 10 * p END AS step, format('{:,}', (floor(v) * 1000)::bigint) AS shown FROM q")
def fn25_nice_numbers(spark, d):
    """Steps of scale bars, and numbers with thousands set apart."""
    v = F.col("p_retailprice")
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), nice_step(v, 5).alias("step"), F.format_number(F.floor(v) * 1000, 0).alias("shown"))


_A, _B = 6378137.0, 6378137.0 * (1 - 1 / 298.257223563)
_E2, _EP2 = 1 - (_B / _A) ** 2, (_A / _B) ** 2 - 1


@query(f"WITH {POINT}, x AS (SELECT event_id, 6378137.0::double * cos(radians(lat)) * cos(radians(lon)) AS x, 6378137.0::double * cos(radians(lat)) * sin(radians(lon)) AS y, 6378137.0::double * sin(radians(lat)) AS z FROM point), t AS (SELECT *, sqrt(x * x + y * y) AS p, atan2(z * {_A!r}::double, sqrt(x * x + y * y) * {_B!r}::double) AS th FROM x) SELECT event_id, round(degrees(atan2(y, x)), 6) AS lon, round(degrees(atan2(z + {_EP2!r}::double * {_B!r}::double * power(sin(th), 3), p - {_E2!r}::double * {_A!r}::double * power(cos(th), 3))), 6) AS lat FROM t")
def fn29_geodetic(spark, d):
    """Geodetic places of points given in earth-centred metres."""
    lon, lat = F.radians("lon"), F.radians("lat")
    r = F.lit(6378137.0)
    x = adapter(spark, d, "point").select("event_id", (r * F.cos(lat) * F.cos(lon)).alias("x"), (r * F.cos(lat) * F.sin(lon)).alias("y"), (r * F.sin(lat)).alias("z"))
    lon, lat, _ = geodetic(F.col("x"), F.col("y"), F.col("z"))
    return x.select("event_id", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query(f"WITH {POINT}, l AS (SELECT event_id, lat * 9 AS lat FROM point) SELECT event_id, round(sqrt((power({_A!r}::double * {_A!r}::double * cos(radians(lat)), 2) + power({_B!r}::double * {_B!r}::double * sin(radians(lat)), 2)) / (power({_A!r}::double * cos(radians(lat)), 2) + power({_B!r}::double * sin(radians(lat)), 2))), 3) AS metres FROM l")
def fn29_earth_radius(spark, d):
    """Distance from the earth's centre at each place, its latitude stretched to reach the poles."""
    return adapter(spark, d, "point").select("event_id", F.round(earth_radius(F.col("lat") * 9), 3).alias("metres"))


_FEEDS = "CASE " + " ".join(f"WHEN lon BETWEEN {w} AND {e} AND lat BETWEEN {s} AND {n} THEN '{k}'" for k, w, s, e, n in FEEDS) + " END"


@query(f"WITH {POINT}, q AS (SELECT lon * 30 - 3150 AS lon, lat * 6 AS lat FROM point) SELECT {_FEEDS} AS feed, count(*) AS n FROM q GROUP BY 1")
def fn32_feed_by_place(spark, d):
    """The continental feed that serves a place: the first box that holds it."""
    p = adapter(spark, d, "point").select((F.col("lon") * 30 - 3150).alias("lon"), (F.col("lat") * 6).alias("lat"))
    return p.groupBy(feed(F.col("lon"), F.col("lat")).alias("feed")).agg(F.count("*").alias("n"))


@query(f"WITH {SCENE}, t AS (SELECT rel_orbit, max(day) AS newest FROM scene GROUP BY rel_orbit) SELECT rel_orbit, newest, newest + CASE WHEN newest > date '2001-07-30' THEN 0 ELSE (floor(date_diff('day', newest, date '2001-07-30') / 12)::int + 1) * 12 END AS next FROM t")
def fn33_next_pass(spark, d):
    """By track: the first pass after today, in repeats of 12 days."""
    t = adapter(spark, d, "scene").groupBy("rel_orbit").agg(F.max("day").alias("newest"))
    return t.select("rel_orbit", "newest", next_pass(F.col("newest"), F.lit("2001-07-30").cast("date"), 12).alias("next"))


# --- areas and sources


@query("WITH z AS (SELECT n_name AS second, r_name AS first FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT first, second, 2 AS level FROM z WHERE lower(second) = (SELECT lower(min(n_name)) FROM nation) AND (SELECT lower(min(n_name)) FROM nation) NOT IN (SELECT lower(first) FROM z)")
def pr10_resolved_area(spark, d):
    """A name is looked up at the first level, then at the second."""
    n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    z = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("first"), F.col("n_name").alias("second"))
    wanted = n.agg(F.concat(F.lit(" "), F.lower(F.min("n_name")), F.lit(" ")).alias("wanted"))  # one row
    return resolved(z.crossJoin(F.broadcast(wanted)), F.col("wanted"), "first", "second").select("first", "second", "level")


@query("SELECT CASE p_size % 10 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' END AS class, count(*) AS n FROM part WHERE p_size % 10 <= 2 GROUP BY 1")
def sc17_major_roads(spark, d):
    """Ways of three classes out of all."""
    k = F.col("p_size") % 10
    name = F.when(k == 0, "motorway").when(k == 1, "trunk").when(k == 2, "primary")
    return spark.read.parquet(f"{d}/part.parquet").select(name.alias("class")).where("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'bus_stop' END AS highway, CASE WHEN p_size % 7 = 0 THEN 'platform' END AS public_transport, CASE WHEN p_size % 11 = 0 THEN 'halt' END AS railway FROM part) SELECT id, concat_ws('+', CASE WHEN highway = 'bus_stop' THEN 'highway' END, CASE WHEN public_transport IN ('platform', 'stop_position') THEN 'public_transport' END, CASE WHEN railway IN ('station', 'halt', 'tram_stop') THEN 'railway' END) AS tags FROM t WHERE highway = 'bus_stop' OR public_transport IN ('platform', 'stop_position') OR railway IN ('station', 'halt', 'tram_stop')")
def sc16_stops_by_tags(spark, d):
    """Stops are what any of three tags marks; each is one, however many tags it has."""
    p = spark.read.parquet(f"{d}/part.parquet")
    when = lambda n, v: F.when(F.col("p_size") % n == 0, v)
    t = p.select(F.col("p_partkey").alias("id"), when(5, "bus_stop").alias("highway"), when(7, "platform").alias("public_transport"), when(11, "halt").alias("railway"))
    marks = {"highway": ("bus_stop",), "public_transport": ("platform", "stop_position"), "railway": ("station", "halt", "tram_stop")}
    tags = F.concat_ws("+", *(F.when(F.col(k).isin(*v), k) for k, v in marks.items()))
    return t.select("id", tags.alias("tags")).where("tags <> ''")


@query("SELECT o_orderkey AS k, o_orderdate::date AS day, (SELECT last_day(max(o_orderdate))::date FROM orders) AS covered FROM orders WHERE o_orderdate::date = (SELECT max(o_orderdate)::date FROM orders)")
def sc20_newest_covered(spark, d):
    """The files of the newest week, and the day up to which an archive by months is covered."""
    return newest_files(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day")), "day")


@query("WITH f AS (SELECT 'LED-ALOS' || (o_orderkey // 4) || '-' || strftime(o_orderdate, '%y%m%d') || '-' || CASE o_orderkey % 2 WHEN 0 THEN 'HH' ELSE 'HV' END AS name FROM orders) SELECT regexp_extract(name, 'ALOS(\\d+)-', 1)::bigint AS scene, max(regexp_extract(name, '-(\\d{6})-', 1)) AS day, count(DISTINCT regexp_extract(name, '-([HV]{2})$', 1)) AS pols, min(regexp_extract(name, '-([HV]{2})$', 1)) AS first_pol FROM f GROUP BY 1")
def sc23_scene_index(spark, d):
    """Scenes, days and polarisations from file names."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("LED-ALOS"), F.floor(k / 4).cast("string"), F.lit("-"), F.date_format("o_orderdate", "yyMMdd"), F.lit("-"), F.when(k % 2 == 0, "HH").otherwise("HV"))
    f = spark.read.parquet(f"{d}/orders.parquet").select(name.alias("name"))
    part = lambda p: F.regexp_extract("name", p, 1)
    return f.groupBy(part(r"ALOS(\d+)-").cast("long").alias("scene")).agg(F.max(part(r"-(\d{6})-")).alias("day"), F.count_distinct(part("-([HV]{2})$")).alias("pols"), F.min(part("-([HV]{2})$")).alias("first_pol"))


@query("WITH j AS (SELECT p_partkey AS k, p_size AS len, p_size / 2.0 AS width, (p_partkey % 360)::double AS strike, (p_partkey % 90)::double AS dip, p_retailprice / 1000 AS slip FROM part) SELECT k, round(width * cos(radians(dip)), 6) AS across, round(width * sin(radians(dip)), 6) AS down, round(3e10 * len * width * 1e6 * slip / 1e18, 9) AS moment FROM j")
def sc26_subfaults(spark, d):
    """Geometry and moment of subfaults read from features' properties."""
    p = spark.read.parquet(f"{d}/part.parquet")
    props = F.to_json(F.struct(F.col("p_partkey").alias("k"), F.col("p_size").alias("length"), (F.col("p_size") / 2.0).alias("width"), (F.col("p_partkey") % 90).alias("dip"), (F.col("p_retailprice") / 1000).alias("slip")))
    j = p.select(F.from_json(props, "k long, length double, width double, dip double, slip double").alias("j")).select("j.*")
    dip = F.radians("dip")
    moment = F.lit(3e10) * F.col("length") * F.col("width") * 1e6 * F.col("slip") / 1e18
    return j.select("k", r6(F.col("width") * F.cos(dip)).alias("across"), r6(F.col("width") * F.sin(dip)).alias("down"), F.round(moment, 9).alias("moment"))


@query("SELECT o_orderkey AS k, o_orderdate + interval 1 hour * (o_custkey % 24) - interval 1 millisecond * ((o_custkey % 9000 + 1000) * 250) AS start FROM orders")
def su44_start_times(spark, d):
    """Start of a scene from the time of its middle: half its lines earlier, at a quarter of a second each here."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    centre = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_custkey") % 24) * 3_600_000_000)
    start = F.timestamp_micros(F.unix_micros(centre) - (F.col("o_custkey") % 9000 + 1000) * 250_000)
    return o.select(F.col("o_orderkey").alias("k"), start.cast("timestamp_ntz").alias("start"))
