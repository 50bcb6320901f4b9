"""Queries: sampling, series, motion, names and plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.calendar import month_start, same_window, week_of_month
from ..functions.geo import cell_area_ha, line_of_sight, mercator_y, terrarium_m, tile_xy, up_east
from ..functions.indices import celsius_landsat, harmonised_s2, reflectance_landsat
from ..functions.masks import in_months, zero_is_nodata
from ..operators.assess import coherence_drop, disturbance, flood, heat_island, nearest_centroids, since
from ..operators.change import change_summary, optical_change
from ..operators.grid import slope_degrees
from ..operators.joins import nearest_epoch, rank_pairs
from ..operators.stats import confusion_metrics
from ..operators.zonal import rescaled_index
from ..sources.adapters import adapter, adapter_sql
from ..sources.files import weather_weeks
from .dynamics import COUNTS, counts
from .orchestration import duplicates, matched_pairs, pair_name, pair_plan, register, run_scenario, track_choice
from .registry import query, r6
from .spectral import CLEAR, clear, nd
from .zonal import JOINED, PAIRS, zoned_points

OBS, SCENE, POINT, ZONE = (adapter_sql(x) for x in ("obs", "scene", "point", "zone"))


@query("SELECT l_orderkey AS k, l_linenumber AS i, round((l_partkey * 0.0000275::double) - 0.2::double, 6) AS reflectance, round(l_partkey * 0.00341802::double + 149 - 273.15::double, 6) AS celsius FROM lineitem")
def pr4_landsat_scaling(spark, d):
    li, dn = spark.read.parquet(f"{d}/lineitem.parquet"), F.col("l_partkey").cast("double")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), r6(reflectance_landsat(dn)).alias("reflectance"), r6(celsius_landsat(dn)).alias("celsius"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderdate >= timestamp '1996-01-25' THEN greatest(o_custkey - 1000, 0) ELSE o_custkey END AS dn FROM orders")
def sc6_harmonised(spark, d):
    """The rule's date is 26 years later than these orders, so they are moved on by as many."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    late = F.col("o_orderdate") + F.make_interval(years=F.lit(26))
    return o.select(F.col("o_orderkey").alias("k"), harmonised_s2(F.col("o_custkey"), late).alias("dn"))


@query(f"WITH {POINT} SELECT event_id, round(0.01 * 111.320 * cos(radians(lat)) * 0.01 * 110.574 * 100, 6) AS ha, round(ln(tan(radians(lat) / 2 + pi() / 4)), 6) AS y, floor((lon + 180) / 360 * 256)::int AS tx, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 256)::int AS ty FROM point")
def fn20_cells_and_tiles(spark, d):
    p, lat = adapter(spark, d, "point"), F.col("lat")
    tx, ty = tile_xy(F.col("lon"), lat, 8)
    return p.select("event_id", r6(cell_area_ha(lat, 0.01, 0.01)).alias("ha"), r6(mercator_y(lat)).alias("y"), tx.alias("tx"), ty.alias("ty"))


@query("SELECT l_orderkey AS k, l_linenumber AS i, (l_linenumber * 256 + l_partkey % 256) + (l_suppkey % 256) / 256::double - 32768 AS metres FROM lineitem")
def sc11_terrarium(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), terrarium_m(F.col("l_linenumber"), F.col("l_partkey") % 256, (F.col("l_suppkey") % 256).cast("double")).alias("metres"))


@query(f"WITH {SCENE} SELECT scene_id, date_trunc('month', day - interval 3 month)::date AS start, least(((day::timestamp_s::date - interval 24 month))::date, (day - interval 24 month)::date) AS earlier, least(floor((day(day) - 1) / 7) + 1, 5)::int AS week FROM scene")
def fn24_calendar(spark, d):
    s, day = adapter(spark, d, "scene"), F.col("day")
    earlier, _ = same_window(day, day, F.year(day) - 2)
    return s.select("scene_id", month_start(day, -3).alias("start"), earlier.alias("earlier"), week_of_month(day).alias("week"))


@query(f"WITH {SCENE} SELECT scene_id, substr(sha1(least(scene_id::varchar, (scene_id + 1)::varchar) || '|' || greatest(scene_id::varchar, (scene_id + 1)::varchar)), 1, 8) AS name FROM scene")
def fn26_pair_names(spark, d):
    return adapter(spark, d, "scene").select("scene_id", pair_name(F.col("scene_id") + 1, F.col("scene_id")).alias("name"))


@query(f"WITH {OBS} SELECT r, c, round(-(avg(nir) * cos(radians(39)) - sin(radians(39)) * (avg(red) * cos(radians(-12)) - avg(green) * sin(radians(-12)))), 6) AS away, round((avg(red) * 0.6::double - avg(nir) * -0.55::double) / (0.8::double * 0.6::double - -0.55::double * 0.75::double), 6) AS up, round((avg(nir) * 0.8::double - avg(red) * 0.75::double) / (0.8::double * 0.6::double - -0.55::double * 0.75::double), 6) AS east FROM obs GROUP BY r, c")
def fn27_line_of_sight(spark, d):
    a = adapter(spark, d, "obs").groupBy("r", "c").agg(*(F.avg(b).alias(b) for b in ("red", "green", "nir")))
    up, east = up_east(F.col("red"), F.col("nir"), (0.8, -0.55), (0.75, 0.6))
    away = line_of_sight(F.col("red"), F.col("green"), F.col("nir"), -12.0, 39.0)
    return a.select("r", "c", r6(away).alias("away"), r6(up).alias("up"), r6(east).alias("east"))


@query(f"WITH {OBS}, {CLEAR} SELECT r, c, count(CASE WHEN month(day) BETWEEN 6 AND 9 THEN tir END) AS n, round(avg(CASE WHEN month(day) BETWEEN 6 AND 9 THEN tir END), 6) AS lst FROM clear GROUP BY r, c")
def pr13_dry_season(spark, d):
    season = F.when(in_months(F.col("day"), 6, 9), F.col("tir"))
    return clear(spark, d).groupBy("r", "c").agg(F.count(season).alias("n"), r6(F.avg(season)).alias("lst"))


@query(f"WITH {PAIRS} SELECT cell, count(CASE WHEN coh <> 0 THEN coh END) AS n, round(avg(CASE WHEN coh <> 0 THEN coh END), 6) AS coh, count(*) AS n_all FROM pair_obs GROUP BY cell")
def pr9_zero_is_nodata(spark, d):
    coh = zero_is_nodata(F.col("coh"))
    return adapter(spark, d, "pair_obs").groupBy("cell").agg(F.count(coh).alias("n"), r6(F.avg(coh)).alias("coh"), F.count("*").alias("n_all"))


# --- change and classes

_FLOOD = f"s AS (SELECT r, c, 10 * log10(avg(CASE WHEN vv > 0 AND day < date '1995-06-01' THEN vv END)) AS pre, 10 * log10(avg(CASE WHEN vv > 0 AND day >= date '1995-06-01' THEN vv END)) AS post FROM obs GROUP BY r, c), m AS (SELECT r, c, r * 100 + c AS id FROM s WHERE post < -13 AND NOT pre < -13)"


@query(f"WITH RECURSIVE {OBS}, {_FLOOD}, lab AS (SELECT id, id AS to_id FROM m UNION SELECT l.id, b.id FROM lab l JOIN m a ON a.id = l.to_id JOIN m b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND b.id <> a.id), root AS (SELECT id, min(to_id) AS root FROM lab GROUP BY id), s2 AS (SELECT root, count(*) AS size FROM root GROUP BY root HAVING count(*) >= 3) SELECT m.r AS r, m.c AS c FROM m JOIN root ON m.id = root.id JOIN s2 ON s2.root = root.root")
def ch6_flood(spark, d, split="1995-06-01", threshold=-13.0, least=3):
    return flood(adapter(spark, d, "obs"), split, threshold=threshold, least=least)


@query(f"WITH {OBS}, {COUNTS}, g AS (SELECT r, c, (coalesce(lead(v) OVER x, v) - coalesce(lag(v) OVER x, v)) / (coalesce(lead(c) OVER x, c) - coalesce(lag(c) OVER x, c)) / 30 AS gx, (coalesce(lead(v) OVER y, v) - coalesce(lag(v) OVER y, v)) / (coalesce(lead(r) OVER y, r) - coalesce(lag(r) OVER y, r)) / 30 AS gy FROM v WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)), b AS (SELECT r, c, 10 * log10(avg(CASE WHEN vh > 0 AND year(day) >= 1996 THEN vh END)) - 10 * log10(avg(CASE WHEN vh > 0 AND year(day) < 1996 THEN vh END)) AS drop FROM obs GROUP BY r, c), k AS (SELECT CASE WHEN drop < -0.4::double THEN 2 WHEN drop < -0.2::double THEN 1 ELSE 0 END AS grade, degrees(atan(sqrt(gx * gx + gy * gy))) > 15 AS steep FROM b JOIN g ON b.r = g.r AND b.c = g.c) SELECT grade, steep, count(*) AS n FROM k GROUP BY grade, steep")
def ch7_disturbance(spark, d, first_year=1996, affected=-0.2, severe=-0.4, steep=15.0):
    k = disturbance(adapter(spark, d, "obs"), slope_degrees(counts(spark, d), "v", 30.0), F.year("day") >= first_year, affected=affected, severe=severe, steep=steep)
    return k.groupBy("grade", "steep").agg(F.count("*").alias("n"))


@query(f"WITH {OBS}, {CLEAR} SELECT round(avg(CASE WHEN r BETWEEN 8 AND 12 AND c BETWEEN 8 AND 12 THEN tir END), 6) AS urban, round(avg(CASE WHEN NOT (r BETWEEN 6 AND 14 AND c BETWEEN 6 AND 14) THEN tir END), 6) AS rural, round(avg(CASE WHEN r BETWEEN 8 AND 12 AND c BETWEEN 8 AND 12 THEN tir END) - avg(CASE WHEN NOT (r BETWEEN 6 AND 14 AND c BETWEEN 6 AND 14) THEN tir END), 6) AS suhii FROM clear")
def ch21_heat_island(spark, d):
    inside = lambda a, b: F.col("r").between(a, b) & F.col("c").between(a, b)
    h = heat_island(clear(spark, d), inside(8, 12), "tir", rural=~inside(6, 14))
    return h.select(*(r6(F.col(x)).alias(x) for x in ("urban", "rural", "suhii")))


@query(f"WITH {PAIRS}, a AS (SELECT cell, avg(CASE WHEN d1 < date '1995-06-01' THEN coh END) AS pre, avg(CASE WHEN d1 >= date '1995-06-01' THEN coh END) AS post FROM pair_obs GROUP BY cell) SELECT count(CASE WHEN pre >= 0.3 THEN 1 END) AS usable, count(CASE WHEN pre >= 0.3 AND pre - post >= 0.05 THEN 1 END) AS fell, round(100 * avg(CASE WHEN pre >= 0.3 THEN (pre - post >= 0.05)::int END), 6) AS pct, round(quantile_cont(pre - post, 0.05), 6) AS p05, round(quantile_cont(pre - post, 0.95), 6) AS p95 FROM a")
def ch25_coherence_drop(spark, d, split="1995-06-01", usable=0.3, drop=0.05):
    c = coherence_drop(adapter(spark, d, "pair_obs"), ["cell"], since("d1", split), "coh", usable, drop)
    return c.select("usable", "fell", *(r6(F.col(x)).alias(x) for x in ("pct", "p05", "p95")))


@query("WITH e AS (SELECT vec_id, label, unnest(embedding)::double AS v, unnest(range(64)) AS i FROM embeddings), c AS (SELECT label AS k, i, avg(v) AS m FROM e WHERE vec_id % 10 < 7 GROUP BY label, i), d AS (SELECT vec_id, e.label AS label, k, sum((v - m) * (v - m)) AS dist FROM e JOIN c ON e.i = c.i WHERE vec_id % 10 >= 7 GROUP BY vec_id, e.label, k), b AS (SELECT vec_id, any_value(label) AS label, arg_min(k, (round(dist, 9), k)) AS guess FROM d GROUP BY vec_id) SELECT label, guess, count(*) AS n FROM b GROUP BY label, guess")
def ch30_nearest_centroid(spark, d):
    """Confusion of a nearest-centroid classifier, fitted on rows whose vec_id ends in 0 to 6."""
    best = nearest_centroids(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", "label", F.col("vec_id") % 10 < 7)
    return best.groupBy("label", "guess").agg(F.count("*").alias("n"))


def split_part(number):
    return F.when((number * 7919 + 42) % 100 < 70, "train").otherwise("test")


@query(None)
def ch29_random_forest(spark, d):
    """Confusion of a random forest of 100 trees on the test part of the split; rows only, as the trees have no twin in SQL."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    e = spark.read.parquet(f"{d}/embeddings.parquet").select(split_part(F.col("vec_id")).alias("part"), F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    train, test = (e.where(F.col("part") == p) for p in ("train", "test"))
    model = RandomForestClassifier(numTrees=100, seed=42).fit(train)
    return model.transform(test).groupBy("label", "prediction").agg(F.count("*").alias("n"))


_PARTS = "SELECT CASE WHEN (vec_id * 7919 + 42) % 100 < 70 THEN 'train' ELSE 'test' END AS part, label, count(*) AS n FROM embeddings GROUP BY 1, 2"


@query(_PARTS)
def ch29_split(spark, d):
    """The 70/30 split of samples by a rule on their ids, the same on every run and cluster."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.groupBy(split_part(F.col("vec_id")).alias("part"), "label").agg(F.count("*").alias("n"))


@query("WITH k AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, CASE WHEN l_linestatus = 'O' THEN 1 WHEN l_linenumber % 2 = 0 THEN 0 ELSE 2 END AS prediction FROM lineitem), c AS (SELECT label, prediction, count(*) AS n FROM k GROUP BY 1, 2), r AS (SELECT label AS class, sum(n) AS row, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS hit FROM c GROUP BY 1), q AS (SELECT prediction AS class, sum(n) AS col FROM c GROUP BY 1), w AS (SELECT r.class AS class, row, col, hit FROM r JOIN q USING (class)), t AS (SELECT sum(row) AS n, sum(hit) AS ok, sum(row * col::double) AS chance FROM w) SELECT class::int AS class, round(hit / row, 6) AS producer, round(hit / col, 6) AS consumer, round(ok / n, 6) AS accuracy, round((ok / n - chance / (n * n)) / (1 - chance / (n * n)), 6) AS kappa FROM w, t")
def ch29_accuracy(spark, d):
    """Accuracies and kappa of a confusion table."""
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    prediction = F.when(F.col("l_linestatus") == "O", 1).when(F.col("l_linenumber") % 2 == 0, 0).otherwise(2)
    c = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(label.alias("label"), prediction.alias("prediction")).agg(F.count("*").alias("n"))
    m = confusion_metrics(c, "label", "prediction", "n")
    return m.select("class", *(r6(F.col(k)).alias(k) for k in ("producer", "consumer", "accuracy", "kappa")))


# --- series


@query(f"WITH {POINT}, y AS (SELECT week(day) AS year, count(*) AS n FROM point GROUP BY 1) SELECT year, n, round(n / avg(n) OVER (), 6) AS ratio, rank() OVER (ORDER BY n DESC) AS rank FROM y")
def ag11_record_rank(spark, d):
    """Weeks stand for years; windows over one row a week."""
    y = adapter(spark, d, "point").groupBy(F.weekofyear("day").cast("long").alias("year")).agg(F.count("*").alias("n"))
    return y.select("year", "n", r6(F.col("n") / F.avg("n").over(Window.partitionBy(F.lit(0)))).alias("ratio"), F.rank().over(Window.orderBy(F.desc("n"))).cast("long").alias("rank"))


@query(f"WITH {SCENE}, g AS (SELECT rel_orbit, day, date_diff('day', lag(day) OVER (PARTITION BY rel_orbit ORDER BY day, scene_id), day) AS gap FROM scene), n AS (SELECT rel_orbit, gap, count(*) AS n, max(day) AS newest FROM g GROUP BY rel_orbit, gap) SELECT rel_orbit, arg_max(gap, (n, -gap)) AS repeat, max(newest) AS newest FROM n WHERE gap IS NOT NULL GROUP BY rel_orbit")
def su33_repeat_interval(spark, d):
    """The commonest gap between passes, the shortest among equals."""
    w = Window.partitionBy("rel_orbit").orderBy("day", "scene_id")
    g = adapter(spark, d, "scene").select("rel_orbit", "day", F.datediff("day", F.lag("day").over(w)).cast("long").alias("gap"))
    n = g.where("gap IS NOT NULL").groupBy("rel_orbit", "gap").agg(F.count("*").alias("n"), F.max("day").alias("newest"))
    return n.groupBy("rel_orbit").agg(F.max_by("gap", F.struct("n", -F.col("gap"))).alias("repeat"), F.max("newest").alias("newest"))


@query(f"WITH {OBS}, v AS (SELECT r, c, avg(tir) AS v FROM obs GROUP BY r, c), f AS (SELECT DISTINCT r, c FROM obs), g AS (SELECT f.r AS r, f.c AS c, floor(f.r * 10 / 20)::int AS sr, floor(f.c * 10 / 20)::int AS sc FROM f) SELECT g.r AS r, g.c AS c, round(v, 6) AS v FROM g JOIN v ON v.r = g.sr AND v.c = g.sc")
def rs2_match_grid(spark, d):
    obs = adapter(spark, d, "obs")
    v = obs.groupBy("r", "c").agg(r6(F.avg("tir")).alias("v")).select(F.col("r").alias("sr"), F.col("c").alias("sc"), "v")
    g = obs.select("r", "c").distinct().withColumns({"sr": rescaled_index(F.col("r"), 10, 20), "sc": rescaled_index(F.col("c"), 10, 20)})
    return g.join(v, ["sr", "sc"]).select("r", "c", "v")


@query("WITH e AS (SELECT DISTINCT year(o_orderdate) AS epoch FROM orders) SELECT epoch FROM e ORDER BY abs(epoch - 2000), epoch LIMIT 1")
def ja2_nearest_epoch(spark, d):
    return nearest_epoch(spark.read.parquet(f"{d}/orders.parquet").select(F.year("o_orderdate").cast("long").alias("epoch")).distinct(), "epoch", 2000)


@query(f"WITH {POINT}, {ZONE}, {JOINED} SELECT DISTINCT zone_id FROM j WHERE conf >= 95 EXCEPT SELECT DISTINCT zone_id FROM j WHERE day = date '2024-01-10' AND conf >= 60")
def set_difference(spark, d):
    p = zoned_points(spark, d)
    return p.where("conf >= 95").select("zone_id").distinct().subtract(p.where("day = date'2024-01-10' AND conf >= 60").select("zone_id"))


# --- plans


@query(f"WITH {SCENE}, t AS (SELECT rel_orbit, scene_id, day, row_number() OVER (PARTITION BY rel_orbit ORDER BY day, scene_id) AS rn FROM scene WHERE cloud_pct < 5), p AS (SELECT a.scene_id AS s1, a.day AS d1, b.scene_id AS s2, b.day AS d2 FROM t a JOIN t b ON a.rel_orbit = b.rel_orbit AND b.rn BETWEEN a.rn + 1 AND a.rn + 3 WHERE date_diff('day', a.day, b.day) <= 30) SELECT count(*) AS pairs, count(CASE WHEN s1 % 2 = 0 AND s2 % 2 = 0 THEN 1 END) AS already, min(d1) AS first, max(d2) AS last, count(*) * 10 AS price, (count(*) - count(CASE WHEN s1 % 2 = 0 AND s2 % 2 = 0 THEN 1 END)) * 10 AS due FROM p")
def or3_pair_plan(spark, d):
    s = adapter(spark, d, "scene").where("cloud_pct < 5")
    there = rank_pairs(s, ["rel_orbit"], "day", "scene_id", 3, 30).where("scene_1 % 2 = 0 AND scene_2 % 2 = 0")
    return pair_plan(s, ["rel_orbit"], 3, 30, there, 10)


@query(f"WITH {SCENE}, t AS (SELECT rel_orbit, max(CASE WHEN day <= date '1995-03-01' THEN day END) AS before, min(CASE WHEN day > date '1995-03-01' THEN day END) AS after, max(day) AS newest FROM scene WHERE day <= date '1995-03-04' GROUP BY rel_orbit) SELECT rel_orbit, before, after, (newest + (floor(date_diff('day', newest, date '1995-03-04') / 12)::int + 1) * 12)::date AS next_pass, CASE WHEN before IS NULL THEN 'no scene before the event' WHEN after IS NULL THEN 'no scene after the event yet' END AS reason FROM t")
def or4_track_choice(spark, d):
    return track_choice(adapter(spark, d, "scene"), "rel_orbit", "1995-03-01", "1995-03-04")


@query(f"WITH {SCENE}, p AS (SELECT rel_orbit, scene_id, day, lead(scene_id) OVER w AS scene_2, lead(day) OVER w AS day_2 FROM scene WINDOW w AS (PARTITION BY rel_orbit ORDER BY day, scene_id)) SELECT *, CASE WHEN date_diff('day', day, day_2) <> 1 THEN 'gap of ' || date_diff('day', day, day_2) || ' days' END AS reason FROM p WHERE scene_2 IS NOT NULL")
def su34_matched_pairs(spark, d):
    return matched_pairs(adapter(spark, d, "scene"), ["rel_orbit"], 1)


@query("SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def or6_duplicates(spark, d):
    return duplicates(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("part")), "part")


@query("WITH r AS (SELECT o_orderkey AS k, o_orderdate AS s, o_orderdate + interval 1 hour * (24 * (1 + o_custkey % 5)) AS e FROM orders), d AS (SELECT k, unnest(generate_series(s::date, e::date, interval 1 day))::date AS day FROM r) SELECT DISTINCT k, year(day)::int AS year, month(day)::int AS month, least(floor((day(day) - 1) / 7) + 1, 5)::int AS week FROM d")
def sc19_weather_weeks(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("start"), (24 * (1 + F.col("o_custkey") % 5)).cast("int").alias("hours"), F.lit(False).alias("back"))
    return weather_weeks(o, "start", "hours", "back").select("k", "year", "month", "week")


for _name, _method in {"deforestation": "NDVI", "urbanization": "NDBI", "burn": "NBR", "water": "NDWI"}.items():

    @register(_name, needs=("sf_dir", "split"), method=_method)
    def _change(spark, sf_dir, split, method):
        return change_summary(optical_change(clear(spark, sf_dir), split, method))


_BURN = "s AS (SELECT r, c, " + ", ".join(f"median(CASE WHEN day {'>=' if k else '<'} date '1996-01-01' THEN {b} END) AS {b}_{k}" for k in (0, 1) for b in ("nir", "swir2", "green", "swir1")) + ", count(CASE WHEN day < date '1996-01-01' THEN red END) AS n_0, count(CASE WHEN day >= date '1996-01-01' THEN red END) AS n_1 FROM clear GROUP BY r, c)"


@query(f"WITH {OBS}, {CLEAR}, {_BURN}, k AS (SELECT *, n_0 >= 2 AND n_1 >= 2 AND NOT coalesce(({nd('green_0', 'swir1_0')}) >= 0 AND ({nd('green_1', 'swir1_1')}) >= 0, false) AS kept FROM s), d AS (SELECT CASE WHEN kept THEN ({nd('nir_1', 'swir2_1')}) - ({nd('nir_0', 'swir2_0')}) END AS delta FROM k) SELECT count(delta) AS n_valid, round(avg(delta), 6) AS mean_delta, round(100 * avg((delta < -0.10::double)::int), 6) AS pct_affected, round(100 * avg((delta < -0.27::double)::int), 6) AS pct_severe FROM d")
def or1_scenario_burn(spark, d):
    s = run_scenario("burn", spark, sf_dir=d, split="1996-01-01")
    return s.select("n_valid", *(r6(F.col(x)).alias(x) for x in ("mean_delta", "pct_affected", "pct_severe")))
