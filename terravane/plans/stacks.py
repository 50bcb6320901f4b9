"""Queries: scenes, pairs and stacks of radar data, and classifications."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.indices import decibels
from ..operators.assess import area_reducers, box_anomaly, close_up, greenness, greenness_change, heat_island, imagery_state, percent_of_normal, rain_by_year, share_of_total, urban_growth
from ..operators.change import optical_change, orbit_choice
from ..operators.composite import period_composite
from ..operators.overlay import sampled
from ..operators.stacks import DRAWS, bootstrap, elevation_fit, exceedance, file_state, local_resultant, mask_polarity, picks, poisson_bounds, reference_spread, stats_lines, trusted_range, usable_scenes, without_band
from ..operators.summaries import patch_cm, sign_check
from ..sources.adapters import adapter, adapter_sql
from .grids import COARSE, FINE
from .motion import _PHASE, phase
from .registry import query, r6
from .spectral import CLEAR, clear, nd

OBS, SCENE, POINT, PAIRS = (adapter_sql(x) for x in ("obs", "scene", "point", "pair_obs"))


@query(f"WITH {SCENE} SELECT scene_id, day FROM scene WHERE coalesce(CASE WHEN rel_orbit = 3 THEN NULL ELSE cloud_pct % 4 <> 1 END, true) AND day >= date '1997-01-01'")
def sc7_usable_scenes(spark, d):
    """Scenes that a pair can be made of: those marked otherwise are dropped, those without a mark stay."""
    s = adapter(spark, d, "scene").where("day >= date'1997-01-01'")
    return usable_scenes(s, F.when(F.col("rel_orbit") != 3, F.col("cloud_pct") % 4 != 1)).select("scene_id", "day")


_TEXT = "t AS (SELECT CASE WHEN l_linenumber = 7 THEN '# ' ELSE '' END || l_orderkey || '  ' || l_partkey || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE ' x y ' || l_quantity END AS line FROM lineitem), f AS (SELECT regexp_split_to_array(trim(line), '\\s+') AS f FROM t WHERE NOT starts_with(trim(line), '#'))"


@query(f"WITH {_TEXT} SELECT f[1] AS first, count(*) AS n, round(sum(try_cast(f[5] AS double)), 6) AS value FROM f WHERE len(f) >= 5 GROUP BY f[1]")
def sc27_stats_lines(spark, d):
    line = F.concat(F.when(F.col("l_linenumber") == 7, "# ").otherwise(""), F.col("l_orderkey").cast("string"), F.lit("  "), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit(" x y "), F.col("l_quantity").cast("string"))))
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(line.alias("line"))
    return stats_lines(t, "line").groupBy("first").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("value"))


@query(f"WITH {PAIRS}, v AS (SELECT CASE WHEN coh >= 0.3 THEN phase END AS v FROM pair_obs) SELECT count(*) AS cells, count(v) AS trusted, round(min(v), 6) AS least, round(max(v), 6) AS most, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.95), 6) AS p95 FROM v")
def ch26_trusted_range(spark, d):
    t = trusted_range(adapter(spark, d, "pair_obs"), "phase", "coh")
    return t.select("cells", "trusted", *(r6(F.col(x)).alias(x) for x in ("least", "most", "p05", "p95")))


@query(f"WITH {PAIRS}, b AS (SELECT unnest([0.2, 0.4, 0.6, 0.8])::double AS bound) SELECT bound, count(CASE WHEN coh >= bound THEN 1 END) AS cells, round(100 * count(CASE WHEN coh >= bound THEN 1 END) / count(*), 6) AS pct FROM pair_obs, b GROUP BY bound")
def ag33_coherence_table(spark, d):
    return exceedance(adapter(spark, d, "pair_obs"), "coh", (0.2, 0.4, 0.6, 0.8)).withColumn("pct", r6(F.col("pct")))


@query(f"WITH {PAIRS} SELECT round(avg(CASE WHEN phase > 0 THEN coh END), 6) AS inside, round(avg(CASE WHEN NOT phase > 0 THEN coh END), 6) AS outside, avg(CASE WHEN phase > 0 THEN coh END) > avg(CASE WHEN NOT phase > 0 THEN coh END) AS keeps FROM pair_obs")
def ag33_mask_polarity(spark, d):
    m = mask_polarity(adapter(spark, d, "pair_obs"), "coh", F.col("phase") > 0)
    return m.select(r6(F.col("inside")).alias("inside"), r6(F.col("outside")).alias("outside"), "keeps")


_FILES = "files AS (SELECT o_custkey AS product, o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '_unw_phase.tif' WHEN 1 THEN '_corr.tif' WHEN 2 THEN '_dem.tif' ELSE '_browse.png' END AS name, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey * 10 END AS size FROM orders)"


def files(spark, d):
    k = F.col("o_orderkey")
    suffix = F.when(k % 4 == 0, "_unw_phase.tif").when(k % 4 == 1, "_corr.tif").when(k % 4 == 2, "_dem.tif").otherwise("_browse.png")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("product"), F.concat(k.cast("string"), suffix).alias("name"), F.when(k % 11 == 0, 0).otherwise(k * 10).alias("size"))


@query(f"WITH {_FILES}, s AS (SELECT product, max(CASE WHEN ends_with(name, '_unw_phase.tif') THEN size END) AS u, max(CASE WHEN ends_with(name, '_corr.tif') THEN size END) AS k, sum(CASE WHEN ends_with(name, '_unw_phase.tif') OR ends_with(name, '_corr.tif') THEN 0 ELSE size END)::bigint AS prunable, sum(size)::bigint AS bytes FROM files GROUP BY product) SELECT product, (u IS NULL)::int + (k IS NULL)::int AS missing, coalesce(u = 0, false)::int + coalesce(k = 0, false)::int AS damaged, CASE WHEN coalesce(u = 0, false) OR coalesce(k = 0, false) THEN 'damaged' WHEN u IS NULL OR k IS NULL THEN 'pending' ELSE 'complete' END AS state, prunable, bytes FROM s")
def or7_stack_state(spark, d):
    """Damage is told from what hasn't come yet; pruning keeps the suffixes that a time series needs."""
    needed = ("_unw_phase.tif", "_corr.tif")
    return file_state(files(spark, d), "product", "name", "size", needed, needed)


@query(f"WITH {_FILES} SELECT DISTINCT product FROM files WHERE product NOT IN (SELECT product FROM files WHERE ends_with(name, '_dem.tif'))")
def su41_without_band(spark, d):
    f = files(spark, d)
    return without_band(f, f, "product", "name", "_dem.tif")


@query(f"WITH {SCENE}, p AS (SELECT rel_orbit, scene_id, day, CASE WHEN day > date '1995-03-01' THEN 'after' ELSE 'before' END AS side FROM scene), n AS (SELECT *, row_number() OVER (PARTITION BY rel_orbit, side ORDER BY abs(date_diff('day', date '1995-03-01', day)), scene_id) AS place FROM p) SELECT rel_orbit, side, place::int AS place, scene_id, day FROM n WHERE place <= CASE side WHEN 'after' THEN 1 ELSE 2 END")
def su35_scene_picks(spark, d):
    """Two scenes at or before an event and one after it, by track."""
    return picks(adapter(spark, d, "scene"), ["rel_orbit"], F.lit("1995-03-01").cast("date")).select("rel_orbit", "side", "place", "scene_id", "day")


@query(f"WITH {SCENE} SELECT rel_orbit, orbit, count(*) AS n, min(day) AS first, max(day) AS last, sum(scene_id * rank)::bigint AS ordered FROM (SELECT *, row_number() OVER (PARTITION BY rel_orbit, orbit ORDER BY day, scene_id) AS rank FROM scene) GROUP BY rel_orbit, orbit")
def su17_tracks(spark, d):
    """Scenes grouped by track, each with its place in time; `ordered` tells their order in one number."""
    at = F.row_number().over(Window.partitionBy("rel_orbit", "orbit").orderBy("day", "scene_id"))
    s = adapter(spark, d, "scene").withColumn("rank", at)
    return s.groupBy("rel_orbit", "orbit").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"), F.sum(F.col("scene_id") * F.col("rank")).alias("ordered"))


_TIMES = " + ".join(f"(u >= {b})::int" for b in poisson_bounds())
_BOOT = f"bl AS (SELECT cell, avg(sin(phase)) AS s, avg(cos(phase)) AS c FROM pair_obs GROUP BY cell), dr AS (SELECT s, c, k, (cell::bigint * 7919 + k * 104729 + 31) % {DRAWS} AS x FROM bl, (SELECT unnest(range(200)) AS k)), cu AS (SELECT s, c, k, (x * x % {DRAWS}) * x % {DRAWS} AS u FROM dr), wt AS (SELECT k, s, c, {_TIMES} AS n FROM cu), rp AS (SELECT k, sqrt(power(sum(n * s), 2) + power(sum(n * c), 2)) / sum(n) AS length FROM wt GROUP BY k)"


@query(f"WITH {PAIRS}, {_BOOT} SELECT round(quantile_cont(length, 0.025), 6) AS low, round(quantile_cont(length, 0.975), 6) AS high, count(*) AS draws FROM rp")
def ag22_block_bootstrap(spark, d):
    """Interval of the resultant's length over 200 draws of cells."""
    b = bootstrap(adapter(spark, d, "pair_obs"), "cell", "phase", 200)
    return b.agg(r6(F.percentile("length", 0.025)).alias("low"), r6(F.percentile("length", 0.975)).alias("high"), F.count("*").alias("draws"))


@query(f"WITH {OBS}, k AS (SELECT r, c, avg(tir) AS h, avg(nir) AS v FROM obs GROUP BY r, c), e AS (SELECT quantile_cont(h, 0.25) AS a, quantile_cont(h, 0.5) AS b, quantile_cont(h, 0.75) AS c FROM k), q AS (SELECT h, v, (h > e.a)::int + (h > e.b)::int + (h > e.c)::int AS bin FROM k, e), m AS (SELECT bin, median(v) AS m FROM q GROUP BY bin) SELECT round(regr_r2(v, h), 6) AS line_r2, round(1 - avg((v - m) * (v - m)) / var_pop(v), 6) AS bins_r2, count(*) AS n FROM q JOIN m USING (bin)")
def ag18_elevation_fit(spark, d):
    k = adapter(spark, d, "obs").groupBy("r", "c").agg(F.avg("tir").alias("h"), F.avg("nir").alias("v"))
    return elevation_fit(k, "h", "v", 4).select(r6(F.col("line_r2")).alias("line_r2"), r6(F.col("bins_r2")).alias("bins_r2"), "n")


@query(f"WITH {OBS}, k AS (SELECT r, c, avg(nir) AS v FROM obs GROUP BY r, c), p AS (SELECT * FROM (VALUES (0, 3, 3), (1, 15, 4), (2, 5, 16)) t(reference, pr, pc)), h AS (SELECT median(v) AS here FROM k WHERE sqrt(power(r - 10, 2) + power(c - 10, 2)) <= 3) SELECT reference, round(median(v), 6) AS median, round(any_value(here) - median(v), 6) AS against FROM k, p, h WHERE sqrt(power(r - pr, 2) + power(c - pc, 2)) <= 3 GROUP BY reference")
def su32_reference_spread(spark, d):
    k = adapter(spark, d, "obs").groupBy("r", "c").agg(F.avg("nir").alias("v"))
    s = reference_spread(k, ((3, 3), (15, 4), (5, 16)), 3, "v", (10, 10))
    return s.select("reference", r6(F.col("median")).alias("median"), r6(F.col("against")).alias("against"))


@query(f"WITH {_PHASE}, s AS (SELECT unnest([3, 5, 9])::int AS size), b AS (SELECT size, r // size AS br, c // size AS bc, sqrt(power(avg(sin(phase)), 2) + power(avg(cos(phase)), 2)) AS l, count(*) AS n FROM ph, s GROUP BY 1, 2, 3) SELECT size, count(*) AS blocks, round(avg(l), 6) AS length FROM b WHERE n * 2 > size * size GROUP BY size")
def su29_local_resultant(spark, d):
    return local_resultant(phase(spark, d), "phase", (3, 5, 9)).withColumn("length", r6(F.col("length")))


@query(f"WITH {OBS}, k AS (SELECT r, c, avg(nir) AS a, avg(swir1) AS b FROM obs GROUP BY r, c) SELECT round(regr_slope(b, a), 6) AS slope, round(corr(a, b), 6) AS r, regr_slope(b, a) > 0 AS same_sign FROM k")
def su30_sign_check(spark, d):
    """Whether two bands follow one sign convention: the sign of the line through them."""
    k = sign_check(adapter(spark, d, "obs").groupBy("r", "c").agg(F.avg("nir").alias("a"), F.avg("swir1").alias("b")), "a", "b")
    return k.select(r6(F.col("slope")).alias("slope"), r6(F.col("r")).alias("r"), "same_sign")


@query(f"WITH {_PHASE}, p AS (SELECT * FROM ph WHERE r BETWEEN 4 AND 12 AND c BETWEEN 6 AND 14), m AS (SELECT median(phase) AS m FROM p) SELECT r, c, round((phase - m) * (5.6::double / (4 * pi())), 6) AS cm FROM p, m")
def su38_patch_cm(spark, d):
    """A patch of phase without its median, in centimetres for a wavelength of 5.6 cm."""
    box = F.col("r").between(4, 12) & F.col("c").between(6, 14)
    return patch_cm(phase(spark, d), box, "phase").withColumn("cm", r6(F.col("cm")))


@query(f"WITH {OBS}, f AS (SELECT r AS sr, c AS sc, avg(tir) AS dem FROM obs GROUP BY r, c) SELECT r::int AS r, c::int AS c, round(dem, 6) AS dem FROM (SELECT unnest(range(0, 40)) AS r), (SELECT unnest(range(0, 20)) AS c), f WHERE sr = least(floor((-10 + (r + 0.5::double) * 0.5::double + 10) / 1.0), 19) AND sc = c")
def su43_conformed_dem(spark, d):
    """Heights on a product's grid, by the nearest cell."""
    dem = adapter(spark, d, "obs").groupBy("r", "c").agg(F.avg("tir").alias("dem"))
    return sampled(FINE.cells(spark), FINE, dem, COARSE, ["dem"], keep=False).withColumn("dem", r6(F.col("dem")))


_BURST = "b AS (SELECT l_orderkey AS burst, l_linenumber * 100 AS first, l_linenumber * 100 + 149 AS last FROM lineitem WHERE l_linenumber <= 3), g AS (SELECT (i * 30)::bigint AS line, -5 + i * 0.01::double AS lat, 100 + i * 0.02::double AS lon FROM (SELECT unnest(range(0, 20)) AS i))"


@query(f"WITH {_BURST} SELECT burst, first, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM b JOIN g ON line BETWEEN first AND last GROUP BY burst, first")
def su36_burst_spans(spark, d):
    """Extent of the geolocation lines within each burst. The grid of lines is one product's few rows."""
    b = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("burst"), (F.col("l_linenumber") * 100).alias("first"), (F.col("l_linenumber") * 100 + 149).alias("last"))
    g = spark.range(20).select((F.col("id") * 30).alias("line"), (F.lit(-5.0) + F.col("id") * 0.01).alias("lat"), (F.lit(100.0) + F.col("id") * 0.02).alias("lon"))
    met = b.join(F.broadcast(g), F.col("line").between(F.col("first"), F.col("last")))
    return met.groupBy("burst", "first").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))


# --- composites and change

_IMG = "k AS (SELECT r, c, count(CASE WHEN (qa & 31) = 0 THEN 1 END) AS clear, count(*) AS passes FROM obs WHERE day >= date '1995-03-01' AND day < date '1995-04-01' GROUP BY r, c), g AS (SELECT DISTINCT r, c FROM obs)"


@query(f"WITH {OBS}, {_IMG} SELECT CASE WHEN passes IS NULL THEN 'no pass' WHEN clear = 0 THEN 'all cloudy' ELSE 'clear' END AS state, count(*) AS cells, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM g LEFT JOIN k ON g.r = k.r AND g.c = k.c GROUP BY 1")
def ch3_imagery_state(spark, d, start="1995-03-01", end="1995-04-01"):
    """Cells of a composite without data are told apart: no scene passed, or all that did were cloudy."""
    n = imagery_state(adapter(spark, d, "obs"), start, end, F.col("qa").bitwiseAND(31) == 0)
    return n.withColumn("pct", r6(F.col("pct")))


@query(f"WITH {OBS} SELECT day, count(*) AS cells, round(100 * avg(((qa & 31) = 0)::int), 6) AS valid_pct FROM obs WHERE day >= date '1995-02-24' AND day < date '1995-03-06' GROUP BY day")
def ch3_nearby_dates(spark, d):
    o = adapter(spark, d, "obs").where("day >= date'1995-02-24' AND day < date'1995-03-06'")
    return o.groupBy("day").agg(F.count("*").alias("cells"), r6(100 * F.avg((F.col("qa").bitwiseAND(31) == 0).cast("int"))).alias("valid_pct"))


_MINE = "per AS (SELECT r, c, 10 * log10(avg(CASE WHEN year(day) <= 1994 THEN vh END)) AS a, 10 * log10(avg(CASE WHEN year(day) >= 1996 THEN vh END)) AS b FROM obs WHERE vh > 0 GROUP BY r, c)"
_MED = "s AS (SELECT r, c, " + ", ".join(f"median(CASE WHEN day {'>=' if k else '<'} date '1996-01-01' THEN {b} END) AS {b}_{k}" for k in (0, 1) for b in ("red", "nir", "green", "swir1")) + ", count(CASE WHEN day < date '1996-01-01' THEN red END) AS n_0, count(CASE WHEN day >= date '1996-01-01' THEN red END) AS n_1 FROM clear GROUP BY r, c)"
_NDVI = f"dv AS (SELECT r, c, CASE WHEN n_0 >= 2 AND n_1 >= 2 AND NOT coalesce(({nd('green_0', 'swir1_0')}) >= 0 AND ({nd('green_1', 'swir1_1')}) >= 0, false) THEN ({nd('nir_1', 'red_1')}) - ({nd('nir_0', 'red_0')}) END AS delta FROM s)"


@query(f"WITH {OBS}, {CLEAR}, {_MED}, {_NDVI}, {_MINE} SELECT dv.r AS r, dv.c AS c, round(delta, 6) AS delta, round(b - a, 6) AS radar, delta < -0.15 AND b - a < 0 AS both FROM dv JOIN per ON dv.r = per.r AND dv.c = per.c WHERE delta IS NOT NULL")
def ch4_mining(spark, d, split="1996-01-01", loss=-0.15):
    """Loss of vegetation side by side with the change of radar backscatter between periods."""
    o = adapter(spark, d, "obs").where("vh > 0")
    period = F.when(F.year("day") <= 1994, "a").when(F.year("day") >= 1996, "b")
    radar = period_composite(o, "vh", period, ["a", "b"]).select("r", "c", (decibels(F.col("b")) - decibels(F.col("a"))).alias("radar"))
    change = optical_change(clear(spark, d), split, "NDVI").where("delta IS NOT NULL").select("r", "c", "delta")
    both = (F.col("delta") < loss) & (F.col("radar") < 0)
    return change.join(radar, ["r", "c"]).select("r", "c", r6(F.col("delta")).alias("delta"), r6(F.col("radar")).alias("radar"), both.alias("both"))


_URB = f"u AS (SELECT r, c, {', '.join(f'avg(CASE WHEN {w} THEN {i} END) AS {n}{k}' for k, w in ((0, 'year(day) <= 1994'), (1, 'year(day) >= 1996')) for n, i in (('v', 'red'), ('b', 'swir1')))} FROM obs GROUP BY r, c)"


@query(f"WITH {OBS}, {_URB} SELECT count(CASE WHEN v0 > 0.25 AND v1 < 0.26 AND v1 - v0 < -0.01 THEN 1 END) AS lost, count(CASE WHEN b1 > 0.25 AND NOT b0 > 0.25 THEN 1 END) AS new_urban, round(count(CASE WHEN b0 > 0.25 THEN 1 END) * 0.0009::double, 6) AS km2_first, round(count(CASE WHEN b1 > 0.25 THEN 1 END) * 0.0009::double, 6) AS km2_last FROM u")
def ch13_urban_growth(spark, d, last_before=1994, first_after=1996, green_first=0.25, green_last=0.26, fall=-0.01, over=0.25):
    """Vegetation lost (green before, not after, by a clear drop), newly built cells, and built area by epoch, for cells of 30 m."""
    u = urban_growth(adapter(spark, d, "obs"), F.year("day") <= last_before, F.year("day") >= first_after, "red", "swir1", green_first=green_first, green_last=green_last, fall=fall, over=over)
    return u.select("lost", "new_urban", r6(F.col("km2_first")).alias("km2_first"), r6(F.col("km2_last")).alias("km2_last"))


@query(f"WITH {OBS}, y AS (SELECT r, c, year(day) AS y, sum(swir1) AS rain FROM obs GROUP BY 1, 2, 3) SELECT r, c, round(100 * max(CASE WHEN y = 1997 THEN rain END) / avg(CASE WHEN y < 1997 THEN rain END), 6) AS pct FROM y GROUP BY r, c")
def ch19_percent_of_normal(spark, d, year=1997):
    """A year's sum in each cell as a percentage of the mean of the years before."""
    return percent_of_normal(adapter(spark, d, "obs"), ["r", "c"], F.year("day"), "swir1", year).withColumn("pct", r6(F.col("pct")))


_RAINY = "ry AS (SELECT year(o_orderdate) AS y, sum(o_totalprice) AS rain FROM orders WHERE month(o_orderdate) BETWEEN 3 AND 5 GROUP BY 1)"


@query(f"WITH {_RAINY}, s AS (SELECT y, rain, avg(rain) OVER () AS m, stddev_pop(rain) OVER () AS sd FROM ry) SELECT y, round((rain - m) / sd, 6) AS z, round(100 * rain / m, 6) AS pct, rank() OVER (ORDER BY round(rain, 2)) AS driest FROM s")
def ch18_rain_by_year(spark, d):
    """The same months of each year: standard score, percent of normal and rank of the driest."""
    o = spark.read.parquet(f"{d}/orders.parquet").where(F.month("o_orderdate").between(3, 5))
    return rain_by_year(o, F.year("o_orderdate"), "o_totalprice").select("y", r6(F.col("z")).alias("z"), r6(F.col("pct")).alias("pct"), "driest")


_BOX = "nino AS (SELECT year(day) AS y, month(day) AS m, avg(tir) AS v FROM obs WHERE r >= 8 AND r < 12 AND c >= 4 AND c < 14 GROUP BY 1, 2)"


@query(f"WITH {OBS}, {_BOX} SELECT y, m, round(v - avg(v) OVER (PARTITION BY m), 6) AS anomaly FROM nino")
def ch20_box_anomaly(spark, d):
    """Monthly means of a box against the climatology of each month."""
    box = (F.col("r") >= 8) & (F.col("r") < 12) & (F.col("c") >= 4) & (F.col("c") < 14)
    return box_anomaly(adapter(spark, d, "obs"), box, "day", "tir").withColumn("anomaly", r6(F.col("anomaly")))


_HEAT = "k AS (SELECT r, c, avg(tir) AS t, avg(swir1) >= 0.25 AS urban, avg(nir) * 1000 AS h FROM obs GROUP BY r, c), e AS (SELECT avg(h) AS h FROM k WHERE urban)"


@query(f"WITH {OBS}, {_HEAT} SELECT round(avg(CASE WHEN urban THEN t END) - avg(CASE WHEN NOT urban AND abs(k.h - e.h) <= 30 THEN t END), 6) AS suhii, count(CASE WHEN NOT urban AND abs(k.h - e.h) <= 30 THEN 1 END) AS rural FROM k, e")
def ch21_matched_heat_island(spark, d, built=0.25, within=30.0):
    """Urban against rural cells whose height is near that of the city."""
    k = adapter(spark, d, "obs").groupBy("r", "c").agg(F.avg("tir").alias("t"), (F.avg("swir1") >= built).alias("urban"), (F.avg("nir") * 1000).alias("h"))
    h = heat_island(k, F.col("urban"), "t", "h", within)
    return h.select(r6(F.col("suhii")).alias("suhii"), F.col("n_rural").alias("rural"))


_CLOSE = f"p AS (SELECT r, c, avg(CASE WHEN year(day) <= 1994 THEN ({nd('nir', 'red')}) END) AS a, avg(CASE WHEN year(day) >= 1996 THEN ({nd('nir', 'red')}) END) AS b, avg(red) AS red FROM obs GROUP BY r, c)"


def green_cells(spark, d):
    ndvi = F.try_divide(F.col("nir") - F.col("red"), F.col("nir") + F.col("red"))
    return greenness(adapter(spark, d, "obs"), F.year("day") <= 1994, F.year("day") >= 1996, ndvi, red="red")


@query(f"WITH {OBS}, {_CLOSE}, e AS (SELECT quantile_cont(red, 0.02) AS lo, quantile_cont(red, 0.98) AS hi FROM p) SELECT r, c, a > 0.3 AND b - a < -0.02 AS lost, round(least(greatest((red - lo) / (hi - lo), 0), 1), 6) AS shown FROM p, e")
def ch27_close_up(spark, d):
    """Cells that were green and no longer are, and red light stretched between its 2nd and 98th percentile."""
    return close_up(green_cells(spark, d), "red", fall=-0.02).withColumn("shown", r6(F.col("shown")))


@query(f"WITH {OBS}, {_CLOSE} SELECT round(avg(a), 6) AS before, round(avg(b), 6) AS after, round(avg(b - a), 6) AS change, round(100 * avg((b - a < -0.05)::int), 6) AS pct_affected, round(100 * avg((b - a < -0.15)::int), 6) AS pct_severe FROM p")
def ch28_ndvi_change(spark, d):
    g = greenness_change(green_cells(spark, d))
    return g.select(*(r6(F.col(x)).alias(x) for x in g.columns))


@query(f"WITH {SCENE} SELECT orbit, count(CASE WHEN day < date '1994-01-01' THEN 1 END) AS n_0, count(CASE WHEN day >= date '1996-01-01' THEN 1 END) AS n_1 FROM scene GROUP BY orbit ORDER BY (count(CASE WHEN day < date '1994-01-01' THEN 1 END) > 0 AND count(CASE WHEN day >= date '1996-01-01' THEN 1 END) > 0) DESC, count(CASE WHEN day < date '1994-01-01' THEN 1 END) + count(CASE WHEN day >= date '1996-01-01' THEN 1 END) DESC, orbit LIMIT 1")
def ch4_orbit(spark, d):
    """The orbit that covers both periods best."""
    day = F.col("day")
    o = orbit_choice(adapter(spark, d, "scene"), "orbit", [day < F.lit("1994-01-01").cast("date"), day >= F.lit("1996-01-01").cast("date")])
    return o.select("orbit", "n_0", "n_1")


_AOI = "x AS (SELECT CASE WHEN nir > 0.05 THEN nir END AS v, nir > 0.5 AS mask FROM obs WHERE r BETWEEN 5 AND 14 AND c BETWEEN 5 AND 14)"


@query(f"WITH {OBS}, {_AOI} SELECT count(*) AS n, count(v) AS valid, round(avg(v), 6) AS mean, round(sum(v), 4) AS total, min(v) AS least, max(v) AS most, round(stddev_pop(v), 6) AS sd, round(quantile_cont(v, 0.9), 6) AS p90, round(100 * avg(CASE WHEN v IS NOT NULL THEN mask::int END), 6) AS pct_mask FROM x")
def ag1_area_reducers(spark, d):
    """All reducers of an area at once; a mask's percentage is of valid cells."""
    v = F.when(F.col("nir") > 0.05, F.col("nir"))
    x = adapter(spark, d, "obs").where("r BETWEEN 5 AND 14 AND c BETWEEN 5 AND 14").select(v.alias("v"), (F.col("nir") > 0.5).alias("mask"))
    a = area_reducers(x, "v", "mask")
    return a.select("n", "valid", r6(F.col("mean")).alias("mean"), F.round("total", 4).alias("total"), "least", "most", *(r6(F.col(x)).alias(n) for x, n in (("sd", "sd"), ("quantile", "p90"), ("pct_mask", "pct_mask"))))


@query(f"WITH {POINT}, s AS (SELECT sat, sum(value) AS total FROM point GROUP BY sat) SELECT sat, round(total, 4) AS total, round(100 * total / sum(total) OVER (), 6) AS pct FROM s")
def ag14_share_of_total(spark, d):
    s = share_of_total(adapter(spark, d, "point"), ["sat"], "value")
    return s.select("sat", F.round("total", 4).alias("total"), r6(F.col("pct")).alias("pct"))
