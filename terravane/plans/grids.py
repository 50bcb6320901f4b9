"""Queries: zones rasterised, fields sampled, counts on their own grid, burned area and peat."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import cell_area_ha, local_km
from ..functions.masks import clamp, in_days
from ..operators.assess import building_grid, year_to_date
from ..operators.graph import border_regions
from ..operators.joins import ROOK, nearest
from ..operators.overlay import Grid, aligned, block_factor, blended, centres, coarsened, crop_box, lattice_offset, mosaic, peat, rasterized, sampled, tiles
from ..operators.summaries import burn_rates
from ..sources.adapters import adapter, adapter_sql
from .registry import query, r6
from .zonal import zoned_points, zones, JOINED

OBS, POINT, ZONE = (adapter_sql(x) for x in ("obs", "point", "zone"))
#: 0.5 degree cells over the zones, and the grid of the observations' 20 by 20 cells over the same box.
FINE, COARSE = Grid(100, -10, 0.5, 0.5, 20, 40), Grid(100, -10, 0.5, 1.0, 20, 20)
_FINE = "fine AS (SELECT r::int AS r, c::int AS c, 100 + (c + 0.5::double) * 0.5::double AS x, -10 + (r + 0.5::double) * 0.5::double AS y FROM (SELECT unnest(range(0, 40)) AS r), (SELECT unnest(range(0, 20)) AS c))"
_RAST = "rast AS (SELECT r, c, x, y, min(zone_id) AS zone_id FROM fine JOIN zone ON x >= w AND x < e AND y >= s AND y < n GROUP BY r, c, x, y)"
_SAMPLE = "least(floor((y + 10) / 1.0::double), 19)::int AS sr, least(floor((x - 100) / 0.5::double), 19)::int AS sc"
_AREA = "(0.5::double * 111.320 * cos(radians(y)) * 0.5::double * 110.574 * 100)"


def fine_zones(spark, d):
    return rasterized(zones(spark, d), FINE, "zone_id")


@query(f"WITH {ZONE}, {_FINE}, {_RAST} SELECT r, c, zone_id FROM rast")
def rs4_rasterised(spark, d):
    return fine_zones(spark, d)


@query(f"WITH {ZONE}, {_FINE}, t AS (SELECT r, c, min(zone_id) AS zone_id FROM fine JOIN zone ON x - 0.25 <= e AND x + 0.25 >= w AND y - 0.25 <= n AND y + 0.25 >= s GROUP BY r, c) SELECT zone_id, count(*) AS n FROM t GROUP BY zone_id")
def rs4_all_touched(spark, d):
    return rasterized(zones(spark, d), FINE, "zone_id", all_touched=True).groupBy("zone_id").agg(F.count("*").alias("n"))


@query(f"WITH {OBS}, {ZONE}, {_FINE}, {_RAST}, f AS (SELECT r AS sr, c AS sc, avg(tir) AS v FROM obs GROUP BY r, c), q AS (SELECT zone_id, {_SAMPLE} FROM rast) SELECT zone_id, count(v) AS n, round(avg(v), 6) AS v FROM q LEFT JOIN f ON f.sr = q.sr AND f.sc = q.sc GROUP BY zone_id")
def ag5_zonal_mean(spark, d):
    """Means of a coarse field, sampled on the finer grid that the zones are drawn on."""
    field = adapter(spark, d, "obs").groupBy("r", "c").agg(F.avg("tir").alias("v"))
    return sampled(fine_zones(spark, d), FINE, field, COARSE, ["v"]).groupBy("zone_id").agg(F.count("v").alias("n"), r6(F.avg("v")).alias("v"))


_NATIVE = "nat AS (SELECT least(greatest(floor((lat + 10) / 0.5::double), 0), 39)::int AS r, least(greatest(floor((lon - 100) / 0.5::double), 0), 19)::int AS c, count(*) AS fires FROM point WHERE conf >= 30 GROUP BY 1, 2)"


@query(f"WITH {POINT}, {ZONE}, {_FINE}, {_RAST}, {_NATIVE} SELECT zone_id, sum(fires)::bigint AS fires, count(*) AS cells, round(sum({_AREA}), 6) AS burned_ha FROM nat JOIN rast ON nat.r = rast.r AND nat.c = rast.c GROUP BY zone_id")
def ag6_native_sums(spark, d):
    """Fires and burned hectares by zone, summed on the grid of the counts, whose cells are the zones' own here."""
    native = adapter(spark, d, "point").where("conf >= 30").groupBy(*(v.alias(k) for k, v in FINE.place(F.col("lon"), F.col("lat")).items())).agg(F.count("*").alias("fires"))
    met = native.join(fine_zones(spark, d), ["r", "c"]).withColumn("ha", cell_area_ha(FINE.centre()[1], 0.5, 0.5))
    return met.groupBy("zone_id").agg(F.sum("fires").alias("fires"), F.count("*").alias("cells"), r6(F.sum("ha")).alias("burned_ha"))


@query(f"WITH {OBS}, {_FINE}, k AS (SELECT r AS sr, c AS sc, CASE WHEN avg(tir) < 26.5 THEN 0 WHEN avg(tir) < 27 THEN 1 WHEN avg(tir) < 27.5 THEN 2 ELSE 3 END AS class FROM obs GROUP BY r, c), q AS (SELECT r, c, y, {_SAMPLE} FROM fine WHERE (r * 7 + c * 3) % 5 < 2), a AS (SELECT class, {_AREA} AS ha FROM q LEFT JOIN k ON k.sr = q.sr AND k.sc = q.sc) SELECT class, count(*) AS cells, round(sum(ha), 6) AS ha FROM a GROUP BY class")
def ag7_mask_overlay(spark, d):
    """Exact areas of classes within a mask, at the mask's own resolution; classes are sampled, never averaged."""
    t = F.avg("tir")
    classes = adapter(spark, d, "obs").groupBy("r", "c").agg(F.when(t < 26.5, 0).when(t < 27, 1).when(t < 27.5, 2).otherwise(3).alias("class"))
    mask = FINE.cells(spark).where("(r * 7 + c * 3) % 5 < 2")
    out = sampled(mask, FINE, classes, COARSE, ["class"]).withColumn("ha", cell_area_ha(FINE.centre()[1], 0.5, 0.5))
    return out.groupBy("class").agg(F.count("*").alias("cells"), r6(F.sum("ha")).alias("ha"))


@query(f"WITH {POINT}, {_FINE}, hit AS (SELECT DISTINCT floor((lat + 10) / 0.5::double)::int AS r, floor((lon - 100) / 0.5::double)::int AS c FROM point WHERE conf >= 95), m AS (SELECT fine.r // 4 AS r, fine.c // 4 AS c, avg((hit.r IS NOT NULL)::int) AS share FROM fine LEFT JOIN hit ON hit.r = fine.r AND hit.c = fine.c GROUP BY 1, 2) SELECT r::int AS r, c::int AS c, round(share, 6) AS share FROM m WHERE share > 0.02")
def ag7_display_cells(spark, d):
    """Cells of a display grid that are painted: those of which a fine mask, the cells with a sure detection, covers over 2 percent."""
    p = adapter(spark, d, "point").where("conf >= 95")
    hit = p.select(F.floor((F.col("lat") + 10) / 0.5).cast("int").alias("r"), F.floor((F.col("lon") - 100) / 0.5).cast("int").alias("c")).distinct().withColumn("share", F.lit(1))
    mask = FINE.cells(spark).join(hit, ["r", "c"], "left").withColumn("share", F.coalesce("share", F.lit(0)))
    return coarsened(mask, "share", 4).where("share > 0.02").withColumn("share", r6(F.col("share")))


@query(f"WITH {OBS}, f AS (SELECT r, c, avg(nir) AS v FROM obs GROUP BY r, c) SELECT (r // 2)::int AS r, (c // 2)::int AS c, round(avg(v), 6) AS v FROM f GROUP BY 1, 2")
def ag9_coarsened(spark, d):
    """A grid of 400 cells for an output that may hold 120: coarsened by 2, then it fits."""
    field = adapter(spark, d, "obs").groupBy("r", "c").agg(F.avg("nir").alias("v"))
    return coarsened(field, "v", block_factor(20, 20, 120)).withColumn("v", r6(F.col("v")))


_BURNED = "burn AS (SELECT r, c, year(day) AS y, max((nir < 0.2)::int) AS hit, count(CASE WHEN nir < 0.2 THEN 1 END) AS fires FROM obs GROUP BY r, c, year(day))"
_SOIL = "soil AS (SELECT r, c, avg(red) * 100 AS carbon, max(blue) - 0.2::double AS depth FROM obs GROUP BY r, c)"
_CELL = "(0.5::double * 111.320 * cos(radians(-10 + (r + 0.5::double) * 1.0::double)) * 1.0::double * 110.574 * 100)"


def burned(spark, d):
    hit = F.col("nir") < 0.2
    return adapter(spark, d, "obs").groupBy("r", "c", F.year("day").cast("long").alias("y")).agg(F.max(hit.cast("int")).alias("hit"), F.count(F.when(hit, 1)).alias("fires"))


def soil(spark, d):
    return adapter(spark, d, "obs").groupBy("r", "c").agg((F.avg("red") * 100).alias("carbon"), (F.max("blue") - 0.2).alias("depth"))


def coarse_ha():
    return cell_area_ha(COARSE.centre()[1], 0.5, 1.0)


@query(f"WITH {OBS}, {_SOIL} SELECT count(*) AS cells, count(CASE WHEN carbon >= 25.5 THEN 1 END) AS by_carbon, count(CASE WHEN depth > 0 THEN 1 END) AS by_depth, round(sum(CASE WHEN carbon >= 25.5 THEN {_CELL} ELSE 0 END), 4) AS carbon_ha FROM soil")
def ch31_peat_masks(spark, d):
    s = soil(spark, d)
    rich, deep = peat(carbon=F.col("carbon"), least_carbon=25.5), peat(depth=F.col("depth"))
    return s.agg(F.count("*").alias("cells"), F.count(F.when(rich, 1)).alias("by_carbon"), F.count(F.when(deep, 1)).alias("by_depth"), F.round(F.sum(F.when(rich, coarse_ha()).otherwise(0.0)), 4).alias("carbon_ha"))


@query(f"WITH {OBS}, {_BURNED}, {_SOIL} SELECT y, round(sum(CASE WHEN hit = 1 THEN {_CELL} ELSE 0 END), 4) AS ha, round(sum(CASE WHEN hit = 1 AND carbon >= 25.5 THEN {_CELL} ELSE 0 END), 4) AS peat_ha, sum(fires)::bigint AS fires FROM (SELECT burn.r AS r, burn.c AS c, y, hit, fires, carbon FROM burn LEFT JOIN soil ON burn.r = soil.r AND burn.c = soil.c) GROUP BY y")
def ag10_burned_by_year(spark, d):
    b = burned(spark, d).join(soil(spark, d), ["r", "c"], "left")
    hit = F.col("hit") == 1
    return b.groupBy("y").agg(F.round(F.sum(F.when(hit, coarse_ha()).otherwise(0.0)), 4).alias("ha"), F.round(F.sum(F.when(hit & peat(carbon=F.col("carbon"), least_carbon=25.5), coarse_ha()).otherwise(0.0)), 4).alias("peat_ha"), F.sum("fires").alias("fires"))


@query(f"WITH {OBS} SELECT month(day) AS m, count(CASE WHEN nir < 0.2 THEN 1 END) AS fires, count(DISTINCT CASE WHEN nir < 0.2 THEN year(day) END) AS years FROM obs GROUP BY 1")
def ag10_season(spark, d):
    hit = F.col("nir") < 0.2
    return adapter(spark, d, "obs").groupBy(F.month("day").cast("long").alias("m")).agg(F.count(F.when(hit, 1)).alias("fires"), F.count_distinct(F.when(hit, F.year("day"))).alias("years"))


@query(f"WITH {OBS}, {_BURNED}, loc AS (SELECT r, c, true AS peat FROM (SELECT DISTINCT r, c FROM obs) WHERE r < 15 AND (r + c) % 3 = 0) SELECT y, count(CASE WHEN hit = 1 THEN 1 END) AS burned, count(CASE WHEN hit = 1 AND coalesce(peat, false) THEN 1 END) AS on_peat, round(100 * avg(CASE WHEN coalesce(peat, false) THEN hit END), 6) AS peat_rate, round(100 * avg(CASE WHEN NOT coalesce(peat, false) THEN hit END), 6) AS other_rate FROM burn LEFT JOIN loc ON burn.r = loc.r AND burn.c = loc.c GROUP BY y")
def su42_local_peat(spark, d):
    """Burn rates with a local peat raster that covers only part of the area: cells beyond it aren't peat."""
    local = adapter(spark, d, "obs").select("r", "c").where("r < 15 AND (r + c) % 3 = 0")
    b = burn_rates(burned(spark, d), local, "y", "hit")
    return b.withColumns({k: r6(F.col(k)) for k in ("peat_rate", "other_rate")})


@query("WITH y AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%m-%d') >= '01-01' AND strftime(o_orderdate, '%m-%d') < '07-15' GROUP BY 1), b AS (SELECT avg(n) AS mean, avg(CASE WHEN y >= 1995 THEN n END) AS recent FROM y WHERE y < 1998) SELECT y, n, round(n / mean, 6) AS against_mean, round(n / recent, 6) AS against_recent, rank() OVER (ORDER BY n DESC) AS rank FROM y, b")
def ag11_year_to_date(spark, d):
    """Counts of the same part of each year, 1 January up to but without 15 July, against the years before the last."""
    y = year_to_date(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate", "01-01", "07-15", 1998, 1995)
    return y.select("y", "n", r6(F.col("against_mean")).alias("against_mean"), r6(F.col("against_recent")).alias("against_recent"), "rank")


_CITY = "city AS (SELECT s_suppkey AS city, 100 + (s_suppkey * 37 % 1000)::double / 100 AS cx, -10 + (s_suppkey * 91 % 2000)::double / 100 AS cy FROM supplier)"


@query(f"WITH {POINT}, {_CITY}, k AS (SELECT event_id, city, value, sqrt(power((lon - cx) * 111.32::double * cos(radians(0::double)), 2) + power((lat - cy) * 110.57::double, 2)) AS km FROM point JOIN city ON abs(lon - cx) <= 0.3 AND abs(lat - cy) <= 0.3), b AS (SELECT event_id, arg_min(city, (km, city)) AS city, any_value(value) AS value FROM k WHERE km <= 25 GROUP BY event_id) SELECT city, count(*) AS n, round(sum(value), 6) AS total FROM b GROUP BY city")
def ag28_catchments(spark, d):
    """Sums over the points whose nearest city is at most 25 km away."""
    lon = F.lit(100.0) + (F.col("s_suppkey") * 37 % 1000).cast("double") / 100
    lat = F.lit(-10.0) + (F.col("s_suppkey") * 91 % 2000).cast("double") / 100
    city = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("city"), lon.alias("cx"), lat.alias("cy"))
    degree = local_km(F.lit(1.0), F.lit(1.0), 0.0, 0.0)
    near = nearest(adapter(spark, d, "point"), city, ["event_id"], "lon", "lat", "cx", "cy", "city", 25.0, degree).where("city IS NOT NULL")
    return near.groupBy("city").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("WITH b AS (SELECT (p_partkey * 137 % 20000)::double AS x, (p_partkey * 311 % 20000)::double AS y, p_retailprice AS area FROM part WHERE p_size >= 20) SELECT floor(x / 400)::bigint AS gx, floor(y / 400)::bigint AS gy, count(*) AS n, round(sum(area), 6) AS area FROM b GROUP BY 1, 2")
def ag29_building_grid(spark, d):
    """Buildings and their area by cells of 400 m."""
    b = spark.read.parquet(f"{d}/part.parquet").where("p_size >= 20")
    g = building_grid(b, F.col("p_partkey") * 137 % 20000, F.col("p_partkey") * 311 % 20000, "p_retailprice")
    return g.withColumn("area", r6(F.col("area")))


@query("SELECT count(*) AS buildings, round(sum(p_retailprice), 6) AS area FROM part WHERE p_size / 50.0 >= 0.70")
def sc28_buildings(spark, d):
    """Footprints with a confidence of 0.70 at least."""
    b = spark.read.parquet(f"{d}/part.parquet").where(F.col("p_size") / 50.0 >= 0.70)
    return b.agg(F.count("*").alias("buildings"), r6(F.sum("p_retailprice")).alias("area"))


_FRAME = "frame AS (SELECT (scene_id % 4)::int AS f, r, c, avg(nir) AS v FROM obs WHERE abs(c - 5 * (scene_id % 4)) <= 5 GROUP BY 1, 2, 3)"


@query(f"WITH {OBS}, {_FRAME} SELECT r, c, round(avg(v), 4) AS mean, round(arg_min(v, f), 4) AS first, count(*) AS frames FROM frame GROUP BY r, c")
def ag30_mosaic(spark, d):
    o = adapter(spark, d, "obs").withColumn("f", (F.col("scene_id") % 4).cast("int")).where("abs(c - 5 * f) <= 5")
    out = mosaic(o.groupBy("f", "r", "c").agg(F.avg("nir").alias("v")), "v", "f")
    return out.select("r", "c", F.round("mean", 4).alias("mean"), F.round("first", 4).alias("first"), "frames")


@query(f"WITH {OBS}, a AS (SELECT r, c, avg(nir) AS a FROM obs GROUP BY r, c), b AS (SELECT r + 3 AS r, c - 2 AS c, avg(red) AS b FROM obs GROUP BY r, c) SELECT a.r AS r, a.c AS c, round(a, 6) AS a, round(b, 6) AS b FROM a JOIN b ON a.r = b.r AND a.c = b.c")
def jn3_integer_offset(spark, d):
    """Two rasters of one lattice with different corners, joined where they overlap."""
    o = adapter(spark, d, "obs")
    rows, columns = lattice_offset((100.0, -10.0), (99.0, -8.5), 0.5)
    both = aligned(o.groupBy("r", "c").agg(F.avg("nir").alias("a")), o.groupBy("r", "c").agg(F.avg("red").alias("b")), rows, columns)
    return both.select("r", "c", r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"))


@query(f"WITH {ZONE}, t AS (SELECT zone_id, unnest(range(0, 3)) AS i, w, s, e, n FROM zone), u AS (SELECT *, unnest(range(0, 6)) AS j FROM t) SELECT zone_id, w + i * 0.75::double AS tw, s + j * 0.75::double AS ts, least(w + i * 0.75::double + 0.75, e) AS te, least(s + j * 0.75::double + 0.75, n) AS tn FROM u")
def rs8_request_tiles(spark, d):
    return tiles(adapter(spark, d, "zone").select("zone_id", "w", "s", "e", "n"), 0.75).select("zone_id", "tw", "ts", "te", "tn")


@query(f"WITH {OBS}, f AS (SELECT r, c, count(CASE WHEN nir < 0.02 THEN 1 END) AS v FROM obs WHERE r > 3 AND c < 14 GROUP BY r, c) SELECT greatest(min(r) - 2, 0) AS r0, least(max(r) + 2, 19) AS r1, greatest(min(c) - 2, 0) AS c0, least(max(c) + 2, 19) AS c1 FROM f WHERE v > 0")
def rs11_crop_box(spark, d):
    f = adapter(spark, d, "obs").where("r > 3 AND c < 14").groupBy("r", "c").agg(F.count(F.when(F.col("nir") < 0.02, 1)).alias("v"))
    return crop_box(f, F.col("v") > 0, 2, 20, 20)


@query(f"WITH {POINT}, {_NATIVE} SELECT 100 + (c + 0.5::double) * 0.5::double AS lon, -10 + (r + 0.5::double) * 0.5::double AS lat, fires FROM nat")
def rs12_cell_centres(spark, d):
    p = adapter(spark, d, "point").groupBy(*(v.alias(k) for k, v in FINE.place(F.col("lon"), F.col("lat")).items())).agg(F.count(F.when(F.col("conf") >= 30, 1)).alias("fires"))
    return centres(p, FINE, "fires")


_WATER = "wet AS (SELECT r, c, r * 100 + c AS id FROM (SELECT r, c, avg(nir) AS v FROM obs GROUP BY r, c) WHERE v < 0.49)"


@query(f"WITH RECURSIVE {OBS}, {_WATER}, sea AS (SELECT id, r, c FROM wet WHERE r IN (0, 19) OR c IN (0, 19) UNION SELECT w.id, w.r, w.c FROM sea s JOIN wet w ON abs(w.r - s.r) + abs(w.c - s.c) = 1) SELECT r, c, (r, c) IN (SELECT (r, c) FROM wet) AS inland_water FROM (SELECT DISTINCT r, c FROM obs) WHERE (r, c) NOT IN (SELECT (r, c) FROM sea)")
def pr16_land_mask(spark, d):
    """Land is what isn't sea: water that reaches the frame. Lakes and ponds stay land, marked."""
    v = adapter(spark, d, "obs").groupBy("r", "c").agg(F.avg("nir").alias("v"))
    wet = v.where("v < 0.49").select("r", "c")
    land = v.join(border_regions(wet, 20, 20, ROOK), ["r", "c"], "left_anti")
    return land.select("r", "c", (F.col("v") < 0.49).alias("inland_water"))


@query(f"WITH {POINT}, {ZONE}, {JOINED} SELECT event_id, zone_id IS NOT NULL AS land FROM j")
def pr16_land_by_polygon(spark, d):
    return zoned_points(spark, d).select("event_id", F.col("zone_id").isNotNull().alias("land"))


_NORM = "least(greatest((v - 0.2) / 0.6, 0), 1)"


@query(f"WITH {OBS}, f AS (SELECT r, c, avg(CASE WHEN nir > 0.1 THEN nir END) AS v, max(CASE WHEN swir1 > 0.2 THEN swir1 END) AS m FROM obs WHERE r < 15 GROUP BY r, c) SELECT r, c, round(CASE WHEN v IS NOT NULL THEN {_NORM} END, 6) AS norm, CASE WHEN v IS NOT NULL THEN floor({_NORM} * 255 + 0.5)::int END AS shown, round(coalesce(m, 0), 6) AS filled, CASE WHEN m > 0.4 THEN 1 END AS only_true FROM f")
def pr7_display_scaling(spark, d):
    """0 to 1 between two bounds, 0 to 255 for display, masked cells filled with 0, and a mask that masks its own false cells."""
    f = adapter(spark, d, "obs").where("r < 15").groupBy("r", "c").agg(F.avg(F.when(F.col("nir") > 0.1, F.col("nir"))).alias("v"), F.max(F.when(F.col("swir1") > 0.2, F.col("swir1"))).alias("m"))
    norm = norm01(F.col("v"), 0.2, 0.8)
    return f.select("r", "c", r6(norm).alias("norm"), F.floor(norm * 255 + 0.5).cast("int").alias("shown"), r6(F.coalesce("m", F.lit(0.0))).alias("filled"), F.when(F.col("m") > 0.4, 1).alias("only_true"))


def norm01(x, low: float, high: float):
    return clamp((x - low) / (high - low), 0, 1)


@query(f"WITH {OBS} SELECT count(CASE WHEN day >= date '1995-03-01' AND day < date '1995-06-01' THEN 1 END) AS season, count(CASE WHEN day = date '1995-03-01' THEN 1 END) AS one_day FROM obs WHERE r >= 5 AND r < 10 AND c >= 5 AND c < 10")
def pr12_half_open(spark, d):
    """A window without its end day; a single day is [d, d + 1). Cells are clipped to a box as half-open as the window."""
    o = adapter(spark, d, "obs").where("r >= 5 AND r < 10 AND c >= 5 AND c < 10")
    return o.agg(F.count(F.when(in_days(F.col("day"), "1995-03-01", "1995-06-01"), 1)).alias("season"), F.count(F.when(in_days(F.col("day"), "1995-03-01", "1995-03-02"), 1)).alias("one_day"))


@query(f"WITH {OBS}, f AS (SELECT r, c, avg(nir) AS v FROM obs GROUP BY r, c), k AS (SELECT * FROM (VALUES (-1, 0.25::double), (0, 0.5::double), (1, 0.25::double)) t(o, w)) SELECT a.r AS r, a.c AS c, round(sum(b.v * x.w * y.w) / sum(x.w * y.w), 6) AS v FROM f a, k x, k y JOIN f b ON true WHERE b.r = a.r + x.o AND b.c = a.c + y.o GROUP BY 1, 2")
def tc15_smoothed(spark, d):
    f = adapter(spark, d, "obs").groupBy("r", "c").agg(F.avg("nir").alias("v"))
    return blended(f, "v", (0.25, 0.5, 0.25)).withColumn("v", r6(F.col("v")))
