"""Queries: trajectories, resampling, phase and further statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.paths import at_times, bilinear, coherence, contour, crossed, path_lengths, phase_gradient
from ..operators.stats import plane
from ..operators.summaries import best_window
from ..sources.adapters import adapter, adapter_sql
from .dynamics import COUNTS, counts
from .registry import query, r6
from .zonal import zones

OBS, POINT, ZONE, PAIRS = (adapter_sql(x) for x in ("obs", "point", "zone", "pair_obs"))
_PATH = "path AS (SELECT user_id AS k, event_id AS i, 100 + (event_id * 37 % 1000)::double / 100 AS x, -10 + (event_id * 91 % 2000)::double / 100 AS y FROM events)"
_SEG = "seg AS (SELECT * FROM (SELECT k, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM path WINDOW w AS (PARTITION BY k ORDER BY i)) WHERE x2 IS NOT NULL)"


def path(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.selectExpr("user_id AS k", "event_id AS i", "100 + cast(event_id * 37 % 1000 as double) / cast(100 as double) AS x", "-10 + cast(event_id * 91 % 2000 as double) / cast(100 as double) AS y")


@query(f"WITH {_PATH}, {_SEG} SELECT k, round(sum(2 * 6371.0 * asin(sqrt(least(power(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * power(sin(radians(x2 - x1) / 2), 2), 1)))), 5) AS km, count(*) AS steps FROM seg GROUP BY k")
def rc6_path_lengths(spark, d):
    return path_lengths(path(spark, d), ["k"], "i", "x", "y").withColumn("km", F.round("km", 5))


_SIDE = "sign(({qx} - {px}) * ({ry} - {py}) - ({qy} - {py}) * ({rx} - {px}))"


def _cross(a, b):
    s = lambda p, q, r: _SIDE.format(px=p[0], py=p[1], qx=q[0], qy=q[1], rx=r[0], ry=r[1])
    return f"({s(a[0], a[1], b[0])} <> {s(a[0], a[1], b[1])} AND {s(b[0], b[1], a[0])} <> {s(b[0], b[1], a[1])})"


_OWN = (("x1", "y1"), ("x2", "y2"))
_RING = [(("w", "s"), ("e", "s")), (("e", "s"), ("e", "n")), (("e", "n"), ("w", "n")), (("w", "n"), ("w", "s"))]
_IN = "({x} >= w AND {x} < e AND {y} >= s AND {y} < n)"


@query(f"WITH {_PATH}, {_SEG}, {ZONE}, h AS (SELECT DISTINCT k, zone_id FROM seg JOIN zone ON {_IN.format(x='x1', y='y1')} OR {_IN.format(x='x2', y='y2')} OR {' OR '.join(_cross(_OWN, side) for side in _RING)}) SELECT zone_id, count(*) AS n_lines FROM h GROUP BY zone_id")
def js2_zones_crossed(spark, d):
    return crossed(path(spark, d), zones(spark, d), ["k"], "i", "x", "y", "zone_id", tile=4.0)


@query("WITH v AS (SELECT user_id AS k, hour(ts) AS h, avg(value) AS v FROM events GROUP BY 1, 2), q AS (SELECT DISTINCT user_id AS k, h + 0.25::double AS t, h FROM events, (SELECT unnest([3, 9, 15]) AS h)) SELECT q.k AS k, t, round(a.v * 0.75::double + b.v * 0.25::double, 6) AS v FROM q LEFT JOIN v a ON a.k = q.k AND a.h = q.h LEFT JOIN v b ON b.k = q.k AND b.h = q.h + 1")
def tc14_interpolated(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("k"), F.hour("ts").alias("t"), "value")
    series = e.groupBy("k", "t").agg(F.avg("value").alias("v"))
    wanted = e.select("k").distinct().withColumn("t", F.explode(F.array(*map(F.lit, (3.25, 9.25, 15.25)))))
    return at_times(series, wanted, ["k"], "t", "v").withColumn("v", r6(F.col("v")))


@query(f"WITH {OBS}, {COUNTS}, {POINT}, p AS (SELECT event_id, (lon - 100) * 2 AS x, (lat + 10) AS y FROM point), f AS (SELECT *, floor(x)::int AS x0, floor(y)::int AS y0 FROM p), k AS (SELECT event_id, y0 + dr AS r, x0 + dc AS c, (1 - abs(y - y0 - dr)) * (1 - abs(x - x0 - dc)) AS wt FROM f, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc)) SELECT event_id, round(CASE WHEN count(v) = count(*) THEN sum(v * wt) END, 6) AS v FROM k LEFT JOIN v ON v.r = k.r AND v.c = k.c WHERE wt > 0 GROUP BY event_id")
def rs3_bilinear(spark, d):
    p = adapter(spark, d, "point")
    out = bilinear(p, counts(spark, d), ["event_id"], (F.col("lon") - 100) * 2, F.col("lat") + 10, "v")
    return out.withColumn("v", r6(F.col("v")))


_PHASE = "ph AS (SELECT r, c, (sum(l_quantity) % 628) / 100 - 3.14::double AS phase FROM (SELECT floor((l_partkey % 400) / 20)::int AS r, ((l_partkey % 400) % 20)::int AS c, l_quantity FROM lineitem) GROUP BY r, c)"


def phase(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    cell = F.col("l_partkey") % 400
    return li.groupBy(F.floor(cell / 20).cast("int").alias("r"), (cell % 20).cast("int").alias("c")).agg((F.sum("l_quantity") % 628 / 100 - 3.14).alias("phase"))


@query(f"WITH {_PHASE}, s AS (SELECT r, c, CASE WHEN lead(c) OVER w = c + 1 THEN lead(phase) OVER w - phase END AS d FROM ph WINDOW w AS (PARTITION BY r ORDER BY c)) SELECT (r // 5)::int AS tr, (c // 5)::int AS tc, count(d) AS n, round(CASE WHEN count(d) >= 6.25 THEN atan2(sum(sin(d)), sum(cos(d))) END, 6) AS step FROM s GROUP BY 1, 2")
def rs7_phase_gradient(spark, d):
    return phase_gradient(phase(spark, d), "phase", 5).withColumn("step", r6(F.col("step")))


_SLC = "slc AS (SELECT r, c, nir - 0.5::double AS re1, red - 0.25::double AS im1, nir - 0.5::double + swir1 AS re2, red - 0.25::double - swir1 AS im2 FROM obs)"


@query(f"WITH {OBS}, {_SLC} SELECT (r // 4)::int AS br, (c // 4)::int AS bc, count(*) AS n, round(sqrt(power(avg(re1*re2 + im1*im2), 2) + power(avg(im1*re2 - re1*im2), 2)) / sqrt(avg(re1*re1 + im1*im1) * avg(re2*re2 + im2*im2)), 6) AS coherence, round(sqrt(pi() / (4 * count(*))), 6) AS noise_floor FROM slc GROUP BY 1, 2")
def su28_coherence(spark, d):
    o, nir, red, sw = adapter(spark, d, "obs"), F.col("nir") - 0.5, F.col("red") - 0.25, F.col("swir1")
    c = coherence(o.select("r", "c", nir.alias("re1"), red.alias("im1"), (nir + sw).alias("re2"), (red - sw).alias("im2")), 4)
    return c.select("br", "bc", "n", r6(F.col("coherence")).alias("coherence"), r6(F.col("noise_floor")).alias("noise_floor"))


_QUAD = "q AS (SELECT a.r AS r, a.c AS c, a.v AS a, b.v AS b, d.v AS d, e.v AS e FROM v a JOIN v b ON b.r = a.r AND b.c = a.c + 1 JOIN v d ON d.r = a.r + 1 AND d.c = a.c JOIN v e ON e.r = a.r + 1 AND e.c = a.c + 1)"
_SIDES = "p AS (SELECT r, c, c + (150.5::double - a) / nullif(b - a, 0) AS tx, r::double AS ty, c + (150.5::double - d) / nullif(e - d, 0) AS ux, r + 1::double AS uy, c::double AS lx, r + (150.5::double - a) / nullif(d - a, 0) AS ly, c + 1::double AS sx, r + (150.5::double - b) / nullif(e - b, 0) AS sy, (a > 150.5)::int + (b > 150.5)::int * 2 + (e > 150.5)::int * 4 + (d > 150.5)::int * 8 AS k, (a + b + d + e) / 4 > 150.5 AS high FROM q)"
_SADDLE = {"apart": "(k = 5 AND NOT high) OR (k = 10 AND high)", "across": "(k = 5 AND high) OR (k = 10 AND NOT high)"}
_PARTS = (("l", "t", "1, 14", "apart"), ("t", "s", "2, 13", "across"), ("l", "s", "3, 12", None), ("s", "u", "4, 11", None), ("t", "u", "6, 9", None), ("l", "u", "7, 8", "across"), ("u", "s", "-1", "apart"))
_LINES = " UNION ALL ".join(f"SELECT r, c, round({p}x, 6) AS x1, round({p}y, 6) AS y1, round({q}x, 6) AS x2, round({q}y, 6) AS y2 FROM p WHERE k IN ({ks})" + (f" OR {_SADDLE[s]}" if s else "") for p, q, ks, s in _PARTS)


@query(f"WITH {OBS}, {COUNTS}, {_QUAD}, {_SIDES} {_LINES}")
def gr7_contour(spark, d):
    lines = contour(counts(spark, d), "v", 150.5)
    return lines.select("r", "c", *(r6(F.col(k)).alias(k) for k in ("x1", "y1", "x2", "y2")))


@query(f"WITH {PAIRS} SELECT cell, round(avg(phase), 6) AS mean, round(stddev_samp(phase), 6) AS sd, round(quantile_cont(phase, 0.05), 6) AS p05, round(quantile_cont(phase, 0.95), 6) AS p95, count(CASE WHEN coh >= 0.3 THEN 1 END) AS n_03, count(CASE WHEN coh >= 0.6 THEN 1 END) AS n_06 FROM pair_obs GROUP BY cell")
def ag15_stack_statistics(spark, d):
    over = lambda b: F.count(F.when(F.col("coh") >= b, 1))
    return adapter(spark, d, "pair_obs").groupBy("cell").agg(
        r6(F.avg("phase")).alias("mean"), r6(F.stddev_samp("phase")).alias("sd"), r6(F.percentile("phase", 0.05)).alias("p05"), r6(F.percentile("phase", 0.95)).alias("p95"), over(0.3).alias("n_03"), over(0.6).alias("n_06")
    )


@query(f"WITH {PAIRS}, t AS (SELECT cell, regr_slope(phase, years) AS rate FROM pair_obs GROUP BY cell) SELECT count(*) AS n, round(avg(rate), 6) AS mean, round(median(rate), 6) AS median, round(min(rate), 6) AS least, round(100 * avg((rate < 0)::int), 6) AS pct_negative FROM t WHERE abs(rate) <= 30")
def ag26_transect_rates(spark, d):
    t = adapter(spark, d, "pair_obs").groupBy("cell").agg(F.regr_slope("phase", "years").alias("rate")).where(F.abs("rate") <= 30)
    return t.agg(F.count("*").alias("n"), r6(F.avg("rate")).alias("mean"), r6(F.median("rate")).alias("median"), r6(F.min("rate")).alias("least"), r6(100 * F.avg((F.col("rate") < 0).cast("int"))).alias("pct_negative"))


@query("WITH y AS (SELECT o_orderpriority AS k, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), b AS (SELECT k, avg(CASE WHEN y < 1998 THEN v END) AS m, stddev_samp(CASE WHEN y < 1998 THEN v END) AS sd, max(CASE WHEN y = 1998 THEN v END) AS now FROM y GROUP BY k) SELECT b.k AS k, round((now - m) / sd, 6) AS z, count(CASE WHEN y.v >= now AND y.y < 1998 THEN 1 END) AS n_at_least FROM b JOIN y ON y.k = b.k GROUP BY b.k, now, m, sd")
def ag27_against_baseline(spark, d):
    y = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    base = F.when(F.col("y") < 1998, F.col("v"))
    b = y.groupBy("k").agg(F.avg(base).alias("m"), F.stddev_samp(base).alias("sd"), F.max(F.when(F.col("y") == 1998, F.col("v"))).alias("now"))
    out = y.join(b, "k").groupBy("k").agg(F.first(F.try_divide(F.col("now") - F.col("m"), F.col("sd"))).alias("z"), F.count(F.when((F.col("v") >= F.col("now")) & (F.col("y") < 1998), 1)).alias("n_at_least"))
    return out.withColumn("z", r6(F.col("z")))


@query(f"WITH {OBS}, v AS (SELECT r, c, avg(tir) AS v FROM obs GROUP BY r, c), m AS (SELECT avg(r) AS mr, avg(c) AS mc, avg(v) AS mv FROM v), q AS (SELECT sum((r-mr)*(r-mr)) AS xx, sum((c-mc)*(c-mc)) AS yy, sum((r-mr)*(c-mc)) AS xy, sum((r-mr)*(v-mv)) AS xz, sum((c-mc)*(v-mv)) AS yz FROM v, m), f AS (SELECT (xz*yy - yz*xy) / (xx*yy - xy*xy) AS b, (yz*xx - xz*xy) / (xx*yy - xy*xy) AS k FROM q) SELECT floor(sqrt(r*r + c*c) / 5)::int AS ring, count(*) AS n, round(avg(v - (mv + b * (r - mr) + k * (c - mc))), 6) AS residual FROM v, m, f GROUP BY 1")
def su31_deramped_profile(spark, d):
    v = adapter(spark, d, "obs").groupBy("r", "c").agg(F.avg("tir").alias("v"))
    v = v.withColumns({"x": F.col("r").cast("double"), "y": F.col("c").cast("double")})
    fit = plane(v, "x", "y", "v").select("a", "b", F.col("c").alias("k"))
    away = v.crossJoin(F.broadcast(fit)).withColumn("residual", F.col("v") - (F.col("a") + F.col("b") * F.col("x") + F.col("k") * F.col("y")))
    return away.groupBy(F.floor(F.hypot("x", "y") / 5).cast("int").alias("ring")).agg(F.count("*").alias("n"), r6(F.avg("residual")).alias("residual"))


@query(f"WITH {POINT} SELECT floor(lon * 2)::bigint AS gx, floor(lat * 2)::bigint AS gy, count(*) AS n, round(sum(value), 6) AS total FROM point GROUP BY 1, 2 ORDER BY n DESC, gx, gy LIMIT 10")
def rs10_hottest_cells(spark, d):
    """A report of ten cells."""
    g = adapter(spark, d, "point").groupBy(F.floor(F.col("lon") * 2).alias("gx"), F.floor(F.col("lat") * 2).alias("gy")).agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))
    return g.orderBy(F.desc("n"), "gx", "gy").limit(10)


@query("WITH d AS (SELECT DISTINCT ts::date AS day FROM events), r AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM d), p AS (SELECT a.day AS first, count(*) AS covered, max(b.day) AS last FROM r a JOIN r b ON b.k BETWEEN a.k AND a.k + 19 GROUP BY a.day) SELECT first, last, covered FROM p ORDER BY covered DESC, first LIMIT 1")
def wn6_best_window(spark, d):
    """Over one row a day."""
    return best_window(spark.read.parquet(f"{d}/events.parquet").select(F.to_date("ts").alias("day")), "day")
