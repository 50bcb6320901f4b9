"""Queries: shorelines and access."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.access import auto_box, served_edges, served_shares
from ..operators.coast import baseline, central_region, closed, coast_change, crossings, filled, open_lines, seaward, shore_length
from ..operators.graph import border_regions, distances, undirected
from ..operators.joins import ROOK
from ..sources.adapters import adapter, adapter_sql
from .dynamics import _BOTH, _LABEL, _MASK, _NEAR8, _ROUNDS, COUNTS, EDGE, counts, mask
from .registry import query, r6

OBS, POINT = adapter_sql("obs"), adapter_sql("point")
_SPLIT = "date '1995-06-01'"
_LAND = f"land AS (SELECT r, c, avg(CASE WHEN day < {_SPLIT} THEN nir END) >= 0.5 AS a, avg(CASE WHEN day >= {_SPLIT} THEN nir END) >= 0.5 AS b FROM obs GROUP BY r, c)"


def land(spark, d):
    late = F.col("day") >= F.lit("1995-06-01").cast("date")
    return adapter(spark, d, "obs").groupBy("r", "c").agg((F.avg(F.when(~late, F.col("nir"))) >= 0.5).alias("a"), (F.avg(F.when(late, F.col("nir"))) >= 0.5).alias("b"))


_KIND = "m AS (SELECT r, c, kind, r * 100 + c AS id FROM (SELECT r, c, CASE WHEN a AND NOT b THEN 'erosion' WHEN NOT a AND b THEN 'accretion' END AS kind FROM land) WHERE kind IS NOT NULL)"


@query(f"WITH RECURSIVE {OBS}, {_LAND}, {_KIND}, lab AS (SELECT id, id AS to_id FROM m UNION SELECT l.id, b.id FROM lab l JOIN m a ON a.id = l.to_id JOIN m b ON {_NEAR8} AND b.id <> a.id AND a.kind = b.kind), root AS (SELECT id, min(to_id) AS root FROM lab GROUP BY id), s AS (SELECT root FROM root GROUP BY root HAVING count(*) >= 3) SELECT kind, count(*) AS cells, round(count(*) * 0.09::double, 6) AS ha FROM m JOIN root ON m.id = root.id WHERE root IN (SELECT root FROM s) GROUP BY kind")
def ch24_coast_change(spark, d, least=3):
    """Erosion and accretion in regions of three cells or more, of 30 m."""
    return coast_change(land(spark, d), F.col("a"), F.col("b"), least).groupBy("kind").agg(F.count("*").alias("cells"), r6(F.count("*") * 0.09).alias("ha"))


#: A ring for each user: corners on a box, on its frame where the event's value is high.
_RING = "ring AS (SELECT user_id AS k, event_id AS i, CASE WHEN value > 60 THEN 0::double ELSE 1 + (event_id * 37 % 80)::double / 10 END AS x, CASE WHEN value > 60 AND event_id % 2 = 0 THEN 0::double ELSE 1 + (event_id * 91 % 80)::double / 10 END AS y FROM events)"
_LINES = "seg AS (SELECT k, i, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ring WINDOW w AS (PARTITION BY k ORDER BY i)), cut AS (SELECT *, ((x1 = 0 AND x2 = 0) OR (x1 = 10 AND x2 = 10) OR (y1 = 0 AND y2 = 0) OR (y1 = 10 AND y2 = 10))::int AS q, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS len FROM seg WHERE x2 IS NOT NULL), num AS (SELECT *, sum(q) OVER (PARTITION BY k ORDER BY i) AS line FROM cut), lines AS (SELECT * FROM (SELECT *, sum(len) OVER (PARTITION BY k, line) AS whole FROM num WHERE q = 0) WHERE whole >= 6)"


def lines(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    high = F.col("value") > 60
    x = F.when(high, 0.0).otherwise(F.lit(1.0) + (F.col("event_id") * 37 % 80).cast("double") / 10)
    y = F.when(high & (F.col("event_id") % 2 == 0), 0.0).otherwise(F.lit(1.0) + (F.col("event_id") * 91 % 80).cast("double") / 10)
    ring = e.select(F.col("user_id").alias("k"), F.col("event_id").alias("i"), x.alias("x"), y.alias("y"))
    return open_lines(ring, "k", "i", (0.0, 0.0, 10.0, 10.0), 6.0)


@query(f"WITH {_RING}, {_LINES} SELECT k, line::bigint AS line, count(*) AS segments, round(sum(len), 6) AS length FROM lines GROUP BY k, line")
def gr8_coast_lines(spark, d):
    return lines(spark, d).groupBy("k", "line").agg(F.count("*").alias("segments"), r6(F.sum("len")).alias("length"))


_BASE = """arc AS (SELECT k, line, x1, y1, x2, y2, len, sum(len) OVER o AS e, sum(x2 - x1) OVER n AS dx, sum(y2 - y1) OVER n AS dy FROM lines
    WINDOW o AS (PARTITION BY k, line ORDER BY i), n AS (PARTITION BY k, line ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    pts AS (SELECT *, e - len AS b, unnest(generate_series(ceil((e - len) / 2.5)::bigint, ceil(e / 2.5)::bigint - 1)) AS p FROM arc WHERE len > 0),
    base AS (SELECT k, line, p, x1 + (x2 - x1) * ((p * 2.5::double - b) / len) AS x, y1 + (y2 - y1) * ((p * 2.5::double - b) / len) AS y,
        CASE WHEN dx <> 0 OR dy <> 0 THEN -dy / sqrt(dx * dx + dy * dy) END AS nx, CASE WHEN dx <> 0 OR dy <> 0 THEN dx / sqrt(dx * dx + dy * dy) END AS ny FROM pts)"""
_VOTE = """wet AS (SELECT DISTINCT r, c FROM obs WHERE (r + 2 * c) % 3 = 0), side AS (SELECT k, line, p, x, y, nx, ny, (floor(y + 0.5 * ny)::int, floor(x + 0.5 * nx)::int) IN (SELECT (r, c) FROM wet) AS l, (floor(y - 0.5 * ny)::int, floor(x - 0.5 * nx)::int) IN (SELECT (r, c) FROM wet) AS rr FROM base),
    v AS (SELECT k, line, CASE WHEN count(CASE WHEN rr THEN 1 END) > count(CASE WHEN l THEN 1 END) THEN -1 ELSE 1 END AS sgn FROM side GROUP BY k, line)"""


def base_points(spark, d):
    s = lines(spark, d)
    wet = adapter(spark, d, "obs").where("(r + 2 * c) % 3 = 0").select("r", "c")
    return seaward(baseline(s, ["k", "line"], 2.5), ["k", "line"], wet, 0.5, 1.0)


@query(f"WITH {OBS}, {_RING}, {_LINES}, {_BASE}, {_VOTE} SELECT side.k AS k, side.line::bigint AS line, p, round(x, 4) AS x, round(y, 4) AS y, round(nx * sgn, 4) + 0 AS nx, round(ny * sgn, 4) + 0 AS ny FROM side JOIN v ON side.k = v.k AND side.line = v.line")
def gr9_baseline(spark, d):
    b = base_points(spark, d)
    return b.select("k", "line", "p", *((F.round(c, 4) + 0).alias(c) for c in ("x", "y", "nx", "ny")))


_TRAN = "tr AS (SELECT s_suppkey AS t, (s_suppkey % 9)::double AS x, (s_suppkey * 7 % 10)::double / 2 AS y, 0.6::double AS nx, 0.8::double AS ny FROM supplier)"
_SHORE = "shore AS (SELECT o_orderkey % 3 AS epoch, (o_orderkey * 37 % 97)::double / 10 AS x1, (o_orderkey * 53 % 89)::double / 10 AS y1, (o_orderkey * 37 % 97)::double / 10 + 0.4 AS x2, (o_orderkey * 53 % 89)::double / 10 - 0.3 AS y2 FROM orders)"


@query(f"WITH {_TRAN}, {_SHORE}, h AS (SELECT t, epoch, nx * (y2 - y1) - ny * (x2 - x1) AS det, ((x1 - x) * (y2 - y1) - (y1 - y) * (x2 - x1)) AS a, ((x1 - x) * ny - (y1 - y) * nx) AS b FROM tr, shore) SELECT t, epoch, round(max(a / det), 6) AS distance FROM h WHERE det <> 0 AND a / det >= 0 AND a / det <= 5 AND b / det >= 0 AND b / det <= 1 GROUP BY t, epoch")
def su12_transect_crossings(spark, d):
    """Distances of the seaward-most crossing of each transect and epoch; the shorelines are short test strokes."""
    t = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("t"), (F.col("s_suppkey") % 9).cast("double").alias("x"), ((F.col("s_suppkey") * 7 % 10).cast("double") / 2).alias("y"), F.lit(0.6).alias("nx"), F.lit(0.8).alias("ny"))
    o = spark.read.parquet(f"{d}/orders.parquet")
    x, y = (F.col("o_orderkey") * 37 % 97).cast("double") / 10, (F.col("o_orderkey") * 53 % 89).cast("double") / 10
    s = o.select((F.col("o_orderkey") % 3).alias("epoch"), x.alias("x1"), y.alias("y1"), (x + 0.4).alias("x2"), (y - 0.3).alias("y2"))
    return crossings(t, "t", s, "epoch", 5.0, 2.0).withColumn("distance", r6(F.col("distance")))


@query(f"WITH {OBS}, {COUNTS}, k AS (SELECT r, c, (v >= 152)::int AS v FROM v), h AS (SELECT a.r AS r, a.c AS c, max(b.v) AS v FROM k a JOIN k b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c) SELECT a.r AS r, a.c AS c FROM h a JOIN h b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c HAVING min(b.v) = 1")
def gr11_closed(spark, d):
    return closed(counts(spark, d).withColumn("v", (F.col("v") >= 152).cast("int")), "v").where("v = 1").select("r", "c")


@query(f"WITH RECURSIVE {OBS}, {COUNTS}, o AS (SELECT r, c FROM v WHERE v < 152), sea AS (SELECT r, c FROM o WHERE r IN (0, 19) OR c IN (0, 19) UNION SELECT w.r, w.c FROM sea s JOIN o w ON abs(w.r - s.r) + abs(w.c - s.c) = 1) SELECT r, c FROM v WHERE (r, c) NOT IN (SELECT (r, c) FROM sea)")
def gr11_filled(spark, d):
    return filled(mask(spark, d), counts(spark, d), 20, 20)


@query(f"WITH RECURSIVE {OBS}, {COUNTS}, {_MASK}, {_LABEL.format(near=_NEAR8)}, n AS (SELECT root, count(*) AS n FROM root JOIN m ON m.id = root.id WHERE sqrt(power(r - 10, 2) + power(c - 10, 2)) <= 5 GROUP BY root) SELECT r, c FROM m JOIN root ON m.id = root.id WHERE root = (SELECT arg_max(root, (n, -root)) FROM n)")
def gr10_central_region(spark, d):
    return central_region(mask(spark, d), 10, 10, 5)


_SEA = "w AS (SELECT r, c, r * 100 + c AS id FROM (SELECT r, c, 10 * log10(avg(vv)) AS db FROM obs WHERE vv > 0 GROUP BY r, c) WHERE db < -13.2), sea AS (SELECT id, r, c FROM w WHERE r IN (0, 19) OR c IN (0, 19) UNION SELECT x.id, x.r, x.c FROM sea s JOIN w x ON abs(x.r - s.r) + abs(x.c - s.c) = 1), land AS (SELECT r, c FROM (SELECT DISTINCT r, c FROM obs) WHERE (r, c) NOT IN (SELECT (r, c) FROM sea))"


@query(f"WITH RECURSIVE {OBS}, {_SEA} SELECT (SELECT count(*) FROM sea)::double * 10 * 10 AS sea, (SELECT count(*) FROM land)::double * 10 * 10 AS land, (SELECT count(*) FROM sea s JOIN land l ON abs(l.r - s.r) + abs(l.c - s.c) = 1)::double * 10 AS length")
def su11_radar_shore(spark, d):
    """Sea is dark water that reaches the frame; areas of sea and land, and the length of the shore, for cells of 10 m."""
    o = adapter(spark, d, "obs")
    db = o.where("vv > 0").groupBy("r", "c").agg((10 * F.log10(F.avg("vv"))).alias("db"))
    sea = border_regions(db.where("db < -13.2").select("r", "c"), 20, 20, ROOK)
    return shore_length(sea, o.select("r", "c").distinct().join(sea, ["r", "c"], "left_anti"), 10.0)


# --- access

_PEOPLE = "homes AS (SELECT p_partkey AS node, p_size AS people FROM part)"


def near_stops(spark, d):
    stops = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey % 10 = 0").select((-1 - F.col("s_suppkey")).cast("long").alias("node"))
    return distances(adapter(spark, d, "edge"), stops, 6.0)


@query(f"WITH {EDGE}, {_BOTH}, d0 AS (SELECT DISTINCT (-1 - s_suppkey)::bigint AS node, 0::double AS dist FROM supplier WHERE s_suppkey % 10 = 0), {_ROUNDS}, {_PEOPLE}, j AS (SELECT people, dist FROM homes LEFT JOIN d6 ON d6.node = homes.node), t AS (SELECT unnest([2, 4, 6])::double AS threshold) SELECT threshold, sum(CASE WHEN dist <= threshold THEN people ELSE 0 END)::bigint AS served, sum(people)::bigint AS people, round(100 * sum(CASE WHEN dist <= threshold THEN people ELSE 0 END) / sum(people), 6) AS pct FROM j, t GROUP BY threshold")
def ch35_served_shares(spark, d):
    """Share of people within several distances of a stop along the network."""
    homes = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("people"))
    out = served_shares(homes, near_stops(spark, d), "people", (2.0, 4.0, 6.0))
    return out.withColumn("pct", r6(F.col("pct")))


@query(f"WITH {EDGE}, {_BOTH}, d0 AS (SELECT DISTINCT (-1 - s_suppkey)::bigint AS node, 0::double AS dist FROM supplier WHERE s_suppkey % 10 = 0), {_ROUNDS} SELECT (a.dist <= 4 AND b.dist <= 4) IS TRUE AS served, count(*) AS edges, round(sum(len), 6) AS length FROM e LEFT JOIN d6 a ON a.node = e.a LEFT JOIN d6 b ON b.node = e.b WHERE e.a <> e.b GROUP BY 1")
def su22_served_edges(spark, d):
    """Edges with both ends within reach of a stop, and the others."""
    edges = undirected(adapter(spark, d, "edge")).where("src < dst")
    return served_edges(edges, near_stops(spark, d), 4.0).groupBy("served").agg(F.count("*").alias("edges"), r6(F.sum("len")).alias("length"))


@query(f"WITH {POINT}, b AS (SELECT min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM point WHERE conf >= 90) SELECT round(w - 1.5::double / (111.32::double * cos(radians((s + n) / 2))), 6) AS w, round(s - 1.5::double / 110.57::double, 6) AS s, round(e + 1.5::double / (111.32::double * cos(radians((s + n) / 2))), 6) AS e, round(n + 1.5::double / 110.57::double, 6) AS n FROM b")
def su22_auto_box(spark, d):
    """The area of a boundary's points with 1.5 km around it."""
    b = auto_box(adapter(spark, d, "point").where("conf >= 90"), "lon", "lat", 1.5)
    return b.select(*(r6(F.col(k)).alias(k) for k in "wsen"))
