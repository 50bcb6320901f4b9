"""Lines out of loose pieces: list ranking by pointer doubling, and contours as whole lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def ranked(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, line, position, closed) of links (u, v) that form chains: no u and no v occurs twice.

    line: the first u of an open chain, the least u of a closed one; position: from 0 along the chain, a closed one starting at
    its least u. Each round doubles the stretch that every link knows ahead of it, so the longest chain of n links takes log2(n)
    rounds of one join on unique keys, each a written table.
    """
    starts = links.select(F.col("u").alias("_u"))
    state = links.join(starts, F.col("v") == F.col("_u"), "left")
    # next: the link that follows the known stretch, NULL past an open end; steps: links in it; last: its last link if it ends there;
    # least, ahead: the least link of the stretch and how far ahead it lies
    state = state.select("u", F.col("_u").alias("next"), F.lit(1).cast("long").alias("steps"), F.when(F.col("_u").isNull(), F.col("u")).alias("last"), F.col("u").alias("least"), F.lit(0).cast("long").alias("ahead"))
    state = written(state)
    reach, before = 1, -1
    for _ in range(rounds):
        left = state.where("next IS NOT NULL").count()
        # every open chain that isn't settled loses links in a round, so what is left unchanged is closed, and no chain is longer than all of it
        if not left or left == before and left <= reach:
            break
        before = left
        t = state.select(*(F.col(c).alias(f"_{c}") for c in state.columns))
        nearer = F.col("_least") < F.col("least")
        joined = state.join(t, F.col("next") == F.col("_u"), "left")
        more = F.col("_u").isNotNull()
        state = written(
            joined.select(
                "u",
                F.col("_next").alias("next"),
                (F.col("steps") + F.when(more, F.col("_steps")).otherwise(0)).alias("steps"),
                F.coalesce("last", "_last").alias("last"),
                F.when(more & nearer, F.col("_least")).otherwise(F.col("least")).alias("least"),
                F.when(more & nearer, F.col("steps") + F.col("_ahead")).otherwise(F.col("ahead")).alias("ahead"),
            )
        )
        reach *= 2
    else:
        raise RuntimeError(f"chains did not settle in {rounds} rounds")
    open_, loops = state.where("next IS NULL"), state.where("next IS NOT NULL")
    heads = open_.groupBy("last").agg(F.max("steps").alias("n"), F.max_by("u", "steps").alias("line"))
    sizes = loops.groupBy("least").agg(F.count("*").alias("n"))
    whole = open_.join(heads, "last").select("u", "line", (F.col("n") - F.col("steps")).alias("position"), F.lit(False).alias("closed"))
    rings = loops.join(sizes, "least").select("u", F.col("least").alias("line"), ((F.col("n") - F.col("ahead")) % F.col("n")).alias("position"), F.lit(True).alias("closed"))
    return whole.union(rings)


def oriented_contour(cells: DataFrame, value: str, level: float) -> DataFrame:
    """(u, v, r, c, x1, y1, x2, y2): segments of a contour as `paths.contour` has them, all with the higher side on the same hand. u and v
    number the sides of the square that a segment starts and ends on, which neighbouring squares share."""
    right, down = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    beside = lambda x: F.when(F.lead("c").over(right) == F.col("c") + 1, F.lead(x).over(right))
    below = lambda x: F.when(F.lead("r").over(down) == F.col("r") + 1, F.lead(x).over(down))
    q = cells.select("r", "c", F.col(value).alias("a")).withColumns({"b": beside("a"), "d": below("a")}).withColumn("e", below("b"))
    q = q.where("a IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL AND e IS NOT NULL")
    a, b, d, e, r, c = (F.col(k) for k in ("a", "b", "d", "e", "r", "c"))
    along = lambda p, s: F.try_divide(level - p, s - p)
    number = lambda r, c, kind: (r.cast("long") * (1 << 31) + c.cast("long")) * 2 + kind
    side = lambda x, y, at: F.struct(at.alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    top, bottom = side(c + along(a, b), r, number(r, c, 0)), side(c + along(d, e), r + 1, number(r + 1, c, 0))
    left, far = side(c, r + along(a, d), number(r, c, 1)), side(c + 1, r + along(b, e), number(r, c + 1, 1))
    case = (a > level).cast("int") + (b > level).cast("int") * 2 + (e > level).cast("int") * 4 + (d > level).cast("int") * 8
    way = lambda *pairs: F.array(*(F.struct(p.alias("p"), s.alias("s")) for p, s in pairs))
    # a corner alone on the high side is cut off clockwise (left, top, far, bottom), one alone on the low side against it
    ways = {1: [(left, top)], 2: [(top, far)], 4: [(far, bottom)], 8: [(bottom, left)], 3: [(left, far)], 6: [(top, bottom)], 12: [(far, left)], 9: [(bottom, top)]}
    ways |= {15 - k: [(s, p) for p, s in ways[k]] for k in (1, 2, 4, 8)}
    high = (a + b + d + e) / 4 > level
    lines = F.when(case == 5, F.when(high, way(*ways[13], *ways[7])).otherwise(way(*ways[1], *ways[4])))
    lines = lines.when(case == 10, F.when(high, way(*ways[14], *ways[11])).otherwise(way(*ways[2], *ways[8])))
    for k, pairs in ways.items():
        lines = lines.when(case == k, way(*pairs))
    out = q.select("r", "c", F.explode(lines).alias("l"))
    return out.select(F.col("l.p.id").alias("u"), F.col("l.s.id").alias("v"), "r", "c", F.col("l.p.x").alias("x1"), F.col("l.p.y").alias("y1"), F.col("l.s.x").alias("x2"), F.col("l.s.y").alias("y2"))


def contour_lines(cells: DataFrame, value: str, level: float, least: float = 0.0, length: Column | None = None, band: DataFrame | None = None) -> DataFrame:
    """(line, position, closed, x1, y1, x2, y2, len, whole): contours as lines, their segments in order, without lines whose whole
    length is under `least`.

    length: of a segment, from x1, y1, x2 and y2 (cell units unless given: haversine_km of scaled ends gives km). band: cells (r, c) that
    both ends of a segment must be nearest to; a line that leaves them ends there.
    """
    segments = oriented_contour(cells, value, level).drop("r", "c")
    if band is not None:
        near = band.select("r", "c").distinct()
        for k in "12":
            end = near.select(F.col("r").alias("_r"), F.col("c").alias("_c"))
            met = (F.bround(f"y{k}").cast("int") == F.col("_r")) & (F.bround(f"x{k}").cast("int") == F.col("_c"))
            segments = segments.join(end, met, "left_semi")
    segments = written(segments.withColumn("len", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) if length is None else length))
    lines = segments.drop("v").join(ranked(segments.select("u", "v")), "u").drop("u")
    sums = lines.groupBy("line").agg(F.sum("len").alias("whole"))
    return lines.join(sums.where(F.col("whole") >= least), "line").select("line", "position", "closed", "x1", "y1", "x2", "y2", "len", "whole")
