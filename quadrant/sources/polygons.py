"""Which of many polygons points lie in, by a cover of squares.

Each polygon is covered by squares, at first about as large as itself, that are quartered while more than MOST_EDGES of its edges meet one. Squares that no edge
meets lie in or out as a whole, which their middle decides once; points in those that lie in are done by an equi-join. Only
points in squares that edges meet are tested against edges, those of the polygon at their height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrant.sources.shared import written

#: Edges that a square of the cover may have, quarterings at most, and strips by height of a polygon; the deepest level that one starts at.
MOST_EDGES, DEEPEST, STRIPS, MOST_START = 6, 12, 256, 30
#: Squares of a cover up to this many are broadcast.
MOST_BROADCAST = 200_000


def edges_of(rings: DataFrame) -> DataFrame:
    """poly_id, ax, ay, bx, by of rings (poly_id, ring_id, seq, x, y), each closed; edges without length are left out."""
    ring = Window.partitionBy("poly_id", "ring_id").orderBy("seq")  # an outline, not data
    ahead = [F.coalesce(F.lead(c).over(ring), F.first(c).over(ring)).cast("double").alias(n) for c, n in (("x", "bx"), ("y", "by"))]
    return rings.select("poly_id", F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay"), *ahead).where("ax <> bx OR ay <> by")


def _strips(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges by the strips of their polygon that they span, and the polygons' bounds."""
    bounds = edges.groupBy("poly_id").agg(F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1"), F.least(F.count(F.lit(1)), F.lit(STRIPS)).alias("strips"))
    bounds = written(bounds, "polygon-bounds")
    met = edges.join(bounds, "poly_id")
    # one strip more on either side, for points whose strip is rounded the other way
    span = F.sequence(_strip(F.least("ay", "by")) - 1, _strip(F.greatest("ay", "by")) + 1)
    return written(met.select("poly_id", "ax", "ay", "bx", "by", F.explode(span).alias("strip")), "polygon-strips"), bounds


def _strip(y: Column) -> Column:
    height = (F.col("y1") - F.col("y0")) / F.col("strips")
    return F.when(height > 0, F.least(F.greatest(F.floor((y - F.col("y0")) / height), F.lit(0)), F.col("strips") - 1)).otherwise(F.lit(0)).cast("int")


def _tested(candidates: DataFrame, strips: DataFrame, bounds: DataFrame, key: list[str]) -> DataFrame:
    """The rows of candidates (key, poly_id, x, y) in their polygon: an odd number of its edges to the right, or on one."""
    c = candidates.join(bounds, "poly_id").withColumn("strip", _strip(F.col("y"))).select(*key, "poly_id", "x", "y", "strip")
    x, y, ax, ay, bx, by = (F.col(n) for n in ("x", "y", "ax", "ay", "bx", "by"))
    turn = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    on = (turn == 0) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))
    spans = (ay > y) != (by > y)
    crosses = spans & (x < (bx - ax) * (y - ay) / F.when(by != ay, by - ay).otherwise(1.0) + ax)
    met = c.join(strips, ["poly_id", "strip"]).where(on | spans)
    return met.groupBy(*key, "poly_id").agg(F.max(on.cast("int")).alias("on"), (F.count_if(crosses) % 2).alias("odd")).where("on = 1 OR odd = 1").select(*key, "poly_id")


def cover(edges: DataFrame) -> tuple[DataFrame, tuple[float, float, float]]:
    """poly_id, level, cx, cy, whole: the squares that meet each polygon, or lie in it if whole; and the lattice's corner and side."""
    strips, bounds = _strips(edges)
    r = bounds.agg(F.min("x0").alias("x"), F.min("y0").alias("y"), F.max("x1").alias("xx"), F.max("y1").alias("yy")).first()
    low, extent = (r.x, r.y), max(r.xx - r.x, r.yy - r.y) or 1.0
    # a polygon starts with squares about as large as itself, which are four at most
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    first = F.when(size > 0, F.least(F.floor(F.log2(F.lit(extent) / size)), F.lit(MOST_START))).otherwise(F.lit(MOST_START)).cast("int")
    start = bounds.select("poly_id", first.alias("first"), "x0", "y0", "x1", "y1")
    cells = lambda c, lo: F.sequence(*[F.floor((F.col(f"{c}{k}") - lo) / (F.lit(extent) / F.pow(F.lit(2.0), "first"))).cast("long") for k in (0, 1)])
    start = start.select("poly_id", "first", F.explode(cells("x", low[0])).alias("cx"), cells("y", low[1]).alias("cys")).select("poly_id", "first", "cx", F.explode("cys").alias("cy"))
    start = written(start, "cover-start")
    pending = sorted(r["first"] for r in start.select("first").distinct().collect())
    shapes = edges.select("poly_id", F.struct("ax", "ay", "bx", "by").alias("e"))
    found, whole, full, e, level = None, None, None, None, pending[0]
    while True:
        if full is None:
            level = next(k for k in pending if k >= level)
        side = extent / 2.0**level
        free = None
        if full is not None:
            quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("q")
            free = full.select("poly_id", "first", F.col("cx").alias("px"), F.col("cy").alias("py"), quarter).select("poly_id", "first", "px", "py", (F.col("px") * 2 + F.col("q.i")).alias("cx"), (F.col("py") * 2 + F.col("q.j")).alias("cy"))
            met = free.join(e.select("poly_id", F.col("cx").alias("px"), F.col("cy").alias("py"), "e"), ["poly_id", "px", "py"]).select("poly_id", "first", "cx", "cy", "e")
            free = free.select("poly_id", "first", "cx", "cy")
        if level in pending:
            new = start.where(F.col("first") == level)
            fresh = new.join(shapes, "poly_id").select("poly_id", "first", "cx", "cy", "e")
            met, free = (fresh, new) if free is None else (met.unionByName(fresh), free.unionByName(new))
        e = written(met.where(_meets(low, side)), "cover-edges")
        counts = e.groupBy("poly_id", "first", "cx", "cy").count().withColumn("split", (F.col("count") > MOST_EDGES) & (F.lit(level) < F.col("first") + DEEPEST))
        border = counts.where("NOT split").select("poly_id", F.lit(level).alias("level"), "cx", "cy")
        middle = [(F.lit(lo) + (F.col(c) + 0.5) * side).alias(n) for c, n, lo in (("cx", "x", low[0]), ("cy", "y", low[1]))]
        free = free.join(e, ["poly_id", "cx", "cy"], "left_anti").select("poly_id", "cx", "cy", *middle)
        inner = _tested(free, strips, bounds, ["cx", "cy"]).select("poly_id", F.lit(level).alias("level"), "cx", "cy")
        found, whole = (border, inner) if found is None else (found.unionByName(border), whole.unionByName(inner))
        full = written(counts.where("split").select("poly_id", "first", "cx", "cy"), "cover-full")
        more = full.limit(1).count()
        if not more and level >= pending[-1]:
            break
        full = full if more else None
        level += 1
    return written(found.withColumn("whole", F.lit(False)).unionByName(whole.withColumn("whole", F.lit(True))), "cover"), (*low, extent)


def _meets(low: tuple[float, float], side: float) -> Column:
    """Whether an edge may meet a square, which is taken a little larger: their bounds overlap, and not all corners lie on one side."""
    ax, ay, bx, by = (F.col(f"e.{c}") for c in ("ax", "ay", "bx", "by"))
    more = side * 1e-6
    x0, y0 = F.lit(low[0]) + F.col("cx") * side - more, F.lit(low[1]) + F.col("cy") * side - more
    x1, y1 = x0 + side + 2 * more, y0 + side + 2 * more
    turns = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (x0, x1) for y in (y0, y1)]
    return (F.greatest(ax, bx) >= x0) & (F.least(ax, bx) <= x1) & (F.greatest(ay, by) >= y0) & (F.least(ay, by) <= y1) & (F.least(*turns) <= 0) & (F.greatest(*turns) >= 0)


def locate(points: DataFrame, rings: DataFrame) -> DataFrame:
    """cell_id, poly_id: each of points (cell_id, x, y) with every polygon of rings (poly_id, ring_id, seq, x, y) it lies in,
    holes out, borders in. Points with null or non-finite coordinates lie in none; cell_id must tell points apart."""
    edges = written(edges_of(rings), "polygon-edges")
    if not edges.limit(1).count():
        return points.select("cell_id").join(rings.select("poly_id").limit(0), F.lit(False))
    strips, bounds = _strips(edges)
    squares, (x0, y0, extent) = cover(edges)
    levels = [r.level for r in squares.select("level").distinct().collect()]
    known = points.select("cell_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(F.col("x").between(x0, x0 + extent) & F.col("y").between(y0, y0 + extent))
    at = lambda c, lo, k: F.floor((F.col(c) - lo) / (extent / 2.0**k)).cast("long")
    places = F.array(*[F.struct(F.lit(k).alias("level"), at("x", x0, k).alias("cx"), at("y", y0, k).alias("cy")) for k in sorted(levels)])
    squares = F.broadcast(squares) if squares.count() <= MOST_BROADCAST else squares
    met = known.select("cell_id", "x", "y", F.explode(places).alias("p")).select("cell_id", "x", "y", "p.*").join(squares, ["level", "cx", "cy"])
    met = written(met.select("cell_id", "poly_id", "x", "y", "whole"), "polygon-met")
    border = _tested(met.where("NOT whole").select("cell_id", "poly_id", "x", "y"), strips, bounds, ["cell_id"])
    return met.where("whole").select("cell_id", "poly_id").unionByName(border)
