"""The nearest of many centers for each of many points, by descending a quadtree of the centers.

The tree is a table a level: a square's count of centers, and one of them. Points start at the root, and at each level every
square still open for a point opens those of its four quarters that hold centers. The center that a square names bounds the
distance from above, the square's border from below, so squares that are farther than the nearest named center are dropped.
A few squares a point remain at each level, however the centers are spread, and a square of one center is not opened any
more. Squares meet their quarters in an equi-join; what is shuffled is a few rows a point and level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrant.functions.distance import planar_sq
from quadrant.sources.shared import written

#: Halvings of the extent at most, by which doubles are taken apart; squares of a level up to this many are broadcast.
DEEPEST, MOST_BROADCAST = 48, 200_000
#: By this share a lower bound is taken too low, for rounding.
SLACK = 1e-9


def _quarters(centers: DataFrame, low: tuple[float, float], extent: float, level: int) -> DataFrame:
    """cx, cy, n and the center of least stratum_id of each square of a level; and px, py, its parent."""
    side = extent / 2.0**level
    at = [F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(side)).cast("long"), F.lit(2**level - 1)).alias("c" + c) for c, lo in zip(("x", "y"), low, strict=True)]
    found = centers.select("stratum_id", "x", "y", *at).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("stratum_id", "x", "y")).alias("c"))
    return found.select("cx", "cy", "n", F.col("c.stratum_id").alias("k"), F.col("c.x").alias("kx"), F.col("c.y").alias("ky"), F.shiftright("cx", 1).alias("px"), F.shiftright("cy", 1).alias("py"))


def nearest(points: DataFrame, centers: DataFrame) -> DataFrame:
    """cell_id, stratum_id, d2 of the nearest of centers (stratum_id, x, y) for each of points (cell_id, x, y), ties to the
    smaller stratum_id, by planar distance.

    Points and centers with null or non-finite coordinates take no part; of centers in one place the first stays. cell_id
    must tell points apart. No centers: no rows.
    """
    finite = "abs(x) < double('Infinity') AND abs(y) < double('Infinity')"
    known = lambda df, key: df.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(finite)
    centers = written(known(centers, "stratum_id").groupBy("x", "y").agg(F.min("stratum_id").alias("stratum_id")), "nearest-centers")
    r = centers.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(c + str(k)) for c in ("x", "y") for k, f in enumerate((F.min, F.max))]).first()
    points = known(points, "cell_id")
    if not r.n:
        return points.select("cell_id", F.lit(None).cast(centers.schema["stratum_id"].dataType).alias("stratum_id"), F.lit(0.0).alias("d2")).limit(0)
    low, extent = (r.x0, r.y0), max(r.x1 - r.x0, r.y1 - r.y0) or 1.0
    d2 = lambda x, y: planar_sq(F.col("x"), F.col("y"), x, y)
    root = _quarters(centers, low, extent, 0).first()  # one row
    open_ = points.select("cell_id", "x", "y", *[F.lit(v).alias(c) for c, v in (("cx", 0), ("cy", 0))], F.lit(root.n).alias("n"), F.lit(root.k).alias("k"), d2(F.lit(root.kx), F.lit(root.ky)).alias("d2"))
    kinds = {"cx": "long", "cy": "long", "n": "long", "k": centers.schema["stratum_id"].dataType}
    open_ = written(open_.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()}), "nearest-open")
    for level in range(1, DEEPEST + 1):
        split = open_.where("n > 1")
        if not split.limit(1).count():
            break
        squares = written(_quarters(centers, low, extent, level), "nearest-squares")
        squares = F.broadcast(squares) if squares.count() <= MOST_BROADCAST else squares
        side = extent / 2.0**level
        parents = split.select("cell_id", "x", "y", F.col("cx").alias("px"), F.col("cy").alias("py"))
        opened = parents.join(squares, ["px", "py"]).select("cell_id", "x", "y", "cx", "cy", "n", "k", d2(F.col("kx"), F.col("ky")).alias("d2"))
        both = opened.withColumn("fresh", F.lit(True)).unionByName(open_.where("n = 1").withColumn("fresh", F.lit(False)))
        bound = both.groupBy("cell_id").agg(F.min("d2").alias("bound"))
        both = both.join(bound, "cell_id")
        gap = _gap(low, side)
        # a center on its own is kept while it may be the nearest; a square while its border is no farther than that
        keep = F.when(F.col("n") == 1, F.col("d2") <= F.col("bound")).otherwise(gap * (1 - SLACK) <= F.col("bound"))
        open_ = written(both.where(keep).select("cell_id", "x", "y", "cx", "cy", "n", "k", "d2"), "nearest-open")
    best = open_.groupBy("cell_id").agg(F.min(F.struct("d2", "k")).alias("b"))
    return best.select("cell_id", F.col("b.k").alias("stratum_id"), "b.d2")


def _gap(low: tuple[float, float], side: float) -> Column:
    """Squared distance of a point to its square."""
    def away(c: str, lo: float) -> Column:
        start = F.lit(lo) + F.col("c" + c) * F.lit(side)
        return F.greatest(start - F.col(c), F.col(c) - start - F.lit(side), F.lit(0.0))

    x, y = away("x", low[0]), away("y", low[1])
    return x * x + y * y
