"""Points at least a distance apart, as many as fit: a maximal independent set found by rounds over a grid.

Cells have a diagonal of the distance, so two points of a cell are always too near, and only the first of each cell in
random order can be chosen in a round. Such firsts meet those of the 20 cells around; one that comes before all of those
too near is chosen, and what is too near to a chosen point goes. So however many points lie in one place, a round joins one
row a cell, and rounds grow with the logarithm of the number of cells.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrant.functions.distance import planar_sq
from quadrant.functions.rng import order_key
from quadrant.sources.shared import written

#: Chosen points of a round up to this many are broadcast.
MOST_BROADCAST = 500_000
AROUND = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4]


def _spread(rows: DataFrame, name: str) -> DataFrame:
    """Each row at every cell around its own, itself included."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AROUND])
    rows = rows.select("cx", "cy", F.struct("key", "loc_id", "x", "y").alias(name), F.explode(offsets).alias("o"))
    return rows.select((F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), name)


def spaced(points: DataFrame, min_dist: float, seed: int = 1) -> DataFrame:
    """Those rows of points (loc_id, x, y, ...), in seeded random order, of which no two are nearer than min_dist, and near to
    one of which each other row lies; with order_key, by which they were preferred, ties by loc_id.

    Rows with null or non-finite coordinates are left out. Of rows in one place one is chosen. No rows: none.
    """
    if not min_dist > 0:
        raise ValueError("min_dist must be positive")
    side = min_dist / math.sqrt(2.0)
    cell = lambda c: F.floor(F.col(c) / F.lit(side)).cast("long")
    known = points.select("loc_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("abs(x) < double('Infinity') AND abs(y) < double('Infinity')")
    left = written(known.select("loc_id", "x", "y", order_key(seed, "loc_id").alias("key"), cell("x").alias("cx"), cell("y").alias("cy")), "spaced-left")
    chosen, near = None, lambda a, b: planar_sq(F.col(f"{a}.x"), F.col(f"{a}.y"), F.col(f"{b}.x"), F.col(f"{b}.y")) < F.lit(float(min_dist) ** 2)
    while left.limit(1).count():
        firsts = written(left.groupBy("cx", "cy").agg(F.min(F.struct("key", "loc_id", "x", "y")).alias("p")).select("cx", "cy", "p.*"), "spaced-firsts")
        pairs = _spread(firsts, "q").join(firsts.select("cx", "cy", F.struct("key", "loc_id", "x", "y").alias("p")), ["cx", "cy"])
        beaten = pairs.where(near("p", "q") & (F.struct("q.key", "q.loc_id") < F.struct("p.key", "p.loc_id"))).select("p.key", "p.loc_id").distinct()
        won = written(firsts.join(beaten, ["key", "loc_id"], "left_anti").select("loc_id", "x", "y", "key", "cx", "cy"), "spaced-won")
        chosen = won if chosen is None else chosen.unionByName(won)
        at = _spread(won, "q").groupBy("cx", "cy").agg(F.collect_list("q").alias("qs"))  # a cell has one chosen point, so at most 21
        at = F.broadcast(at) if won.count() * len(AROUND) <= MOST_BROADCAST else at
        gone = F.exists(F.coalesce("qs", F.array()), lambda q: planar_sq(F.col("x"), F.col("y"), q["x"], q["y"]) < F.lit(float(min_dist) ** 2))
        left = written(left.join(at, ["cx", "cy"], "left").where(~gone).select("loc_id", "x", "y", "key", "cx", "cy"), "spaced-left")
    if chosen is None:
        return points.withColumn("order_key", F.lit("")).limit(0)
    return points.join(chosen.select("loc_id", F.col("key").alias("order_key")), "loc_id")
