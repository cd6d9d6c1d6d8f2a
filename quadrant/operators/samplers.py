"""Samples: simple random, stratified, spatial coverage, equal-area coverage, composite."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.functions.distance import planar_sq
from quadrant.functions.ranks import ranked
from quadrant.functions.rng import uniform
from quadrant.operators.strata import Strata, stratify
from quadrant.sources.areas import Area, trapezoids
from quadrant.sources.shared import written

LABELS = {"simple_random": "Simple random sampling", "stratified_random": "Stratified random sampling", "coverage": "Spatial coverage sampling", "coverage_equal_area": "Spatial coverage sampling, equal area", "composite": "Composite sampling", "maxvol": "D-optimal sampling"}


@dataclass(frozen=True)
class Samples:
    """samples: sample_id, x, y and what the method adds."""

    samples: DataFrame
    method: str
    n_samples: int
    strata: Strata | None = None
    facts: dict = field(default_factory=dict)

    def __repr__(self) -> str:
        more = "" if self.strata is None else f"\n  strata: {self.strata.n_strata}"
        return f"{LABELS[self.method]}\n  samples: {self.n_samples}{more}" + "".join(f"\n  {k}: {v}" for k, v in self.facts.items())

    def summary(self) -> str:
        """repr, the ranges of coordinates, how many samples are prior points, and the ranges of features that chose them."""
        prior = [F.sum(F.col("is_prior").cast("int")).alias("p")] if "is_prior" in self.samples.columns else []
        features = self.facts.get("features", "").split(", ") if self.method == "maxvol" else []
        ranges = [f(F.col("`" + c.replace("`", "``") + "`")).alias(f"f{k}{e}") for k, c in enumerate(features) for e, f in (("a", F.min), ("b", F.max))]
        r = self.samples.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"), *prior, *ranges).first()
        out = f"{self!r}\n  x: {r.a:.2f} - {r.b:.2f}\n  y: {r.c:.2f} - {r.d:.2f}" + (f"\n  prior points: {r.p}" if prior else "")
        return out + "".join(f"\n  {c}: {r[f'f{k}a']:.2f} - {r[f'f{k}b']:.2f}" for k, c in enumerate(features))


def simple_random(spark: SparkSession, area: Area, n: int, seed: int = 1) -> Samples:
    """n points uniform over the area, on the sphere by its area there, however thin it is: none is drawn in vain.

    A point draws one of the area's trapezoids by size, a height in it by the width there, and a place between its sides.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    parts = trapezoids(area)
    sizes = [t.size(area.longlat) for t in parts]
    total, ends = sum(sizes), []
    if not total > 0:
        raise ValueError("the area has no extent")
    for size in sizes:
        ends.append((ends[-1] if ends else 0.0) + size)
    # of few trapezoids an array to search, of an outline's many as well: its size is that of the outline
    table = F.array(*[F.struct(F.lit(e / total).alias("end"), *[F.lit(float(v)).alias(k) for k, v in vars(t).items()]) for e, t in zip(ends, parts, strict=True)])
    u, v, w = (uniform(seed, F.lit(k), "id") for k in ("part", "y", "x"))
    rows = spark.range(1, n + 1).select("id", v.alias("v"), w.alias("w"), F.coalesce(F.filter(table, lambda t: t["end"] > u)[0], F.element_at(table, -1)).alias("t"))
    w0, w1, h = F.col("t.right0") - F.col("t.left0"), F.col("t.right1") - F.col("t.left1"), F.col("t.y1") - F.col("t.y0")
    if area.longlat:
        share = _share_on_sphere(w0, w1, F.col("t.y0"), h, F.col("v"))
    else:  # of (w0 + (w1 - w0) s / 2) s = v (w0 + w1) / 2, the root that holds for equal widths too
        share = F.col("v") * (w0 + w1) / (w0 + F.sqrt(w0 * w0 + F.col("v") * (w1 * w1 - w0 * w0)))
    left, right = F.col("t.left0") + (F.col("t.left1") - F.col("t.left0")) * F.col("s"), F.col("t.right0") + (F.col("t.right1") - F.col("t.right0")) * F.col("s")
    out = rows.withColumn("s", share).select(F.col("id").cast("int").alias("sample_id"), (left + F.col("w") * (right - left)).alias("x"), (F.col("t.y0") + F.col("s") * h).alias("y"))
    return Samples(out, "simple_random", n)


def _share_on_sphere(w0: Column, w1: Column, y0: Column, h: Column, v: Column) -> Column:
    """The share of the height h below which the share v of a trapezoid's spherical area lies, by 50 halvings."""
    slope = (w1 - w0) / h
    part = lambda s: (w0 + slope * s * h) * F.sin(F.radians(y0 + s * h)) + F.degrees(slope * F.cos(F.radians(y0 + s * h)))
    goal = part(F.lit(0.0)) + v * (part(F.lit(1.0)) - part(F.lit(0.0)))
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), goal.alias("goal"))

    def halve(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        below = part(mid) < a["goal"]
        return F.struct(F.when(below, mid).otherwise(a["lo"]).alias("lo"), F.when(below, a["hi"]).otherwise(mid).alias("hi"), a["goal"].alias("goal"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(50)), start, halve, lambda a: a["lo"])


def draw(cells: DataFrame, n_per_stratum: int, seed: int, cell_size: tuple[float, float] | None = None) -> DataFrame:
    """stratum_id, draw (from 1), cell_id, x, y: n cells a stratum with replacement, each moved within its cell.

    A draw picks a rank among its stratum's cells, so draws and cells meet in an equi-join; strata without cells give
    none. Points may leave the area by half a cell at its edge, as cells do.
    """
    places = ranked(cells.select("stratum_id", "cell_id", "x", "y"), ["cell_id"], ["stratum_id"])
    sizes = places.groupBy("stratum_id").agg(F.count(F.lit(1)).alias("n"))
    draws = sizes.select("stratum_id", "n", F.explode(F.sequence(F.lit(1), F.lit(n_per_stratum))).alias("draw"))
    pick = F.floor(uniform(seed, F.lit("cell"), "stratum_id", "draw") * F.col("n")).cast("long")
    x, y = F.col("x"), F.col("y")
    if cell_size is not None:
        x = x + (uniform(seed, F.lit("dx"), "stratum_id", "draw") - 0.5) * F.lit(float(cell_size[0]))
        y = y + (uniform(seed, F.lit("dy"), "stratum_id", "draw") - 0.5) * F.lit(float(cell_size[1]))
    return draws.select("stratum_id", "draw", pick.alias("rank")).join(places, ["stratum_id", "rank"]).select("stratum_id", "draw", "cell_id", x.alias("x"), y.alias("y"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with sample_id, from 1, in that order. They are written first, as ranking reads them twice, and each time the cells they come from."""
    return ranked(written(rows, "numbered"), order, rank="sample_id").withColumn("sample_id", (F.col("sample_id") + 1).cast("int"))


def stratified(strata: Strata, n_per_stratum: int = 1, seed: int = 1) -> Samples:
    """n_per_stratum points in each stratum, numbered by stratum and draw."""
    if not isinstance(strata, Strata):
        raise TypeError("stratified sampling takes Strata")
    if n_per_stratum < 1:
        raise ValueError("n_per_stratum must be at least 1")
    drawn = draw(strata.cells, n_per_stratum, seed, strata.cell_size)
    out = numbered(drawn, ["stratum_id", "draw"]).select("stratum_id", "sample_id", "x", "y")
    return Samples(out, "stratified_random", out.count(), strata)


def relocate(cells: DataFrame, centroids: DataFrame, cell_size: tuple[float, float] | None) -> DataFrame:
    """stratum_id, x, y: centroids, each moved to its nearest own cell where that is more than a cell's diagonal away."""
    if cell_size is None:
        return centroids.select("stratum_id", "x", "y")
    c = centroids.select("stratum_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    d2 = planar_sq(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))
    near = cells.select("stratum_id", "cell_id", "x", "y").join(c, "stratum_id").groupBy("stratum_id").agg(F.min(F.struct(d2.alias("d2"), "cell_id", "x", "y")).alias("near"))
    far = F.sqrt("near.d2") > F.lit(math.hypot(*cell_size))
    return c.join(near, "stratum_id", "left").select("stratum_id", F.when(far, F.col("near.x")).otherwise(F.col("cx")).alias("x"), F.when(far, F.col("near.y")).otherwise(F.col("cy")).alias("y"))


def coverage(spark: SparkSession, where, n_strata: int | None = None, priors=None, n_try: int = 1, n_cells: int = 2500, seed: int = 1, **more) -> Samples:
    """One point a stratum, its centroid; prior points are the first samples, as they are."""
    if isinstance(where, Strata):
        strata = where
    else:
        if n_strata is None:
            raise ValueError("n_strata is needed to stratify an area")
        strata = stratify(spark, where, n_strata, priors, n_try=n_try, n_cells=n_cells, seed=seed, **more)
    moved = relocate(strata.cells, strata.centroids, strata.cell_size)
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(strata.priors, 1)]
    prior = spark.createDataFrame(rows, "stratum_id int, px double, py double")
    both = moved.join(prior, "stratum_id", "left")
    out = numbered(both, ["stratum_id"]).select("sample_id", "stratum_id", F.col("px").isNotNull().alias("is_prior"), F.coalesce("px", "x").alias("x"), F.coalesce("py", "y").alias("y"))
    return Samples(out, "coverage", strata.n_strata, strata)


def coverage_equal_area(spark: SparkSession, where, n_strata: int, n_try: int = 1, n_cells: int = 2500, seed: int = 1) -> Samples:
    """coverage() of strata of equal size."""
    strata = stratify(spark, where, n_strata, n_try=n_try, n_cells=n_cells, seed=seed, equal_area=True)
    return replace(coverage(spark, strata), method="coverage_equal_area")


def composite(spark: SparkSession, where, n_strata: int | None = None, n_composites: int = 1, n_try: int = 1, n_cells: int = 2500, seed: int = 1) -> Samples:
    """n_composites points a stratum of equal-area strata; composite c takes the c-th draw of every stratum."""
    if n_composites < 1:
        raise ValueError("n_composites must be at least 1")
    if isinstance(where, Strata):
        strata = where
        if not strata.equal_area:
            raise ValueError("composite sampling needs equal-area strata")
    else:
        if n_strata is None:
            raise ValueError("n_strata is needed to stratify an area")
        strata = stratify(spark, where, n_strata, n_try=n_try, n_cells=n_cells, seed=seed, equal_area=True)
    drawn = draw(strata.cells, n_composites, seed, strata.cell_size)
    out = numbered(drawn, ["stratum_id", "draw"]).select("stratum_id", "sample_id", "x", "y", F.col("draw").alias("composite"))
    return Samples(out, "composite", out.count(), strata, {"composites": n_composites})
