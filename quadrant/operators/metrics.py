"""Quality of a stratification: coverage efficiency, distances to centroids, areas."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrant.functions.distance import distance_sq
from quadrant.functions.quantiles import medians
from quadrant.operators.strata import Strata


def stratum_counts(cells: DataFrame) -> DataFrame:
    """stratum_id, n_cells of the strata that have cells."""
    return cells.groupBy("stratum_id").agg(F.count(F.lit(1)).alias("n_cells"))


def efficiency_score(cv: Column, ratio: Column) -> Column:
    """Excellent, Good, Fair or Poor, by coefficient of variation and smallest-to-largest ratio, both unrounded."""
    grades = F.when(cv.isNull(), "Excellent").when((cv < 0.1) & (ratio > 0.9), "Excellent").when((cv < 0.2) & (ratio > 0.75), "Good")
    return grades.when((cv < 0.35) & (ratio > 0.5), "Fair").otherwise("Poor")


def gini(counts: DataFrame, value: str = "n_cells", by: str = "stratum_id") -> DataFrame:
    """One row: gini, 0 for equal values. counts has a row a stratum, so one window over it is small."""
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(value, by)))
    n, x = F.count(F.lit(1)), F.col(value)
    return ranked.agg((2 * F.sum(F.col("rank") * x) / (n * F.sum(x)) - (n + 1) / n).alias("gini"))


def coverage_efficiency(cells: DataFrame, n_strata: int | None = None, digits: int = 3) -> DataFrame:
    """One row of figures on how equal the strata of cells are; a NULL cv where there is one stratum."""
    counts = stratum_counts(cells)
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy("n_cells", "stratum_id")))
    n, x = F.count(F.lit(1)), F.col("n_cells")
    one = ranked.agg(n.alias("present"), F.sum(x).alias("total_cells"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min_cells"), F.max(x).alias("max_cells"), (2 * F.sum(F.col("rank") * x) / (n * F.sum(x)) - (n + 1) / n).alias("gini"))
    cv, ratio = F.col("sd") / F.col("mean"), F.col("min_cells") / F.col("max_cells")
    asked = F.col("present") if n_strata is None else F.lit(n_strata).cast("long")
    return one.select(
        asked.alias("n_strata"), "total_cells", F.bround("mean", digits).alias("mean_cells"), F.bround("sd", digits).alias("sd_cells"), F.bround(cv, digits).alias("cv"),
        "min_cells", "max_cells", (F.col("max_cells") - F.col("min_cells")).alias("range_cells"), F.bround(ratio, digits).alias("min_max_ratio"), F.bround("gini", digits).alias("gini"), efficiency_score(cv, ratio).alias("efficiency_score"))


def distance_summary(points: DataFrame, centroids: DataFrame, n_strata: int, actual_distance: bool = False, longlat: bool = False, count_as: str = "n_cells") -> DataFrame:
    """Per stratum from 1 to n_strata: count, mean, sd, min, max and median of the squared distance to its own centroid.

    actual_distance takes the root of each point's distance first. A stratum without points has count 0 and NULLs.
    """
    d2 = distance_sq(longlat)(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))
    centers = centroids.select("stratum_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    d = points.select("stratum_id", "x", "y").join(centers, "stratum_id").select("stratum_id", (F.sqrt(d2) if actual_distance else d2).alias("d"))
    stats = d.groupBy("stratum_id").agg(F.count("d").alias("n"), F.avg("d").alias("mean_dist"), F.stddev_samp("d").alias("sd_dist"), F.min("d").alias("min_dist"), F.max("d").alias("max_dist"))
    middle = medians(d, "stratum_id", "d", "median_dist")
    stats = stats.join(middle, "stratum_id", "left")
    every = points.sparkSession.range(1, n_strata + 1).select(F.col("id").cast("int").alias("stratum_id"))
    return every.join(stats, "stratum_id", "left").select("stratum_id", F.coalesce("n", F.lit(0)).alias(count_as), "mean_dist", "sd_dist", "min_dist", "max_dist", "median_dist")


def stratum_area(cells: DataFrame, cell_size: tuple[float, float] | None) -> DataFrame:
    """stratum_id, area of the strata that have cells; their counts, with a warning, where cells have no size."""
    if cell_size is None:
        warnings.warn("cells have no size: areas are counts of cells", stacklevel=2)
    dx, dy = cell_size or (1.0, 1.0)
    return stratum_counts(cells).select("stratum_id", (F.col("n_cells") * F.lit(float(dx) * float(dy))).alias("area"))


def relative_area(cells: DataFrame) -> DataFrame:
    """stratum_id, relative_area: shares of all cells, which sum to 1."""
    total = Window.partitionBy(F.lit(0))
    return stratum_counts(cells).select("stratum_id", (F.col("n_cells") / F.sum("n_cells").over(total)).alias("relative_area"))


def strata_efficiency(strata: Strata, digits: int = 3) -> DataFrame:
    return coverage_efficiency(strata.cells, strata.n_strata, digits)


def strata_distances(strata: Strata, actual_distance: bool = False) -> DataFrame:
    return distance_summary(strata.cells, strata.centroids, strata.n_strata, actual_distance, strata.longlat)


def efficiency_text(x: Strata | DataFrame, digits: int = 3) -> str:
    """The figures of strata_efficiency(), or of a row of coverage_efficiency(), as text to print."""
    r = (strata_efficiency(x, digits) if isinstance(x, Strata) else x).first()
    figure = lambda v: "NA" if v is None else f"{v:.{digits}f}"
    lines = [
        ("strata", r.n_strata), ("cells", r.total_cells), ("cells a stratum, mean (sd)", f"{figure(r.mean_cells)} ({figure(r.sd_cells)})"), ("smallest - largest", f"{r.min_cells} - {r.max_cells}"), ("range", r.range_cells),
        ("coefficient of variation", figure(r.cv)), ("smallest to largest", figure(r.min_max_ratio)), ("Gini index", figure(r.gini)), ("score", r.efficiency_score),
    ]
    return "\n".join(["Coverage efficiency", *(f"  {name}: {value}" for name, value in lines)])
