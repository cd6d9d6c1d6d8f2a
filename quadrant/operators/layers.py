"""Tables to draw from, and to hand on: boundaries, point types, summaries, conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrant.operators.samplers import Samples
from quadrant.operators.strata import Strata


def stratum_boundaries(cells: DataFrame, cell_size: tuple[float, float]) -> DataFrame:
    """x1, y1, x2, y2: a segment on the midline between neighbouring cells of different strata.

    Neighbours are next to each other among the distinct coordinates that occur, so an empty row or column is bridged.
    Ranks come from the distinct coordinates, of which a grid has as many as its sides are long; cells then meet their
    neighbour in an equi-join.
    """
    dx, dy = map(float, cell_size)
    xs = cells.select("x").distinct().select("x", F.row_number().over(Window.orderBy("x")).alias("rx"))
    ys = cells.select("y").distinct().select("y", F.row_number().over(Window.orderBy("y")).alias("ry"))
    c = cells.select("x", "y", "stratum_id").join(xs, "x").join(ys, "y")
    left = c.select((F.col("rx") + 1).alias("rx"), "ry", F.col("x").alias("x0"), F.col("stratum_id").alias("s0"))
    below = c.select("rx", (F.col("ry") + 1).alias("ry"), F.col("y").alias("y0"), F.col("stratum_id").alias("s0"))
    mid_x, mid_y = (F.col("x") + F.col("x0")) / 2, (F.col("y") + F.col("y0")) / 2
    upright = c.join(left, ["rx", "ry"]).where("stratum_id <> s0").select(mid_x.alias("x1"), (F.col("y") - dy / 2).alias("y1"), mid_x.alias("x2"), (F.col("y") + dy / 2).alias("y2"))
    level = c.join(below, ["rx", "ry"]).where("stratum_id <> s0").select((F.col("x") - dx / 2).alias("x1"), mid_y.alias("y1"), (F.col("x") + dx / 2).alias("x2"), mid_y.alias("y2"))
    return upright.unionByName(level)


def point_types(samples: DataFrame) -> DataFrame:
    """samples with point_type, by which points are drawn: Prior or New, the composite's number, or Sample."""
    if "is_prior" in samples.columns:
        kind = F.when(F.col("is_prior"), "Prior").otherwise("New")
    elif "composite" in samples.columns:
        kind = F.col("composite").cast("string")
    else:
        kind = F.lit("Sample")
    return samples.withColumn("point_type", kind)


def plot_layers(x: Strata | Samples, samples: Samples | None = None, show_boundaries: bool = True, show_centroids: bool = False) -> dict[str, DataFrame]:
    """The tables of a plot by layer: cells, boundaries, centroids, samples, as far as they apply."""
    strata, samples = (x, samples) if isinstance(x, Strata) else (x.strata, x)
    out = {}
    if strata is not None:
        out["cells"] = strata.cells
        if show_boundaries and strata.cell_size is not None:
            out["boundaries"] = stratum_boundaries(strata.cells, strata.cell_size)
        if show_centroids:
            out["centroids"] = strata.centroids
    if samples is not None:
        out["samples"] = point_types(samples.samples)
    return out


def table_of(x: Strata | Samples, what: str = "samples") -> DataFrame:
    """samples, cells (or strata) or centroids of a result."""
    strata = x if isinstance(x, Strata) else x.strata
    if what == "samples":
        if isinstance(x, Strata):
            raise ValueError("strata have no samples")
        return x.samples
    if what not in ("cells", "strata", "centroids"):
        raise ValueError(f"unknown table {what}")
    if strata is None:
        raise ValueError("the samples have no strata")
    return strata.centroids if what == "centroids" else strata.cells


def to_data_frame(x: Strata | Samples, what: str = "samples") -> DataFrame:
    """table_of(x, what) with the coordinates last, as X and Y."""
    t = table_of(x, what)
    return t.select(*[c for c in t.columns if c not in ("x", "y")], F.col("x").alias("X"), F.col("y").alias("Y"))


def sample_summary(samples: DataFrame, method: str, **facts) -> DataFrame:
    """One row: method, n_samples, x_min, x_max, y_min, y_max, and the facts given."""
    return samples.agg(F.count(F.lit(1)).alias("n_samples"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max")).select(F.lit(method).alias("method"), "n_samples", "x_min", "x_max", "y_min", "y_max", *[F.lit(v).alias(k) for k, v in facts.items()])


def summary_of(x: Samples) -> DataFrame:
    facts = {} if x.strata is None else {"n_strata": x.strata.n_strata, "mssd": x.strata.mssd, "equal_area": x.strata.equal_area}
    if x.method == "composite":
        facts["n_composites"] = x.facts["composites"]
    return sample_summary(x.samples, x.method, **facts)
