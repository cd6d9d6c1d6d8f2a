"""Plots as SVG: the layers of plot_layers() as elements, a row each, made and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A color a stratum or kind of point: hues a golden angle apart.
HUE = 137.508


def _hue(c: Column) -> Column:
    return F.format_number(F.pmod(c.cast("double") * HUE, F.lit(360.0)), 1)


def _text(parts: list) -> Column:
    """Concatenated: texts as they are, columns as numbers of at most four decimals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.when(p.isNotNull(), F.regexp_replace(F.format_string("%.4f", p.cast("double")), r"\.?0+$", "")) for p in parts])


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def elements(layers: dict[str, DataFrame], cell_size: tuple[float, float] | None = None) -> DataFrame:
    """layer, z, value: SVG elements of the layers cells, boundaries, centroids and samples, as far as they are there.

    y points up, so it is turned. Rows with null coordinates give no element. Samples carry their point_type as a class.
    """
    dx, dy = cell_size or (0.0, 0.0)
    x, y, out = F.col("x"), -F.col("y"), []
    if "cells" in layers:
        cells = layers["cells"]
        fill = F.concat(F.lit('" fill="hsl('), _hue(F.col("stratum_id")), F.lit(',50%,80%)"/>'))
        shape = F.concat(_text(['<rect x="', x - dx / 2, '" y="', y - dy / 2, f'" width="{dx:g}" height="{dy:g}']), fill) if cell_size else F.concat(_text(['<circle cx="', x, '" cy="', y, '" r="0.5']), fill)
        out.append(cells.select(F.lit("cells").alias("layer"), F.lit(0).alias("z"), shape.alias("value")))
    if "boundaries" in layers:
        line = _text(['<line x1="', F.col("x1"), '" y1="', -F.col("y1"), '" x2="', F.col("x2"), '" y2="', -F.col("y2"), '" stroke="black" stroke-width="0.2"/>'])
        out.append(layers["boundaries"].select(F.lit("boundaries").alias("layer"), F.lit(1).alias("z"), line.alias("value")))
    if "centroids" in layers:
        out.append(layers["centroids"].select(F.lit("centroids").alias("layer"), F.lit(2).alias("z"), _text(['<circle cx="', x, '" cy="', y, '" r="0.4" fill="none" stroke="black" stroke-width="0.2"/>']).alias("value")))
    if "samples" in layers:
        dot = F.concat(_text(['<circle cx="', x, '" cy="', y, '" r="0.8" class="']), _escaped(F.col("point_type")), F.lit('"/>'))
        out.append(layers["samples"].select(F.lit("samples").alias("layer"), F.lit(3).alias("z"), dot.alias("value")))
    if not out:
        raise ValueError("no layers to draw")
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found.where("value IS NOT NULL")


def to_svg(layers: dict[str, DataFrame], bbox: tuple[float, float, float, float], path: str, cell_size: tuple[float, float] | None = None, title: str = "") -> None:
    """One SVG document as text files whose concatenation, in order of their names, is the document."""
    x0, y0, x1, y1 = bbox
    drawn = elements(layers, cell_size)
    spark = drawn.sparkSession
    safe = title.replace("&", "&amp;").replace("<", "&lt;")
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{x0:g} {-y1:g} {x1 - x0:g} {y1 - y0:g}"><title>{safe}</title><style>.Prior{{fill:#b00}}.New,.Sample{{fill:#000}}</style>'
    ends = spark.createDataFrame([(-1, head), (9, "</svg>")], "z int, value string")
    drawn.select("z", "value").unionByName(ends).repartitionByRange("z").sortWithinPartitions("z", "value").select("value").write.mode("overwrite").text(path)
