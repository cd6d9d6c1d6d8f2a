"""Study areas: polygons with holes, or points that are the cells themselves; grids over them; sinks for results."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.functions.ranks import ranked

Ring = tuple[tuple[float, float], ...]
MOST_STRIPS = 1024
MOST_BROADCAST_EDGES = 200_000


@dataclass(frozen=True)
class Area:
    """Polygons, each an outer ring and holes. A ring needs no closing point. Overlapping polygons count once."""

    polygons: tuple[tuple[Ring, ...], ...]
    longlat: bool = False
    srid: int | None = None

    def __post_init__(self):
        if not self.polygons or any(not p or any(len(r) < 3 for r in p) for p in self.polygons):
            raise ValueError("an area needs at least one polygon, and a ring at least three points")

    @classmethod
    def rectangle(cls, x0: float, y0: float, x1: float, y1: float, longlat: bool = False) -> Area:
        return cls(((((x0, y0), (x1, y0), (x1, y1), (x0, y1)),),), longlat)

    @classmethod
    def from_rings(cls, rings: DataFrame, longlat: bool = False, srid: int | None = None) -> Area:
        """From a table (poly_id, ring_id, is_hole, seq, x, y); an area's outline is small next to what lies in it."""
        parts: dict = {}
        for r in rings.orderBy("poly_id", "is_hole", "ring_id", "seq").collect():
            parts.setdefault(r.poly_id, {}).setdefault((r.is_hole, r.ring_id), []).append((float(r.x), float(r.y)))
        return cls(tuple(tuple(tuple(p) for p in rings.values()) for rings in parts.values()), longlat, srid)

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*(p for poly in self.polygons for ring in poly for p in ring), strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def is_rectangle(self) -> bool:
        if len(self.polygons) != 1 or len(self.polygons[0]) != 1:
            return False
        x0, y0, x1, y1 = self.bbox
        points = [p for k, p in enumerate(self.polygons[0][0]) if k == 0 or p != self.polygons[0][0][0]]
        turns = all(a[0] == b[0] or a[1] == b[1] for a, b in zip(points, points[1:] + points[:1], strict=True))
        return len(points) == 4 and turns and set(points) == {(x0, y0), (x1, y0), (x1, y1), (x0, y1)}

    def edges(self) -> list[tuple[int, float, float, float, float]]:
        """(polygon, x1, y1, x2, y2), every ring closed."""
        return [(k, *map(float, a), *map(float, b)) for k, poly in enumerate(self.polygons) for ring in poly for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a != b]


def inside(points: DataFrame, area: Area, key: str = "cell_id") -> DataFrame:
    """The rows of points (key, x, y, ...) in the area; its boundary is inside.

    A rectangle is two range filters. Otherwise edges and points meet by horizontal strip, an equi-join with each
    edge in the strips that it spans, and parity is counted by point and polygon.
    """
    x0, y0, x1, y1 = area.bbox
    near = points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    if area.is_rectangle:
        return near
    edges = area.edges()
    strips = max(1, min(MOST_STRIPS, len(edges)))
    height = (y1 - y0) / strips or 1.0
    strip = lambda y: F.least(F.greatest(F.floor((y - F.lit(y0)) / F.lit(height)), F.lit(0)), F.lit(strips - 1)).cast("int")
    e = points.sparkSession.createDataFrame(edges, "poly int, ax double, ay double, bx double, by double")
    # one strip more on either side, for points whose strip is rounded the other way
    e = e.withColumn("strip", F.explode(F.sequence(strip(F.least("ay", "by")) - 1, strip(F.greatest("ay", "by")) + 1)))
    e = F.broadcast(e) if len(edges) * 3 <= MOST_BROADCAST_EDGES and len(edges) < MOST_BROADCAST_EDGES // 3 else e
    p = near.select(key, "x", "y").withColumn("strip", strip(F.col("y")))
    met = p.join(e, "strip")
    x, y, ax, ay, bx, by = (F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by"))
    turn = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    on = (turn == 0) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))
    crosses = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    hits = met.where(on | ((ay > y) != (by > y))).groupBy(key, "poly").agg(F.max(on.cast("int")).alias("on"), (F.sum(F.when(crosses, 1).otherwise(0)) % 2).alias("odd"))
    return near.join(hits.where("on = 1 OR odd = 1").select(key).distinct(), key, "left_semi")


def bounding_area(points: DataFrame, longlat: bool = False) -> Area:
    """The rectangle around points (x, y)."""
    r = points.agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d")).first()
    if r.a is None or r.b is None:
        raise ValueError("no points to bound")
    return Area.rectangle(float(r.a), float(r.b), float(r.c), float(r.d), longlat)


def point_cells(points: DataFrame, order: list[str]) -> DataFrame:
    """The rows of points (x, y, ...) as cells: cell_id numbers those with finite coordinates from 0 by columns that tell them apart."""
    known = points.where("abs(CAST(x AS DOUBLE)) < double('Infinity') AND abs(CAST(y AS DOUBLE)) < double('Infinity')")
    return ranked(known, order, rank="cell_id")


@dataclass(frozen=True)
class Trapezoid:
    """Between heights y0 and y1, from (left0, right0) at y0 to (left1, right1) at y1."""

    y0: float
    y1: float
    left0: float
    right0: float
    left1: float
    right1: float

    def size(self, longlat: bool = False) -> float:
        """Area, on the sphere up to a constant factor."""
        w0, w1, h = self.right0 - self.left0, self.right1 - self.left1, self.y1 - self.y0
        if not longlat:
            return (w0 + w1) / 2 * h
        slope = (w1 - w0) / h
        part = lambda y: (w0 + slope * (y - self.y0)) * math.sin(math.radians(y)) + math.degrees(slope * math.cos(math.radians(y)))
        return part(self.y1) - part(self.y0)


def trapezoids(area: Area) -> list[Trapezoid]:
    """The area cut at the heights of all corners and crossings of its outline, each slab between neighbouring edges.

    Overlapping polygons count once: a slab's stretches are those that lie in at least one polygon by its own parity.
    """
    edges = [(k, x1, y1, x2, y2) if y1 < y2 else (k, x2, y2, x1, y1) for k, x1, y1, x2, y2 in area.edges() if y1 != y2]
    heights = {e[j] for e in edges for j in (2, 4)}
    for i, (_, ax, ay, bx, by) in enumerate(edges):
        for _, cx, cy, dx, dy in edges[i + 1 :]:
            turn = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if turn:
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / turn
                u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / turn
                if 0 < t < 1 and 0 < u < 1:
                    heights.add(ay + t * (by - ay))
    ys, out = sorted(heights), []
    for y0, y1 in zip(ys, ys[1:], strict=False):
        at = lambda e, y: e[1] + (e[3] - e[1]) * ((y - e[2]) / (e[4] - e[2]))
        across = sorted((e for e in edges if e[2] <= y0 and e[4] >= y1), key=lambda e: (at(e, (y0 + y1) / 2), e))
        within, left = set(), None
        for e in across:
            was = bool(within)
            within ^= {e[0]}
            if within and not was:
                left = e
            elif was and not within:
                out.append(Trapezoid(y0, y1, at(left, y0), at(e, y0), at(left, y1), at(e, y1)))
    return out


def cell_size_of(area: Area, n_cells: int = 2500, cell_size: float | tuple[float, float] | None = None) -> tuple[float, float]:
    """Cell width and height: square cells, n_cells to the bounding box, unless given."""
    x0, y0, x1, y1 = area.bbox
    if cell_size is None:
        if n_cells < 1:
            raise ValueError("n_cells must be at least 1")
        side = math.sqrt((x1 - x0) * (y1 - y0) / n_cells)
        return side, side
    dx, dy = cell_size if isinstance(cell_size, (tuple, list)) else (cell_size, cell_size)
    if not (dx > 0 and dy > 0):
        raise ValueError("cell_size must be positive")
    return float(dx), float(dy)


def lattice(spark: SparkSession, area: Area, n_cells: int = 2500, cell_size=None) -> DataFrame:
    """cell_id, ix, iy, x, y: centers of all cells over the bounding box, row by row from the lower left. No join."""
    x0, y0, x1, y1 = area.bbox
    dx, dy = cell_size_of(area, n_cells, cell_size)
    nx, ny = max(1, math.ceil((x1 - x0) / dx - 1e-9)), max(1, math.ceil((y1 - y0) / dy - 1e-9))
    ix, iy = (F.col("id") % nx).cast("int"), F.floor(F.col("id") / nx).cast("int")
    cells = spark.range(nx * ny).select(F.col("id").alias("cell_id"), ix.alias("ix"), iy.alias("iy"))
    return cells.select("*", (F.lit(x0) + (F.col("ix") + 0.5) * F.lit(dx)).alias("x"), (F.lit(y0) + (F.col("iy") + 0.5) * F.lit(dy)).alias("y"))


def grid(spark: SparkSession, area: Area, n_cells: int = 2500, cell_size=None) -> DataFrame:
    """The cells of lattice() whose center is in the area."""
    return inside(lattice(spark, area, n_cells, cell_size), area)


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def geojson(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One GeoJSON feature a row, as text in column value: other columns are properties."""
    rest = [c for c in df.columns if c not in (x, y)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def to_geojson(df: DataFrame, path: str, x: str = "x", y: str = "y") -> None:
    """Newline-delimited GeoJSON features."""
    geojson(df, x, y).write.mode("overwrite").text(path)
