"""Stratification: cells into compact strata, or compact strata of equal size."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.functions.distance import EARTH_KM, distance_sq, haversine_sq_of
from quadrant.functions.ranks import ranked
from quadrant.functions.rng import order_key
from quadrant.sources.areas import Area, cell_size_of, grid, inside
from quadrant.sources.shared import written

Center = tuple[float, float]


@dataclass(frozen=True)
class Strata:
    """cells: cell_id, x, y, stratum_id (and ix, iy on a grid); centroids: stratum_id, x, y, is_fixed."""

    cells: DataFrame
    centroids: DataFrame
    n_strata: int
    mssd: float
    converged: bool
    iterations: int
    equal_area: bool = False
    longlat: bool = False
    cell_size: tuple[float, float] | None = None
    priors: tuple[Center, ...] = ()
    tries: tuple[float, ...] = field(default=())

    def __repr__(self) -> str:
        size = "points" if self.cell_size is None else f"{self.cell_size[0]:g} x {self.cell_size[1]:g}"
        return f"Strata\n  strata: {self.n_strata}\n  cells: {size}\n  equal area: {self.equal_area}\n  prior points: {len(self.priors)}\n  MSSD: {self.mssd:.4f}\n  converged: {self.converged}"

    def summary(self) -> str:
        """repr, cells a stratum, and the area where cells have one."""
        counts = self.cells.groupBy("stratum_id").count().agg(F.min("count"), F.max("count"), F.sum("count")).first()
        area = "" if self.cell_size is None else f"\n  area: {counts[2] * self.cell_size[0] * self.cell_size[1]:g}"
        return f"{self!r}\n  cells a stratum: {counts[0]} - {counts[1]}{area}"


def nearest_center(centers: list[Center], longlat: bool = False, x: str = "x", y: str = "y") -> Column:
    """struct(d2, stratum_id) of the nearest center, the first of equals; stratum_id counts from 1.

    Centers are constants of the plan, so this is a projection: no join and no shuffle, however many the rows.
    """
    d2 = distance_sq(longlat)
    table = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(k).alias("k")) for k, (a, b) in enumerate(centers, 1)])
    return F.array_min(F.transform(table, lambda c: F.struct(d2(F.col(x), F.col(y), c["a"], c["b"]).alias("d2"), c["k"].alias("stratum_id"))))


def centroid(longlat: bool = False) -> list[Column]:
    """Aggregates (x, y): means, or on the sphere the direction of the mean unit vector."""
    if not longlat:
        return [F.avg("x").alias("x"), F.avg("y").alias("y")]
    lon, lat = F.radians("x"), F.radians("y")
    u, v, w = F.avg(F.cos(lat) * F.cos(lon)), F.avg(F.cos(lat) * F.sin(lon)), F.avg(F.sin(lat))
    return [F.degrees(F.atan2(v, u)).alias("x"), F.degrees(F.asin(w / F.sqrt(u * u + v * v + w * w))).alias("y")]


def seed_cells(cells: DataFrame, k: int, seed: int, attempt: int = 0) -> DataFrame:
    """k distinct cells, uniformly, by seeded hash of their id."""
    return cells.orderBy(order_key(seed, F.lit(attempt), "cell_id"), "cell_id").limit(k)


def balanced_labels(cells: DataFrame, k: int, seed: int, attempt: int = 0) -> DataFrame:
    """cells with label 0..k-1 dealt round robin over a random order, so label counts differ by one at most."""
    keyed = cells.withColumn("order_key", order_key(seed, F.lit(attempt), "cell_id"))
    return ranked(keyed, ["order_key", "cell_id"], rank="label").withColumn("label", (F.col("label") % k).cast("int")).drop("order_key")


def prepare_priors(cells: DataFrame, priors: list[Center], longlat: bool = False, area: Area | None = None) -> list[tuple[int, Center, int]]:
    """(prior_id, point, nearest cell): priors inside the area, the first of those that share a nearest cell.

    Duplicates are found before priors outside are dropped, so one outside can displace one inside.
    """
    spark = cells.sparkSession
    d2 = distance_sq(longlat)
    best = {}
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(priors, 1)]
    nearest = cells.agg(*[F.min(F.struct(d2(F.col("x"), F.col("y"), F.lit(x), F.lit(y)).alias("d2"), "cell_id")).alias(f"p{k}") for k, x, y in points]).first()
    kept = []
    for k, x, y in points:
        cell = nearest[f"p{k}"]["cell_id"]
        if cell in best:
            warnings.warn(f"prior point {k} shares its nearest cell with prior point {best[cell]} and is dropped", stacklevel=3)
            continue
        best[cell] = k
        kept.append((k, (x, y), cell))
    if area is not None and kept:
        frame = spark.createDataFrame([(k, x, y) for k, (x, y), _ in kept], "cell_id long, x double, y double")
        there = {r.cell_id for r in inside(frame, area).collect()}
        if len(there) < len(kept):
            warnings.warn(f"{len(kept) - len(there)} prior points outside the study area are dropped", stacklevel=3)
        kept = [p for p in kept if p[0] in there]
    return kept


#: Coordinates are summed as whole numbers of 2^-GRAIN of their range, so sums don't depend on the order of rows.
GRAIN = 50
HAVERSINE_SQ = f"pow({2 * EARTH_KM!r}D * asin(least(1D, sqrt(pow(sin(radians(c.b - y) / 2), 2) + cos(radians(y)) * cos(radians(c.b)) * pow(sin(radians(c.a - x) / 2), 2)))), 2)"
#: What doubles may lose of a distance, as a share of it.
SLACK = 1e-9


class _Lloyd:
    """Steps of several tries over cells (x, y) as Spark jobs; each cell carries, for each try, bounds between steps.

    A row is a cell of a try: its stratum, an upper bound on the distance to that center, and a lower one on the distance to
    any other. After centers moved, bounds are moved by as much; where the upper stays below the lower, or below half the
    way to the next center, the stratum can't have changed and no center is looked at. A step is a pass that writes the rows
    and an aggregate of one row a stratum.
    """

    def __init__(self, cells: DataFrame, longlat: bool):
        self.longlat, self.rows = longlat, None
        lon, lat = F.radians("x"), F.radians("y")
        parts = {"u": F.cos(lat) * F.cos(lon), "v": F.cos(lat) * F.sin(lon), "w": F.sin(lat)} if longlat else {"u": F.col("x"), "v": F.col("y")}
        r = cells.agg(*[f(e).alias(n + m) for n, e in parts.items() for f, m in ((F.min, "0"), (F.max, "1"))]).first()
        self.low = {n: r[n + "0"] for n in parts}
        self.range = {n: (r[n + "1"] - r[n + "0"]) or 1.0 for n in parts}
        whole = [F.round((e - F.lit(self.low[n])) / F.lit(self.range[n]) * float(1 << GRAIN)).cast("decimal(20,0)").alias(n) for n, e in parts.items()]
        self.cells = written(cells.select("x", "y", *whole), "lloyd-cells")

    def _scan(self, centers: str) -> str:
        """SQL of struct(stratum_id, upper, lower, d2) by distances to an array of centers, the first of equals.

        Text, as are the tables of numbers below: steps are many and short, and building columns call by call takes longer.
        """
        d2 = HAVERSINE_SQ if self.longlat else "(x - c.a) * (x - c.a) + (y - c.b) * (y - c.b)"
        none = "CAST(NULL AS STRUCT<d2: DOUBLE, k: INT, next: DOUBLE>)"
        merge = "CASE WHEN s IS NULL THEN named_struct('d2', e.d2, 'k', e.k, 'next', double('Infinity')) WHEN e.d2 < s.d2 THEN named_struct('d2', e.d2, 'k', e.k, 'next', s.d2) ELSE named_struct('d2', s.d2, 'k', s.k, 'next', least(s.next, e.d2)) END"
        end = f"named_struct('stratum_id', s.k, 'upper', sqrt(s.d2) * {1 + SLACK!r}D, 'lower', sqrt(s.next) * {1 - SLACK!r}D, 'd2', s.d2)"
        return f"aggregate(transform({centers}, c -> named_struct('d2', {d2}, 'k', c.k)), {none}, (s, e) -> {merge}, s -> {end})"

    def step(self, tries: dict[int, list[Center]], before: dict[int, list[Center]] | None = None) -> dict[int, tuple[dict[int, tuple[float, float, int]], int]]:
        """For each try, new centers by stratum with their cells, and how many cells were measured.

        before: the centers of the step before, whose bounds the rows carry; without it every cell is measured.
        """
        order = sorted(tries)
        number = lambda v: f"double('{v!r}')" if not math.isfinite(v) else f"{v!r}D"
        array = lambda items: f"array({', '.join(items)})"
        tables = array(array(f"named_struct('a', {number(float(x))}, 'b', {number(float(y))}, 'k', {k})" for k, (x, y) in enumerate(tries[t], 1)) for t in order)
        scan = self._scan(f"get({tables}, at)")
        if before is None or self.rows is None:
            rows = self.cells.selectExpr("*", f"explode({array(map(str, range(len(order))))}) AS at").selectExpr("*", "true AS scanned", f"{scan} AS s")
        else:
            facts = [_movement(tries[t], before[t], self.longlat) for t in order]
            pick = lambda k: f"get(get({array(array(map(number, f[k])) for f in facts)}, at), stratum_id - 1)"
            at = f"CAST(array_position({array(map(str, order))}, t) - 1 AS INT) AS at"
            rows = self.rows.where(F.col("t").isin(order)).selectExpr("*", at)
            rows = rows.selectExpr("x", "y", *self.low, "at", "stratum_id", f"upper + {pick(0)} AS upper", f"lower - {pick(1)} AS lower", f"{pick(2)} AS half")
            rows = rows.selectExpr("x", "y", *self.low, "at", "named_struct('stratum_id', stratum_id, 'upper', upper, 'lower', lower, 'd2', CAST(NULL AS DOUBLE)) AS kept", "coalesce(upper < greatest(lower, half), false) AS keep")
            rows = rows.selectExpr("x", "y", *self.low, "at", "NOT keep AS scanned", f"CASE WHEN keep THEN kept ELSE {scan} END AS s")
        self.rows = written(rows.selectExpr("x", "y", *self.low, f"get({array(map(str, order))}, at) AS t", "scanned", "s.stratum_id", "s.upper", "s.lower"), "lloyd-rows")
        found = self.rows.groupBy("t", "stratum_id").agg(*[F.sum(n).alias(n) for n in self.low], F.count(F.lit(1)).alias("n"), F.count_if("scanned").alias("scanned")).collect()
        of = {t: sorted((r for r in found if r.t == t), key=lambda r: r.stratum_id) for t in order}
        return {t: ({r.stratum_id: (*self._center(r), r.n) for r in mine}, sum(r.scanned for r in mine)) for t, mine in of.items()}

    def _center(self, r) -> Center:
        mean = {n: self.low[n] + float(Fraction(int(r[n]), r.n << GRAIN)) * self.range[n] for n in self.low}
        if not self.longlat:
            return mean["u"], mean["v"]
        size = math.sqrt(sum(m * m for m in mean.values())) or 1.0
        return math.degrees(math.atan2(mean["v"], mean["u"])), math.degrees(math.asin(max(-1.0, min(1.0, mean["w"] / size))))


def _movement(centers: list[Center], before: list[Center], longlat: bool) -> tuple[list[float], list[float], list[float]]:
    """By center: how far it moved, the farthest that any other moved, half the way to its nearest other; rounded safely."""
    way = (lambda p, q: math.sqrt(haversine_sq_of(*p, *q))) if longlat else (lambda p, q: math.hypot(p[0] - q[0], p[1] - q[1]))
    moved = [way(p, q) * (1 + SLACK) for p, q in zip(centers, before, strict=True)]
    order = sorted(range(len(moved)), key=lambda k: -moved[k])
    others = [(moved[order[1]] if len(moved) > 1 else 0.0) if k == order[0] else moved[order[0]] for k in range(len(moved))]
    half = [min((way(p, q) for j, q in enumerate(centers) if j != k), default=math.inf) / 2 * (1 - SLACK) for k, p in enumerate(centers)]
    return moved, others, half


def mean_squares(cells: DataFrame, tries: dict[int, list[Center]], longlat: bool) -> dict[int, float]:
    """Mean squared distance of cells to the nearest of each try's centers: one job, one row."""
    r = cells.agg(*[F.avg(nearest_center(c, longlat)["d2"]).alias(f"t{t}") for t, c in tries.items()]).first()
    return {t: r[f"t{t}"] for t in tries}


def _moved(centers: list[Center], found: dict, fixed: int) -> list[Center]:
    """Means of their cells; fixed and empty ones stay."""
    return [c if k <= fixed or k not in found else (found[k][0], found[k][1]) for k, c in enumerate(centers, 1)]


def _seeds(cells: DataFrame, k: int, seed: int, attempt: int, prior: list[tuple[int, Center, int]]) -> list[Center]:
    free = cells
    if prior:  # an anti-join against a few cells
        free = cells.where(~F.col("cell_id").isin([c for _, _, c in prior]))
    drawn = [(r.x, r.y) for r in seed_cells(free.select("cell_id", "x", "y"), k - len(prior), seed, attempt).collect()]
    return [p for _, p, _ in prior] + drawn


def stratify(spark: SparkSession, where: Area | DataFrame, n_strata: int, priors: list[Center] | None = None, max_iter: int = 1000, n_try: int = 1, n_cells: int = 2500, cell_size=None, equal_area: bool = False, seed: int = 1, algorithm: str = "lloyd", longlat: bool | None = None) -> Strata:
    """Strata of an area's grid cells, or of the points of a table (cell_id, x, y).

    algorithm: "lloyd" alternates assignment and means until no center moves; "single_step" does so once, keeping the
    strata of the seeds. Priors are fixed centers and come first; n_strata includes them. equal_area exchanges cells
    between strata whose sizes differ by one at most. Of n_try random starts the least mean squared shortest distance
    wins, the first of equals. Same seed, same result, on any partitioning.
    """
    if n_strata < 1 or n_try < 1 or max_iter < 1:
        raise ValueError("n_strata, n_try and max_iter must be at least 1")
    if algorithm not in ("lloyd", "single_step"):
        raise ValueError("algorithm must be lloyd or single_step")
    n_strata, priors = int(n_strata), list(priors or [])
    area = where if isinstance(where, Area) else None
    longlat = area.longlat if area is not None and longlat is None else bool(longlat)
    if equal_area and longlat:
        raise ValueError("equal-area strata need projected coordinates")
    if equal_area and priors:
        raise ValueError("equal-area strata can't have prior points")
    size = cell_size_of(area, n_cells, cell_size) if area is not None else None
    cells = grid(spark, area, n_cells, cell_size).persist() if area is not None else where  # a table is its owner's to cache
    n = cells.count()
    if n == 0:
        raise ValueError("no cells in the study area")
    if n < n_strata:
        raise ValueError(f"{n} cells are fewer than {n_strata} strata")
    prior = prepare_priors(cells, priors, longlat, area) if priors else []
    if n_strata < len(prior):
        raise ValueError(f"{n_strata} strata are fewer than {len(prior)} prior points")
    if equal_area:
        got = _equal_area(cells, n, n_strata, max_iter, n_try, seed, size)
        if area is not None:
            cells.unpersist()
        return got
    tries = {t: _seeds(cells, n_strata, seed, t, prior) for t in range(n_try)}
    steps, labels, converged = dict.fromkeys(tries, 0), dict(tries), dict.fromkeys(tries, algorithm == "single_step")
    going, before, lloyd = dict(tries), None, _Lloyd(cells, longlat)
    for _ in range(1 if algorithm == "single_step" else max_iter):
        found = lloyd.step(going, before)
        before, going = going, {t: _moved(c, found[t][0], len(prior)) for t, c in going.items()}
        for t, new in list(going.items()):
            labels[t], tries[t] = before[t], new
            steps[t] += 1
            converged[t] = converged[t] or new == before[t]
            if converged[t]:
                del going[t]
        if not going:
            break
    scores = mean_squares(cells, tries, longlat)
    if area is not None:
        cells.unpersist()
    best = min(scores, key=lambda t: (scores[t], t))
    if not converged[best]:
        warnings.warn(f"not converged in {max_iter} iterations", stacklevel=2)
    centers = tries[best]
    by = labels[best] if algorithm == "single_step" else centers
    out = cells.withColumn("stratum_id", nearest_center(by, longlat)["stratum_id"])
    return Strata(out, _centroids(spark, centers, len(prior)), n_strata, scores[best], converged[best], steps[best], False, longlat, size, tuple(p for _, p, _ in prior), tuple(scores[t] for t in sorted(scores)))


def _centroids(spark: SparkSession, centers: list[Center], fixed: int = 0) -> DataFrame:
    return spark.createDataFrame([(k, float(x), float(y), k <= fixed) for k, (x, y) in enumerate(centers, 1)], "stratum_id int, x double, y double, is_fixed boolean")


def _equal_area(cells: DataFrame, n: int, k: int, most: int, n_try: int, seed: int, size) -> Strata:
    """Of n_try random starts, the strata of equal size whose centers have the least mean squared shortest distance."""
    from quadrant.operators.balance import equal_strata, nearest_squares

    found = {t: equal_strata(cells, _seeds(cells, k, seed, t, []), most) for t in range(n_try)}
    scores = {t: nearest_squares(cells, f.means) for t, f in found.items()}
    best = min(scores, key=lambda t: (scores[t], t))
    got = found[best]
    if not got.converged:
        warnings.warn(f"not converged in {most} iterations", stacklevel=3)
    return Strata(got.assign(cells), _centroids(cells.sparkSession, got.means), k, scores[best], got.converged, got.steps, True, False, size, (), tuple(scores[t] for t in sorted(scores)))


def within_sse(strata: Strata) -> float:
    """Sum of squared distances of cells to the mean of their own stratum."""
    means = strata.cells.groupBy("stratum_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d2 = distance_sq(strata.longlat)
    got = strata.cells.join(means, "stratum_id").agg(F.sum(d2(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")))).first()[0]
    return math.nan if got is None else float(got)
