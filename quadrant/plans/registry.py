"""The registered queries and their DuckDB SQL.

The driver's tables hold no coordinates, so points are derived: a part lies at (p_size, p_retailprice), an order at
(o_totalprice, o_custkey), a customer's stratum is their nation; areas are those around such points. Every random choice is an md5 of seed and id, which is
the same in SQL. Doubles are rounded before they are compared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.functions import quantiles
from quadrant.functions.distance import haversine_sq, planar_sq
from quadrant.functions.rng import uniform
from quadrant.operators import balance, doptimal, layers, metrics, nearest, samplers, spacing, strata
from quadrant.sources import areas, polygons

TRIANGLE = areas.Area(((((0.0, 0.0), (100.0, 0.0), (40.0, 80.0)),),))
HOLED = areas.Area((((((0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0))), ((30.0, 30.0), (70.0, 30.0), (70.0, 70.0), (30.0, 70.0))),))
TWO_PARTS = areas.Area(((((0.0, 0.0), (40.0, 0.0), (0.0, 40.0)),), (((60.0, 60.0), (100.0, 60.0), (100.0, 100.0), (60.0, 100.0)),)))
THREE = ((10.0, 20.0), (40.0, 30.0), (25.0, 80.0))
PLOT = (((0, 0), (9, 2), (20, 1), (26, 12), (17, 20), (29, 30), (10, 22), (4, 27), (7, 14)), ((10, 6), (15, 6), (12, 13)))
PICKS, NEAR, EQUAL, STEPS = 6, 4.0, 12, 12
PRIORS = ((10.0, 950.0), (40.0, 920.0), (10.2, 950.1), (25.0, 990.0))


def _r(c, n: int = 6):
    return F.round(c, n)


def parts(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("cell_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


def orders(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("cell_id"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"))


def places(s: SparkSession, d: str) -> DataFrame:
    """Orders on a map of about 100 by 100."""
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("cell_id"), (F.col("o_totalprice") / 5000).alias("x"), (F.col("o_custkey") % 101).cast("double").alias("y"))


def lots(s: SparkSession, d: str) -> DataFrame:
    """Parts on a small map: their size by a remainder of their key."""
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("cell_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"))


def nations(s: SparkSession, d: str) -> DataFrame:
    """Customers as cells: their nation is the stratum, the key and the balance are the coordinates."""
    return s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("cell_id"), (F.col("c_nationkey") + 1).alias("stratum_id"), (F.col("c_custkey") % 1000).cast("double").alias("x"), F.col("c_acctbal").alias("y"))


def means(cells: DataFrame) -> DataFrame:
    return cells.groupBy("stratum_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


FIXED = [(10.0, 910.0), (25.0, 950.0), (40.0, 930.0), (5.0, 990.0), (48.0, 995.0)]


def _centers(s: SparkSession, rows) -> DataFrame:
    return s.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rows, 1)], "stratum_id int, x double, y double")


def _lloyd(s, d, steps: int) -> DataFrame:
    centers, before, lloyd = list(FIXED), None, strata._Lloyd(parts(s, d), False)
    for _ in range(steps):
        found, _measured = lloyd.step({0: centers}, None if before is None else {0: before})[0]
        before, centers = centers, strata._moved(centers, found, 0)
    return _centers(s, centers).select("stratum_id", _r("x").alias("x"), _r("y").alias("y"))


def lloyd_strata(s, d):
    """The default stratification, until no center moves."""
    got = strata.stratify(s, parts(s, d), 5, seed=3)
    return got.cells.groupBy("stratum_id").agg(F.count(F.lit(1)).alias("n_cells")).join(got.centroids, "stratum_id").select("stratum_id", "n_cells", _r("x").alias("x"), _r("y").alias("y"))


def grid_cells(s, d):
    return areas.lattice(s, areas.bounding_area(lots(s, d)), cell_size=1.5).select("cell_id", "ix", "iy", _r("x").alias("x"), _r("y").alias("y"))


def grid_clip(s, d):
    return areas.grid(s, areas.bounding_area(lots(s, d))).agg(F.count(F.lit(1)).alias("n"), _r(F.sum("x"), 3).alias("sum_x"), _r(F.sum("y"), 3).alias("sum_y"))


def _pip(area):
    return lambda s, d: areas.inside(places(s, d), area).select("cell_id", "x", "y")


def point_cells(s, d):
    found = areas.point_cells(parts(s, d).withColumnRenamed("cell_id", "part_id").where("part_id % 3 > 0"), ["part_id"])
    return found.select("cell_id", "part_id", "x", _r("y").alias("y"))


def seed_cells(s, d):
    return strata.seed_cells(parts(s, d), 12, 7).select("cell_id")


def balanced_labels(s, d):
    return strata.balanced_labels(parts(s, d), 7, 7).select("cell_id", "label")


def assign_nearest(s, d):
    n = strata.nearest_center(FIXED)
    return parts(s, d).select("cell_id", n["stratum_id"].alias("stratum_id"), _r(n["d2"]).alias("d2"))


def single_step(s, d):
    return _lloyd(s, d, 1)


def lloyd_3_steps(s, d):
    return _lloyd(s, d, 3)


def mssd(s, d):
    return parts(s, d).agg(_r(F.avg(strata.nearest_center(FIXED)["d2"])).alias("mssd"))


def best_of_tries(s, d):
    got = strata.stratify(s, parts(s, d), 4, n_try=3, seed=3, algorithm="single_step")
    best = min(range(3), key=lambda t: (got.tries[t], t))
    return s.createDataFrame([(t, round(x, 6), t == best) for t, x in enumerate(got.tries)], "try_id int, mssd double, is_best boolean")


def prior_dedupe(s, d):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        kept = strata.prepare_priors(parts(s, d), list(PRIORS))
    return s.createDataFrame([(k, c) for k, _, c in kept], "prior_id int, cell_id long")


def prior_exclude(s, d):
    return parts(s, d).join(prior_dedupe(s, d).select("cell_id"), "cell_id", "left_anti").select("cell_id")


def _stratified(s, d, seed: int, priors=None):
    """Six strata of the parts, of at most STEPS steps."""
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return strata.stratify(s, parts(s, d), 6, priors, seed=seed, max_iter=STEPS)


def prior_strata(s, d):
    """Strata around fixed prior points: the priors stay where they are."""
    return _stratified(s, d, 5, list(PRIORS)).centroids.select("stratum_id", "is_fixed", _r("x").alias("x"), _r("y").alias("y"))


def simple_random(s, d):
    """Points in a triangle in the rectangle around the parts."""
    x0, y0, x1, y1 = areas.bounding_area(lots(s, d)).bbox
    triangle = areas.Area(((((x0, y0), (x1, y0), (x0 + 0.25 * (x1 - x0), y1)),),))
    return samplers.simple_random(s, triangle, 500, seed=11).samples.select("sample_id", _r("x").alias("x"), _r("y").alias("y"))


def stratified_draw(s, d):
    return samplers.draw(nations(s, d), 3, 13, (1.0, 2.0)).select("stratum_id", "draw", "cell_id", _r("x").alias("x"), _r("y").alias("y"))


def composite_draw(s, d):
    drawn = samplers.draw(nations(s, d), 4, 17)
    return samplers.numbered(drawn, ["stratum_id", "draw"]).select("stratum_id", "sample_id", F.col("draw").alias("composite"), "cell_id")


def coverage_relocate(s, d):
    cells = nations(s, d)
    return samplers.relocate(cells, means(cells), (3.0, 4.0)).select("stratum_id", _r("x").alias("x"), _r("y").alias("y"))


def stratum_counts(s, d):
    return metrics.stratum_counts(nations(s, d))


def stratum_area(s, d):
    return metrics.stratum_area(nations(s, d), (2.0, 1.5))


def relative_area(s, d):
    return metrics.relative_area(nations(s, d)).select("stratum_id", _r("relative_area", 9).alias("relative_area"))


def coverage_efficiency(s, d):
    return metrics.coverage_efficiency(nations(s, d))


def gini(s, d):
    return metrics.gini(metrics.stratum_counts(nations(s, d))).select(_r("gini", 9).alias("gini"))


def grid_efficiency(s, d):
    """The minimum slice: grid around the parts, clip, one assignment, coverage efficiency."""
    cells = areas.grid(s, areas.bounding_area(lots(s, d)), cell_size=2.0)
    return metrics.coverage_efficiency(cells.withColumn("stratum_id", strata.nearest_center(list(THREE))["stratum_id"]))


def _distances(actual: bool, longlat: bool = False):
    def query(s, d):
        cells = nations(s, d)
        if longlat:
            cells = cells.select("cell_id", "stratum_id", (F.lit(-80.0) + F.col("x") / 1000).alias("x"), (F.lit(35.0) + F.col("y") / 100000).alias("y"))
        x = metrics.distance_summary(cells, means(cells), 30, actual, longlat)
        return x.select("stratum_id", "n_cells", *[_r(c, 4).alias(c) for c in ("mean_dist", "sd_dist", "min_dist", "max_dist", "median_dist")])

    return query


def haversine_centroid(s, d):
    cells = nations(s, d).select("stratum_id", (F.lit(-80.0) + F.col("x") / 1000).alias("x"), (F.lit(35.0) + F.col("y") / 100000).alias("y"))
    x, y = strata.centroid(True)
    return cells.groupBy("stratum_id").agg(x, y).select("stratum_id", _r("x", 8).alias("x"), _r("y", 8).alias("y"))


def stratum_boundaries(s, d):
    """Between strata of the places that parts take, a column and a row left out."""
    cells = lots(s, d).select("x", (F.col("y") % 25).alias("y")).distinct().where("x <> 7 AND y <> 11")
    return layers.stratum_boundaries(cells.withColumn("stratum_id", strata.nearest_center([(10.0, 5.0), (40.0, 8.0), (25.0, 20.0)])["stratum_id"]), (1.0, 1.0))


def sample_summary(s, d):
    return layers.sample_summary(parts(s, d), "coverage")


def point_types(s, d):
    x = nations(s, d).select(F.col("cell_id").alias("sample_id"), (F.col("stratum_id") <= 3).alias("is_prior"))
    return layers.point_types(x)


def to_data_frame(s, d):
    x = samplers.Samples(parts(s, d).withColumnRenamed("cell_id", "sample_id"), "simple_random", 0)
    return layers.to_data_frame(x)


def geojson_rows(s, d):
    return areas.geojson(s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").alias("x"), (F.col("p_partkey") % 50).cast("int").alias("y")))


def normalize_features(s, d):
    x = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return doptimal.normalize(x, ["p_size", "p_retailprice"]).select("p_partkey", _r("p_size").alias("p_size"), _r("p_retailprice").alias("p_retailprice"))


def min_dist_exclusion(s, d):
    p = parts(s, d)
    return p.where(~doptimal.excluded(p, [c for c in FIXED], 12.0)).select("cell_id")


def leverage_top(s, d):
    """The location of largest leverage under a matrix: the argmax that each greedy step takes."""
    p = parts(s, d).withColumn("f", F.array("x", "y")).withColumn("s", doptimal.leverage(np.array([[2.0, 0.25], [0.25, 0.5]])))
    return p.orderBy(F.desc("s"), "cell_id").limit(1).select("cell_id", _r("s", 4).alias("leverage"))


def linear_projection(s, d):
    p = parts(s, d).withColumn("f", F.array("x", "y"))
    return p.select("cell_id", _r(doptimal.projection_top(np.array([[0.25, 2.0], [-0.5, 0.125]]))).alias("score"))


def gram_matrix(s, d):
    """Sums of products of three features, from which rank repair finds those that span all."""
    p = s.read.parquet(f"{d}/part.parquet").select(F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100, (F.col("p_partkey") % 13).cast("double")).alias("f"))
    return doptimal.gram(p, 3).select("i", "j", _r("value", 3).alias("value"))


def uniform_draws(s, d):
    return parts(s, d).select("cell_id", uniform(23, "cell_id").alias("u"))


def nearest_prior(s, d):
    """Nearest cell of each prior point, by planar and by great-circle distance."""
    p = parts(s, d)
    f = lambda fn: [F.min(F.struct(_r(fn(F.col("x"), F.col("y") / 20, F.lit(x), F.lit(y / 20))).alias("d2"), "cell_id")).alias(f"p{k}") for k, (x, y) in enumerate(PRIORS)]
    one, two = p.agg(*f(planar_sq)), p.agg(*f(haversine_sq))
    pick = lambda t, name: t.select(F.lit(name).alias("metric"), F.posexplode(F.array(*[F.col(f"p{k}.cell_id") for k in range(len(PRIORS))])).alias("prior_id", "cell_id"))
    return pick(one, "planar").unionByName(pick(two, "haversine"))


def _maxvol(method):
    def query(s, d):
        df = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("loc_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"), "p_retailprice", (F.col("p_partkey") * F.col("p_partkey") % 101).cast("double").alias("wave"))
        return doptimal.d_optimal(df, 20, method=method).samples

    return query


def _greedy_picks(s, d):
    """Greedy picks by two normalized features, in order."""
    df = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("loc_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("p_size").cast("double").alias("a"), "p_retailprice")
    return doptimal.d_optimal(df, PICKS, ["a", "p_retailprice"], add_coords=False).samples.select("sample_id", "loc_id")


def maxvol_coresets(s, d):
    """D-optimal picks among all orders, from core-sets of its parts."""
    o = s.read.parquet(f"{d}/orders.parquet")
    df = o.select(F.col("o_orderkey").alias("loc_id"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"), (F.col("o_orderkey") * F.col("o_orderkey") % 1013).cast("double").alias("wave"))
    return doptimal.d_optimal(df, 20, method="coresets").samples


def spaced_start(s, d):
    """Orders no two of which are nearer than NEAR, and near to one of which every other lies."""
    return spacing.spaced(places(s, d).withColumnRenamed("cell_id", "loc_id"), NEAR, 5).select("loc_id")


def _equal(s, cells, k: int, steps: int):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return strata.stratify(s, cells, k, equal_area=True, seed=9, max_iter=steps)


def equal_strata(s, d):
    """Sizes of equal-size strata of all orders, and the cells that would be cheaper elsewhere under the final prices."""
    cells = places(s, d)
    got = balance.equal_strata(cells, strata._seeds(cells, EQUAL, 9, 0, []))
    return balance.certificate(got, cells)


def swop_sizes(s, d):
    return metrics.stratum_counts(_equal(s, lots(s, d), 9, 1).cells)


def composite_sizes(s, d):
    """Cells and draws by stratum, and the composites among its draws."""
    got = samplers.composite(s, _equal(s, lots(s, d), 7, 1), n_composites=3)
    drawn = got.samples.groupBy("stratum_id").agg(F.count(F.lit(1)).alias("n_draws"), F.countDistinct("composite").alias("n_composites"))
    return metrics.stratum_counts(got.strata.cells).join(drawn, "stratum_id").select("stratum_id", "n_cells", "n_draws", "n_composites")


def _covered(seed: int, priors=None):
    def query(s, d):
        """One point a stratum; prior points are the first samples, as they are."""
        got = samplers.coverage(s, _stratified(s, d, seed, priors))
        return got.samples.select("sample_id", "stratum_id", "is_prior", _r("x").alias("x"), _r("y").alias("y"))

    return query


def coverage_equal_area_sizes(s, d):
    """The sizes of the strata that samples of equal-area coverage stand for."""
    got = samplers.coverage(s, _equal(s, lots(s, d), 8, 1))
    sizes = metrics.stratum_counts(got.strata.cells)
    return got.samples.join(sizes, "stratum_id").select("sample_id", "stratum_id", "n_cells")


def _plots(s, d):
    """A jagged outline with a hole for each nation, placed by its key."""
    n = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("poly_id"))
    ring = F.explode(F.array(*[F.struct(F.lit(r).alias("ring_id"), F.lit(k).alias("seq"), F.lit(x).alias("x"), F.lit(y).alias("y")) for r, points in enumerate(PLOT) for k, (x, y) in enumerate(points)])).alias("p")
    return n.select("poly_id", ring).select("poly_id", "p.ring_id", "p.seq", (F.col("p.x") + F.col("poly_id") * 37 % 70).cast("double").alias("x"), (F.col("p.y") + F.col("poly_id") * 53 % 70).cast("double").alias("y"))


def point_in_many(s, d):
    """Orders in each nation's plot."""
    return polygons.locate(places(s, d), _plots(s, d))


def nearest_of_many(s, d):
    """The nearest customer to each part, on a map of customers' balances."""
    c = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("stratum_id"), (F.col("c_custkey") % 50).cast("double").alias("x"), (F.col("c_acctbal") / 100).alias("y"))
    return nearest.nearest(lots(s, d), c).select("cell_id", "stratum_id", _r("d2").alias("d2"))


def group_medians(s, d):
    """Exact medians of order prices by status and day of the month, by rounds of histograms."""
    o = s.read.parquet(f"{d}/orders.parquet").select(F.concat_ws("-", "o_orderstatus", F.dayofmonth("o_orderdate") % 3).alias("stratum"), "o_totalprice")
    return quantiles.medians(o, "stratum", "o_totalprice")


_PARTS = "p AS (SELECT p_partkey AS cell_id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part)"
_NATIONS = "n AS (SELECT c_custkey AS cell_id, c_nationkey + 1 AS stratum_id, CAST(c_custkey % 1000 AS DOUBLE) AS x, c_acctbal AS y FROM customer)"
_PLACES = "g AS (SELECT o_orderkey AS cell_id, o_totalprice / 5000 AS x, CAST(o_custkey % 101 AS DOUBLE) AS y FROM orders)"
_LOTS = "q AS (SELECT p_partkey AS cell_id, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 97 AS DOUBLE) AS y FROM part), b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM q)"


def _lattice_sql(side: str) -> str:
    """CTEs q, b and g: the lattice of square cells over the rectangle around the parts."""
    return f"{_LOTS}, z AS (SELECT *, greatest(1, ceil((x1 - x0) / side - 1e-9))::BIGINT AS nx, greatest(1, ceil((y1 - y0) / side - 1e-9))::BIGINT AS ny FROM (SELECT *, CAST({side} AS DOUBLE) AS side FROM b)), g AS (SELECT i AS cell_id, CAST(i % nx AS INTEGER) AS ix, CAST(i // nx AS INTEGER) AS iy, x0 + (i % nx + 0.5::DOUBLE) * side AS x, y0 + (i // nx + 0.5::DOUBLE) * side AS y, x0, y0, x1, y1 FROM z, range(z.nx * z.ny) r(i))"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


def _fixed() -> str:
    return f"c0(k, cx, cy) AS (VALUES {_values([(k, *c) for k, c in enumerate(FIXED, 1)])})"


def _assign(k: int, cells: str = "p") -> str:
    """CTE a<k>: each cell's nearest of centers c<k>, the first of equals."""
    d2 = "(x - cx) * (x - cx) + (y - cy) * (y - cy)"
    return f"a{k} AS (SELECT cell_id, x, y, k AS stratum_id, d2 FROM (SELECT *, {d2} AS d2, row_number() OVER (PARTITION BY cell_id ORDER BY {d2}, k) AS r FROM {cells}, c{k}) WHERE r = 1)"


def _lloyd_sql(steps: int) -> str:
    ctes = [_PARTS, _fixed()]
    for k in range(steps):
        ctes += [_assign(k), f"c{k + 1} AS (SELECT c{k}.k, coalesce(m.mx, cx) AS cx, coalesce(m.my, cy) AS cy FROM c{k} LEFT JOIN (SELECT stratum_id, avg(x) AS mx, avg(y) AS my FROM a{k} GROUP BY 1) m ON m.stratum_id = c{k}.k)"]
    return f"WITH {', '.join(ctes)} SELECT CAST(k AS INTEGER) AS stratum_id, round(cx, 6) AS x, round(cy, 6) AS y FROM c{steps}"


def _tries_sql(k: int, n: int, seed: int) -> str:
    ctes = [_PARTS]
    for t in range(n):
        key = f"md5('{seed}:{t}:' || cell_id)"
        ctes += [f"s{t} AS (SELECT row_number() OVER (ORDER BY {key}, cell_id) AS k, x AS cx, y AS cy FROM p QUALIFY k <= {k})"]
        ctes += [_assign(0).replace("a0 ", f"b{t} ").replace("c0)", f"s{t})"), f"m{t} AS (SELECT s{t}.k, coalesce(m.mx, cx) AS cx, coalesce(m.my, cy) AS cy FROM s{t} LEFT JOIN (SELECT stratum_id, avg(x) AS mx, avg(y) AS my FROM b{t} GROUP BY 1) m ON m.stratum_id = s{t}.k)"]
        ctes += [_assign(0).replace("a0 ", f"e{t} ").replace("c0)", f"m{t})")]
    rows = " UNION ALL ".join(f"SELECT CAST({t} AS INTEGER) AS try_id, avg(d2) AS mssd FROM e{t}" for t in range(n))
    return f"WITH {', '.join(ctes)}, o AS ({rows}) SELECT try_id, round(mssd, 6) AS mssd, try_id = (SELECT try_id FROM o ORDER BY mssd, try_id LIMIT 1) AS is_best FROM o"


def _inside_sql(area: areas.Area) -> str:
    """Parity of crossings by polygon, or on an edge."""
    edges = f"e0(poly, ax, ay, bx, bend) AS (VALUES {_values(area.edges())}), e AS (SELECT poly, ax::DOUBLE AS ax, ay::DOUBLE AS ay, bx::DOUBLE AS bx, bend::DOUBLE AS bend FROM e0)"
    on = "((bx - ax) * (y - ay) - (bend - ay) * (x - ax) = 0 AND x BETWEEN least(ax, bx) AND greatest(ax, bx) AND y BETWEEN least(ay, bend) AND greatest(ay, bend))"
    crosses = "((ay > y) <> (bend > y) AND x < (bx - ax) * (y - ay) / CASE WHEN bend = ay THEN 1 ELSE bend - ay END + ax)"
    return f"WITH {_PLACES}, {edges}, h AS (SELECT cell_id, poly, max(CAST({on} AS INTEGER)) AS o, sum(CAST({crosses} AS INTEGER)) % 2 AS odd FROM g, e GROUP BY 1, 2) SELECT cell_id, x, y FROM g WHERE cell_id IN (SELECT cell_id FROM h WHERE o = 1 OR odd = 1)"


def _many_sql() -> str:
    """Every order against every edge of every plot."""
    edges = [(*a, *b) for ring in PLOT for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    on = "((bx - ax) * (y - ay) - (bend - ay) * (x - ax) = 0 AND x BETWEEN least(ax, bx) AND greatest(ax, bx) AND y BETWEEN least(ay, bend) AND greatest(ay, bend))"
    crosses = "((ay > y) <> (bend > y) AND x < (bx - ax) * (y - ay) / CASE WHEN bend = ay THEN 1 ELSE bend - ay END + ax)"
    shift = ", ".join(f"CAST({c} + n_nationkey * {m} % 70 AS DOUBLE) AS {c}" for c, m in (("ax", 37), ("ay", 53), ("bx", 37), ("bend", 53)))
    return f"WITH {_PLACES}, e0(ax, ay, bx, bend) AS (VALUES {_values(edges)}), e AS (SELECT n_nationkey AS poly_id, {shift} FROM nation, e0) SELECT cell_id, poly_id FROM g, e GROUP BY 1, 2 HAVING max(CAST({on} AS INTEGER)) = 1 OR sum(CAST({crosses} AS INTEGER)) % 2 = 1"


def _uniform_sql(seed: int, *parts: str) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:' || {" || ':' || ".join(parts)}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def _draw_sql(n: int, seed: int, dx: float = 0.0, dy: float = 0.0) -> str:
    u = lambda what: _uniform_sql(seed, f"'{what}'", "stratum_id", "draw")
    return f"WITH {_NATIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY stratum_id ORDER BY cell_id) AS rank FROM n), z AS (SELECT stratum_id, count(*) AS m FROM n GROUP BY 1), w AS (SELECT stratum_id, m, CAST(i AS INTEGER) AS draw FROM z, range(1, {n + 1}) r(i)), v AS (SELECT stratum_id, draw, floor({u('cell')} * m) + 1 AS rank, {u('dx')} AS ux, {u('dy')} AS uy FROM w), o AS (SELECT v.stratum_id, v.draw, k.cell_id, k.x + (ux - 0.5) * {dx} AS x, k.y + (uy - 0.5) * {dy} AS y FROM v JOIN k ON k.stratum_id = v.stratum_id AND k.rank = v.rank)"


def _random_sql(n: int, seed: int) -> str:
    """A triangle is one trapezoid whose upper side is a point: the share of its height is 1 - sqrt(1 - v)."""
    v, w = _uniform_sql(seed, "'y'", "i"), _uniform_sql(seed, "'x'", "i")
    return f"WITH {_LOTS}, o AS (SELECT i, {v} AS v, {w} AS w, 1 - sqrt(1 - {v}) AS s, b.* FROM b, range(1, {n + 1}) r(i)) SELECT CAST(i AS INTEGER) AS sample_id, round(x0 + 0.25 * (x1 - x0) * s + w * (1 - s) * (x1 - x0), 6) AS x, round(y0 + s * (y1 - y0), 6) AS y FROM o"


def _strata_sql(k: int, seed: int, fixed: bool = False, steps: int = 45) -> str:
    """CTEs that end with c<steps>(k, cx, cy) and a<steps>: from k seeds, or the kept prior points and seeds, so many steps.

    More steps than the tables here need, as a center that doesn't move stays where it is.
    """
    free = "p WHERE cell_id NOT IN (SELECT cell_id FROM keep)" if fixed else "p"
    ctes = [_PARTS.replace(" AS (", " AS MATERIALIZED (", 1)] + ([_NEAREST] if fixed else [])
    first = "(SELECT count(*) FROM keep)" if fixed else "0"
    seeds = f"SELECT {first} + row_number() OVER (ORDER BY md5('{seed}:0:' || cell_id), cell_id) AS k, x AS cx, y AS cy, false AS is_fixed FROM {free}"
    if fixed:
        seeds = f"SELECT row_number() OVER (ORDER BY keep.k) AS k, px AS cx, py AS cy, true AS is_fixed FROM keep JOIN q USING (k) UNION ALL {seeds}"
    ctes.append(f"c0 AS MATERIALIZED (SELECT * FROM ({seeds}) WHERE k <= {k})")
    for t in range(steps):
        ctes.append(_assign(t).replace(" AS (", " AS MATERIALIZED (", 1))
        ctes.append(f"c{t + 1} AS MATERIALIZED (SELECT c.k, CASE WHEN is_fixed THEN cx ELSE coalesce(m.mx, cx) END AS cx, CASE WHEN is_fixed THEN cy ELSE coalesce(m.my, cy) END AS cy, is_fixed FROM c{t} c LEFT JOIN (SELECT stratum_id, avg(x) AS mx, avg(y) AS my FROM a{t} GROUP BY 1) m ON m.stratum_id = c.k)")
    ctes.append(_assign(steps))
    return f"WITH {', '.join(ctes)}"


def _picks_sql(k: int) -> str:
    """Greedy picks by two features: the largest leverage, then the inverse without solving anew."""
    f = "f AS MATERIALIZED (SELECT p_partkey AS loc_id, (p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER () AS a, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER () AS b FROM part)"
    ctes = [f, "m0 AS (SELECT 1e9::DOUBLE AS p, 0::DOUBLE AS q, 1e9::DOUBLE AS r)"]
    for t in range(k):
        before = "".join(f" AND loc_id <> (SELECT loc_id FROM g{u})" for u in range(t))
        ctes.append(f"g{t} AS MATERIALIZED (SELECT f.*, p, q, r, a * (p * a + q * b) + b * (q * a + r * b) AS s FROM f, m{t} WHERE true{before} ORDER BY s DESC, loc_id LIMIT 1)")
        ctes.append(f"m{t + 1} AS MATERIALIZED (SELECT p - (p * a + q * b) * (p * a + q * b) / (1 + s) AS p, q - (p * a + q * b) * (q * a + r * b) / (1 + s) AS q, r - (q * a + r * b) * (q * a + r * b) / (1 + s) AS r FROM g{t})")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT CAST({t + 1} AS INTEGER) AS sample_id, loc_id FROM g{t}" for t in range(k))


def _spaced_sql(near: float, seed: int, rounds: int = 12) -> str:
    """Rounds: of each cell the first left, of those too near to each other the first; then all near to one go."""
    cell = lambda c: f"floor({c} / {near / 2**0.5!r}::DOUBLE)"
    d2 = "(m.x - n.x) * (m.x - n.x) + (m.y - n.y) * (m.y - n.y)"
    ctes = [_PLACES, f"u0 AS MATERIALIZED (SELECT cell_id, x, y, md5('{seed}:' || cell_id) AS key, {cell('x')} AS cx, {cell('y')} AS cy FROM g)"]
    for t in range(rounds):
        ctes.append(f"f{t} AS MATERIALIZED (SELECT * FROM u{t} QUALIFY row_number() OVER (PARTITION BY cx, cy ORDER BY key, cell_id) = 1)")
        ctes.append(f"w{t} AS MATERIALIZED (SELECT * FROM f{t} m WHERE NOT EXISTS (SELECT 1 FROM f{t} n WHERE {d2} < {near * near} AND (n.key < m.key OR n.key = m.key AND n.cell_id < m.cell_id)))")
        ctes.append(f"u{t + 1} AS MATERIALIZED (SELECT * FROM u{t} m WHERE NOT EXISTS (SELECT 1 FROM w{t} n WHERE {d2} < {near * near}))")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT cell_id AS loc_id FROM w{t}" for t in range(rounds))


def _sizes_sql(table: str, k: int, more: str = "") -> str:
    return f"SELECT CAST(i AS INTEGER) AS stratum_id, n // {k} + CASE WHEN i <= n % {k} THEN 1 ELSE 0 END AS n_cells{more} FROM (SELECT count(*) AS n FROM {table}), range(1, {k + 1}) r(i)"


_GINI = "2 * sum(r * n_cells) / (count(*) * sum(n_cells)) - (count(*) + 1) / count(*)"


def _efficiency_sql(counts: str) -> str:
    """counts: CTEs that end with t(stratum_id, n_cells)."""
    return f"WITH {counts}, r AS (SELECT *, row_number() OVER (ORDER BY n_cells, stratum_id) AS r FROM t), o AS (SELECT count(*) AS present, CAST(sum(n_cells) AS BIGINT) AS total_cells, avg(n_cells) AS mean, stddev_samp(n_cells) AS sd, min(n_cells) AS lo, max(n_cells) AS hi, {_GINI} AS g FROM r) SELECT present AS n_strata, total_cells, round_even(mean, 3) AS mean_cells, round_even(sd, 3) AS sd_cells, round_even(sd / mean, 3) AS cv, lo AS min_cells, hi AS max_cells, hi - lo AS range_cells, round_even(lo / hi, 3) AS min_max_ratio, round_even(g, 3) AS gini, CASE WHEN sd IS NULL THEN 'Excellent' WHEN sd / mean < 0.1 AND lo / hi > 0.9 THEN 'Excellent' WHEN sd / mean < 0.2 AND lo / hi > 0.75 THEN 'Good' WHEN sd / mean < 0.35 AND lo / hi > 0.5 THEN 'Fair' ELSE 'Poor' END AS efficiency_score FROM o"


_THREE = f"c0(k, cx, cy) AS (VALUES {_values([(k, *c) for k, c in enumerate(THREE, 1)])})"
_CLIPPED = "c AS (SELECT * FROM g WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)"


def _distance_sql(actual: bool, longlat: bool = False) -> str:
    cells = "m AS (SELECT cell_id, stratum_id, -80.0 + x / 1000 AS x, 35.0 + y / 100000 AS y FROM n)" if longlat else "m AS (SELECT * FROM n)"
    d2 = "pow(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(cy - y) / 2), 2) + cos(radians(y)) * cos(radians(cy)) * pow(sin(radians(cx - x) / 2), 2)))), 2)" if longlat else "(x - cx) * (x - cx) + (y - cy) * (y - cy)"
    return f"WITH {_NATIONS}, {cells}, c AS (SELECT stratum_id, avg(x) AS cx, avg(y) AS cy FROM m GROUP BY 1), d AS (SELECT stratum_id, {'sqrt' if actual else ''}({d2}) AS d FROM m JOIN c USING (stratum_id)), s AS (SELECT stratum_id, count(*) AS n, avg(d) AS a, stddev_samp(d) AS s, min(d) AS lo, max(d) AS hi, median(d) AS md FROM d GROUP BY 1) SELECT CAST(i AS INTEGER) AS stratum_id, coalesce(n, 0) AS n_cells, round(a, 4) AS mean_dist, round(s, 4) AS sd_dist, round(lo, 4) AS min_dist, round(hi, 4) AS max_dist, round(md, 4) AS median_dist FROM range(1, 31) r(i) LEFT JOIN s ON s.stratum_id = i"


def _nearest_prior_sql() -> str:
    hav = "pow(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(py / 20 - y / 20) / 2), 2) + cos(radians(y / 20)) * cos(radians(py / 20)) * pow(sin(radians(px - x) / 2), 2)))), 2)"
    plane = "(x - px) * (x - px) + (y / 20 - py / 20) * (y / 20 - py / 20)"
    one = lambda name, d2: f"SELECT '{name}' AS metric, CAST(k AS INTEGER) AS prior_id, cell_id FROM (SELECT k, cell_id, row_number() OVER (PARTITION BY k ORDER BY round({d2}, 6), cell_id) AS r FROM p, q) WHERE r = 1"
    return f"WITH {_PARTS}, q(k, px, py) AS (VALUES {_values([(k, *c) for k, c in enumerate(PRIORS)])}) {one('planar', plane)} UNION ALL {one('haversine', hav)}"


_NEAREST = f"q(k, px, py) AS (VALUES {_values([(k, *c) for k, c in enumerate(PRIORS, 1)])}), w AS (SELECT k, cell_id FROM (SELECT k, cell_id, row_number() OVER (PARTITION BY k ORDER BY (x - px) * (x - px) + (y - py) * (y - py), cell_id) AS r FROM p, q) WHERE r = 1), keep AS (SELECT k, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY k) AS r FROM w) WHERE r = 1)"

#: Each query with its SQL, None where SQL has no form for it.
QUERIES: dict = {
    "grid_cells": (grid_cells, f"WITH {_lattice_sql('1.5')} SELECT cell_id, ix, iy, round(x, 6) AS x, round(y, 6) AS y FROM g"),
    "grid_clip": (grid_clip, f"WITH {_lattice_sql('sqrt((x1 - x0) * (y1 - y0) / 2500)')} SELECT count(*) AS n, round(sum(x), 3) AS sum_x, round(sum(y), 3) AS sum_y FROM g WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"),
    "point_in_triangle": (_pip(TRIANGLE), _inside_sql(TRIANGLE)),
    "point_in_holed_ring": (_pip(HOLED), _inside_sql(HOLED)),
    "point_in_two_parts": (_pip(TWO_PARTS), _inside_sql(TWO_PARTS)),
    "point_cells": (point_cells, f"WITH {_PARTS} SELECT row_number() OVER (ORDER BY cell_id) - 1 AS cell_id, cell_id AS part_id, x, round(y, 6) AS y FROM p WHERE cell_id % 3 > 0"),
    "lloyd_strata": (lloyd_strata, _strata_sql(5, 3) + " SELECT CAST(k AS INTEGER) AS stratum_id, n_cells, round(cx, 6) AS x, round(cy, 6) AS y FROM c45 JOIN (SELECT stratum_id, count(*) AS n_cells FROM a45 GROUP BY 1) n ON n.stratum_id = k"),
    "uniform_draws": (uniform_draws, f"WITH {_PARTS} SELECT cell_id, {_uniform_sql(23, 'cell_id')} AS u FROM p"),
    "seed_cells": (seed_cells, f"WITH {_PARTS} SELECT cell_id FROM p ORDER BY md5('7:0:' || cell_id), cell_id LIMIT 12"),
    "balanced_labels": (balanced_labels, f"WITH {_PARTS} SELECT cell_id, CAST((row_number() OVER (ORDER BY md5('7:0:' || cell_id), cell_id) - 1) % 7 AS INTEGER) AS label FROM p"),
    "assign_nearest": (assign_nearest, f"WITH {_PARTS}, {_fixed()}, {_assign(0)} SELECT cell_id, CAST(stratum_id AS INTEGER) AS stratum_id, round(d2, 6) AS d2 FROM a0"),
    "single_step": (single_step, _lloyd_sql(1)),
    "lloyd_3_steps": (lloyd_3_steps, _lloyd_sql(3)),
    "mssd": (mssd, f"WITH {_PARTS}, {_fixed()}, {_assign(0)} SELECT round(avg(d2), 6) AS mssd FROM a0"),
    "best_of_tries": (best_of_tries, _tries_sql(4, 3, 3)),
    "nearest_prior": (nearest_prior, _nearest_prior_sql()),
    "prior_dedupe": (prior_dedupe, f"WITH {_PARTS}, {_NEAREST} SELECT CAST(k AS INTEGER) AS prior_id, cell_id FROM keep"),
    "prior_exclude": (prior_exclude, f"WITH {_PARTS}, {_NEAREST} SELECT cell_id FROM p WHERE NOT EXISTS (SELECT 1 FROM keep WHERE keep.cell_id = p.cell_id)"),
    "prior_strata": (prior_strata, _strata_sql(6, 5, True, STEPS) + " SELECT CAST(k AS INTEGER) AS stratum_id, is_fixed, round(cx, 6) AS x, round(cy, 6) AS y FROM c12"),
    "simple_random": (simple_random, _random_sql(500, 11)),
    "stratified_draw": (stratified_draw, _draw_sql(3, 13, 1.0, 2.0) + " SELECT stratum_id, draw, cell_id, round(x, 6) AS x, round(y, 6) AS y FROM o"),
    "composite_draw": (composite_draw, _draw_sql(4, 17) + " SELECT stratum_id, CAST(row_number() OVER (ORDER BY stratum_id, draw) AS INTEGER) AS sample_id, draw AS composite, cell_id FROM o"),
    "coverage_relocate": (coverage_relocate, f"WITH {_NATIONS}, c AS (SELECT stratum_id, avg(x) AS cx, avg(y) AS cy FROM n GROUP BY 1), d AS (SELECT n.*, cx, cy, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM n JOIN c USING (stratum_id)), b AS (SELECT *, row_number() OVER (PARTITION BY stratum_id ORDER BY d2, cell_id) AS r FROM d) SELECT stratum_id, round(CASE WHEN sqrt(d2) > 5.0 THEN x ELSE cx END, 6) AS x, round(CASE WHEN sqrt(d2) > 5.0 THEN y ELSE cy END, 6) AS y FROM b WHERE r = 1"),
    "stratum_counts": (stratum_counts, f"WITH {_NATIONS} SELECT stratum_id, count(*) AS n_cells FROM n GROUP BY 1"),
    "stratum_area": (stratum_area, f"WITH {_NATIONS} SELECT stratum_id, count(*) * 3.0::DOUBLE AS area FROM n GROUP BY 1"),
    "relative_area": (relative_area, f"WITH {_NATIONS} SELECT stratum_id, round(count(*) / sum(count(*)) OVER (), 9) AS relative_area FROM n GROUP BY 1"),
    "coverage_efficiency": (coverage_efficiency, _efficiency_sql(f"{_NATIONS}, t AS (SELECT stratum_id, count(*) AS n_cells FROM n GROUP BY 1)")),
    "grid_efficiency": (grid_efficiency, _efficiency_sql(f"{_lattice_sql('2.0')}, {_CLIPPED}, {_THREE}, {_assign(0, 'c')}, t AS (SELECT stratum_id, count(*) AS n_cells FROM a0 GROUP BY 1)")),
    "gini": (gini, f"WITH {_NATIONS}, t AS (SELECT stratum_id, count(*) AS n_cells FROM n GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n_cells, stratum_id) AS r FROM t) SELECT round({_GINI}, 9) AS gini FROM r"),
    "distance_summary": (_distances(False), _distance_sql(False)),
    "distance_summary_actual": (_distances(True), _distance_sql(True)),
    "distance_summary_haversine": (_distances(False, True), _distance_sql(False, True)),
    "haversine_centroid": (haversine_centroid, f"WITH {_NATIONS}, m AS (SELECT stratum_id, radians(-80.0 + x / 1000) AS x, radians(35.0 + y / 100000) AS y FROM n), v AS (SELECT stratum_id, avg(cos(y) * cos(x)) AS a, avg(cos(y) * sin(x)) AS b, avg(sin(y)) AS c FROM m GROUP BY 1) SELECT stratum_id, round(degrees(atan2(b, a)), 8) AS x, round(degrees(asin(c / sqrt(a * a + b * b + c * c))), 8) AS y FROM v"),
    "stratum_boundaries": (stratum_boundaries, f"WITH {_LOTS}, g AS (SELECT row_number() OVER (ORDER BY x, y) AS cell_id, x, y FROM (SELECT DISTINCT x, y % 25 AS y FROM q) WHERE x <> 7 AND y <> 11), c0(k, cx, cy) AS (VALUES (1, 10.0, 5.0), (2, 40.0, 8.0), (3, 25.0, 20.0)), {_assign(0, 'g')}, k AS (SELECT x, y, stratum_id AS s, dense_rank() OVER (ORDER BY x) AS rx, dense_rank() OVER (ORDER BY y) AS ry FROM a0) SELECT (a.x + b.x) / 2 AS x1, a.y - 0.5 AS y1, (a.x + b.x) / 2 AS x2, a.y + 0.5 AS y2 FROM k a JOIN k b ON a.rx = b.rx + 1 AND a.ry = b.ry WHERE a.s <> b.s UNION ALL SELECT a.x - 0.5, (a.y + b.y) / 2, a.x + 0.5, (a.y + b.y) / 2 FROM k a JOIN k b ON a.rx = b.rx AND a.ry = b.ry + 1 WHERE a.s <> b.s"),
    "sample_summary": (sample_summary, f"WITH {_PARTS} SELECT 'coverage' AS method, count(*) AS n_samples, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM p"),
    "point_types": (point_types, "SELECT c_custkey AS sample_id, c_nationkey < 3 AS is_prior, CASE WHEN c_nationkey < 3 THEN 'Prior' ELSE 'New' END AS point_type FROM customer"),
    "to_data_frame": (to_data_frame, f"WITH {_PARTS} SELECT cell_id AS sample_id, x AS X, y AS Y FROM p"),
    "geojson_rows": (geojson_rows, """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || p_size || ',' || (p_partkey % 50) || ']},"properties":{"p_partkey":' || p_partkey || '}}' AS value FROM part"""),
    "normalize_features": (normalize_features, "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS p_retailprice FROM part"),
    "min_dist_exclusion": (min_dist_exclusion, f"WITH {_PARTS}, {_fixed()} SELECT cell_id FROM p WHERE NOT EXISTS (SELECT 1 FROM c0 WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) < 144.0)"),
    "leverage_top": (leverage_top, f"WITH {_PARTS} SELECT cell_id, round(2 * x * x + 0.5 * x * y + 0.5 * y * y, 4) AS leverage FROM p ORDER BY 2 * x * x + 0.5 * x * y + 0.5 * y * y DESC, cell_id LIMIT 1"),
    "linear_projection": (linear_projection, f"WITH {_PARTS} SELECT cell_id, round(greatest(abs(x * 0.25 - y * 0.5), abs(x * 2.0 + y * 0.125)), 6) AS score FROM p"),
    "gram_matrix": (gram_matrix, "WITH f AS (SELECT [CAST(p_size AS DOUBLE), p_retailprice / 100, CAST(p_partkey % 13 AS DOUBLE)] AS f FROM part) SELECT CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j, round(sum(f[a] * f[b]), 3) AS value FROM f, range(1, 4) x(a), range(1, 4) y(b) WHERE a <= b GROUP BY a, b"),
    "greedy_picks": (_greedy_picks, _picks_sql(PICKS)),
    "maxvol_greedy": (_maxvol("greedy"), None),
    "maxvol_coresets": (maxvol_coresets, None),
    "maxvol_pivot": (_maxvol("pivot"), None),
    "spaced_start": (spaced_start, _spaced_sql(NEAR, 5)),
    "equal_strata": (equal_strata, _sizes_sql("orders", EQUAL, ", 0::BIGINT AS n_cheaper")),
    "swop_sizes": (swop_sizes, _sizes_sql("part", 9)),
    "composite_sizes": (composite_sizes, _sizes_sql("part", 7, ", 3::BIGINT AS n_draws, 3::BIGINT AS n_composites")),
    "coverage_sample": (_covered(4), _strata_sql(6, 4, False, STEPS) + " SELECT CAST(k AS INTEGER) AS sample_id, CAST(k AS INTEGER) AS stratum_id, false AS is_prior, round(cx, 6) AS x, round(cy, 6) AS y FROM c12"),
    "coverage_priors": (_covered(5, list(PRIORS)), _strata_sql(6, 5, True, STEPS) + " SELECT CAST(k AS INTEGER) AS sample_id, CAST(k AS INTEGER) AS stratum_id, is_fixed AS is_prior, round(cx, 6) AS x, round(cy, 6) AS y FROM c12"),
    "coverage_equal_area_sizes": (coverage_equal_area_sizes, f"SELECT stratum_id AS sample_id, stratum_id, n_cells FROM ({_sizes_sql('part', 8)})"),
    "point_in_many": (point_in_many, _many_sql()),
    "nearest_of_many": (nearest_of_many, f"WITH {_LOTS}, c AS (SELECT c_custkey AS k, CAST(c_custkey % 50 AS DOUBLE) AS cx, c_acctbal / 100 AS cy FROM customer), d AS (SELECT cell_id, min({{'d2': (x - cx) * (x - cx) + (y - cy) * (y - cy), 'k': k}}) AS m FROM q, c GROUP BY 1) SELECT cell_id, m.k AS stratum_id, round(m.d2, 6) AS d2 FROM d"),
    "group_medians": (group_medians, "SELECT o_orderstatus || '-' || (day(o_orderdate) % 3) AS stratum, median(o_totalprice) AS median FROM orders GROUP BY 1"),
}


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
