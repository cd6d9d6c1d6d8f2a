"""Ranks, medians, spaced points and equal sizes against brute force."""

import math
import random

import duckdb
import numpy as np
import pytest
from compare import rows_of
from pyspark.sql import functions as F

from quadrant.functions.quantiles import medians
from quadrant.functions.ranks import ranked
from quadrant.operators import balance, samplers, spacing
from quadrant.operators.strata import seed_cells, stratify, within_sse
from quadrant.plans import registry
from quadrant.sources import areas
from quadrant.sources.areas import Area

SQUARE = Area.rectangle(0, 0, 100, 100)


def test_ranks_of_groups_with_ties_and_nulls(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a"] * 8 + ["b", None]), rng.choice([None, 1.0, 2.0, rng.random()])) for k in range(800)]
    df = spark.createDataFrame(rows, "id long, g string, x double").repartition(7)
    got = {r.id: (r["rank"], r.n) for r in ranked(df, ["x", "id"], ["g"], total="n").collect()}
    for g in ("a", "b", None):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [got[r[0]] for r in mine] == [(k, len(mine)) for k in range(len(mine))]
    assert sorted(r["rank"] for r in ranked(df.select("g"), ["g"]).collect()) == list(range(800))  # nothing but ties
    assert ranked(df.limit(0), ["x"]).collect() == []


def test_medians(spark, monkeypatch):
    from quadrant.functions import quantiles

    monkeypatch.setattr(quantiles, "FEW", 5)
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    rng = np.random.default_rng(2)
    rows = [(int(g), float(v)) for g, v in zip(rng.choice(4, 900, p=[0.7, 0.2, 0.09, 0.01]), np.where(rng.random(900) < 0.3, 2.5, rng.lognormal(0, 9, 900)), strict=True)]
    df = spark.createDataFrame([*rows, (0, None), (1, float("nan")), (9, None)], "g int, v double")
    assert {r.g: r.m for r in medians(df, "g", "v", "m").collect()} == {g: float(np.median([v for h, v in rows if h == g])) for g in range(4)}


def spaced_is_right(points, chosen, near):
    assert chosen and all(math.dist(a, b) >= near for i, a in enumerate(chosen) for b in chosen[:i])
    assert all(min(math.dist(p, c) for c in chosen) < near or p in chosen for p in points)


def test_spaced(spark):
    rng = random.Random(3)
    points = [(1.5, -2.5) if k % 3 == 0 else (rng.uniform(-10, 10), rng.uniform(-10, 10)) for k in range(600)]
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(points)] + [(900, None, 1.0), (901, float("nan"), 1.0)], "loc_id long, x double, y double")
    got = spacing.spaced(df, 1.5, 4).collect()
    spaced_is_right(points, [(r.x, r.y) for r in got], 1.5)
    again = spacing.spaced(df.repartition(5), 1.5, 4).collect()
    assert sorted(r.loc_id for r in got) == sorted(r.loc_id for r in again)
    assert spacing.spaced(df.limit(0), 1.5).count() == 0
    with pytest.raises(ValueError):
        spacing.spaced(df, 0.0)


def exchanged(points, k, seed):
    """Sum of squares after exchanging labels of cells, dealt at random, while any exchange lowers it."""
    xy, n = np.array(points), len(points)
    label = np.random.default_rng(seed).permutation(n) % k
    better = True
    while better:
        better = False
        for i in range(n):
            means = np.array([xy[label == c].mean(0) for c in range(k)])
            d = ((xy[:, None] - means[None]) ** 2).sum(2)
            gain = d[i, label[i]] + d[np.arange(n), label] - d[i, label] - d[:, label[i]]
            gain[label == label[i]] = 0
            j = int(gain.argmax())
            if gain[j] > 1e-9:
                label[i], label[j], better = label[j], label[i], True
    means = np.array([xy[label == c].mean(0) for c in range(k)])
    return float(((xy - means[label]) ** 2).sum())


def test_equal_sizes_are_no_worse_than_exchange(spark):
    cells = areas.grid(spark, SQUARE, 400)
    points = [(r.x, r.y) for r in cells.collect()]
    got = stratify(spark, SQUARE, 9, n_cells=400, equal_area=True)
    assert sorted(r["count"] for r in got.cells.groupBy("stratum_id").count().collect()) == [44] * 5 + [45] * 4
    assert within_sse(got) <= np.mean([exchanged(points, 9, s) for s in range(4)]) * 1.005


def test_equal_strata_are_scored_by_compiled_passes(spark, monkeypatch):
    """No pass over the cells of equal strata looks at an array of centers, which isn't compiled; the score is brute force's."""
    from quadrant.operators import strata

    def interpreted(*_):
        raise AssertionError("an array of centers")

    monkeypatch.setattr(strata, "nearest_center", interpreted)
    for k, n_try in ((1, 1), (7, 2)):
        got = stratify(spark, SQUARE, k, n_cells=400, n_try=n_try, equal_area=True)
        xy, c = (np.array([(r.x, r.y) for r in df.collect()]) for df in (got.cells, got.centroids))
        assert len(got.tries) == n_try and got.mssd == min(got.tries) == pytest.approx(((xy[:, None] - c[None]) ** 2).sum(2).min(1).mean())


def test_equal_sizes_of_crowded_cells_have_a_certificate(spark):
    """A third of the cells in one place, more than any stratum holds."""
    rng = random.Random(6)
    rows = [(k, 5.0, 5.0) if k % 3 == 0 else (k, rng.gauss(0, 20), rng.gauss(0, 20)) for k in range(302)]
    cells = spark.createDataFrame(rows, "cell_id long, x double, y double")
    seeds = [(r.x, r.y) for r in seed_cells(cells.where("cell_id % 3 > 0"), 4, 1).collect()]
    got = balance.equal_strata(cells, seeds, 1)
    found = balance.certificate(got, cells).collect()
    assert sorted(r.n_cells for r in found) == [75, 75, 76, 76] and sum(r.n_cheaper for r in found) == 0


def test_equal_sizes_of_many_copies_take_few_jobs(spark):
    """Hundreds of cells in each place of a lattice, and two seeds in one place: jobs don't grow with the cells to move."""
    cells = spark.range(60 * 400).selectExpr("id AS cell_id", "double(id % 20) AS x", "double(id % 400 div 20) AS y")
    spark.sparkContext.setJobGroup("copies", "copies")
    got = balance.equal_strata(cells, [(3.0, 3.0), (3.0, 3.0), (15.0, 4.0), (2.0, 17.0), (9.0, 9.0), (17.0, 17.0), (11.0, 2.0)], 1)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("copies"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    found = {r.stratum_id: (r.n_cells, r.n_cheaper) for r in balance.certificate(got, cells).collect()}
    assert found == {k: (n, 0) for k, n in enumerate(balance.capacities(24000, 7), 1)} and jobs < 40


def test_chains_are_cheapest():
    """Against the least sum over all ways to deal seven places, some of several cells, to three strata."""
    from itertools import product

    rng = np.random.default_rng(4)
    for _ in range(5):
        d2, weight = rng.integers(0, 30, (7, 3)).astype(float), rng.integers(1, 3, 7)
        each = np.repeat(np.arange(7), weight)
        want = np.array(balance.capacities(len(each), 3))
        least = min(d2[each, list(w)].sum() for w in product(range(3), repeat=len(each)) if (np.bincount(w, minlength=3) == want).all())
        prices, share = balance._settled(d2, weight, want, np.zeros(3))
        assert (share.sum(0) == want).all() and (share.sum(1) == weight).all() and (share * d2).sum() == least
        assert ((d2 + prices)[share > 0] <= np.repeat((d2 + prices).min(1)[:, None], 3, 1)[share > 0] + 1e-9).all()


def test_capacities():
    assert balance.capacities(10, 4) == [3, 3, 2, 2] and balance.capacities(3, 3) == [1, 1, 1]


def test_numbering_draws_reads_no_cells(spark, monkeypatch):
    """Draws are numbered from a table of them, not by joining them with all cells again; they are cells of their strata."""
    read, real = [], samplers.ranked
    monkeypatch.setattr(samplers, "ranked", lambda df, *a, **k: (read.append(df.inputFiles()), real(df, *a, **k))[1])
    cells = spark.range(300).selectExpr("id AS cell_id", "double(id % 20) AS x", "double(id div 20) AS y")
    strata = stratify(spark, cells, 4, equal_area=True)
    got = samplers.composite(spark, strata, n_composites=3).samples.collect()
    assert read[-1] and all("/numbered-" in f for f in read[-1])
    of = {(r.x, r.y): r.stratum_id for r in strata.cells.collect()}
    assert sorted((r.sample_id, r.stratum_id, r.composite) for r in got) == [(3 * k + c, k + 1, c) for k in range(4) for c in (1, 2, 3)]
    assert all(of[r.x, r.y] == r.stratum_id for r in got)


def test_trapezoids_cover_areas_once(spark):
    holed = Area(((((0, 0), (10, 0), (10, 10), (0, 10)), ((4, 4), (6, 4), (6, 6), (4, 6))), (((8, 8), (14, 8), (14, 14), (8, 14)),)))
    assert sum(t.size() for t in areas.trapezoids(holed)) == pytest.approx(96 + 36 - 4)
    crossed = Area(((((0, 0), (10, 0), (10, 2), (0, 2)),), (((4, -4), (6, -4), (6, 6), (4, 6)),)))
    assert sum(t.size() for t in areas.trapezoids(crossed)) == pytest.approx(20 + 20 - 4)
    thin = Area(((((0, 0), (1000, 1000), (1000, 1000.001)),),))
    points = samplers.simple_random(spark, thin, 200, seed=5).samples
    assert points.count() == 200 and points.where("x < 0 OR x > 1000 OR abs(y - x) > 0.0011").count() == 0
    drawn = samplers.simple_random(spark, holed, 3000, seed=5).samples
    assert areas.inside(drawn.withColumnRenamed("sample_id", "cell_id"), holed).count() == 3000
    assert abs(drawn.where("x > 10 OR y > 10").count() / 3000 - 32 / 128) < 0.03


def test_points_on_the_sphere_are_uniform_by_area(spark):
    belt = Area.rectangle(-80, 0, -70, 80, longlat=True)
    sines = [math.sin(math.radians(r.y)) for r in samplers.simple_random(spark, belt, 2000).samples.collect()]
    assert np.mean(sines) == pytest.approx(math.sin(math.radians(80)) / 2, abs=0.02)


def test_point_cells_are_numbered(spark):
    df = spark.createDataFrame([(7, 1.0, 2.0), (3, 1.0, 2.0), (5, None, 2.0), (9, float("inf"), 0.0)], "k long, x double, y double")
    assert {r.k: r.cell_id for r in areas.point_cells(df, ["k"]).collect()} == {3: 0, 7: 1}
    assert areas.bounding_area(df.where("k < 5")).bbox == (1.0, 2.0, 1.0, 2.0)
    with pytest.raises(ValueError):
        areas.bounding_area(df.where(F.lit(False)))


def test_nearest_of_crowded_centers(spark):
    from quadrant.operators.nearest import nearest

    rng = np.random.default_rng(1)
    c = np.r_[rng.normal(5, 1e-4, (150, 2)), rng.random((100, 2)) * 100, [[5, 5]] * 3]
    p = np.r_[rng.random((300, 2)) * 140 - 20, [[5, 5]] * 3, c[:20]]
    centers = spark.createDataFrame([(k + 1, float(x), float(y)) for k, (x, y) in enumerate(c)] + [(0, None, 1.0)], "stratum_id int, x double, y double")
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(p)] + [(999, float("nan"), 1.0)], "cell_id long, x double, y double")
    d = ((p[:, None] - c[None]) ** 2).sum(2)
    got = {r.cell_id: (r.stratum_id, r.d2) for r in nearest(points, centers).collect()}
    assert got == {k: (int(d[k].argmin()) + 1, pytest.approx(float(d[k].min()))) for k in range(len(p))}
    assert nearest(points, centers.limit(0)).count() == 0


def test_many_polygons(spark):
    """Stars of few and of many corners, far apart, overlapping and with holes, against one area at a time."""
    from quadrant.sources import polygons

    rng, rows, each = random.Random(1), [], {}
    for k, n in enumerate((3, 5, 40, 200, 4)):
        cx, cy, size = rng.uniform(30, 60), rng.uniform(30, 60), (0.01, 3, 12, 20, 8)[k]
        turn = [2 * math.pi * i / n for i in range(n)]
        ring = [(cx + rng.uniform(size / 2, size) * math.cos(t), cy + rng.uniform(size / 2, size) * math.sin(t)) for t in turn]
        ring = [(20.0, 20.0), (60.0, 20.0), (60.0, 50.0), (20.0, 50.0)] if k == 4 else ring
        hole = [(cx - size / 9, cy - size / 9), (cx + size / 9, cy - size / 9), (cx, cy + size / 9)]
        rows += [(k, r, i, *p) for r, points in enumerate((ring, hole)) for i, p in enumerate(points)]
        each[k] = Area(((tuple(ring), tuple(hole)),))
    rings = spark.createDataFrame(rows, "poly_id int, ring_id int, seq int, x double, y double")
    points = [(i, rng.uniform(10, 80), rng.uniform(10, 80)) for i in range(500)] + [(900 + i, *p) for i, p in enumerate([(20.0, 20.0), (40.0, 20.0), (60.0, 50.0), (60.0, 50.1)])] + [(990, rows[0][3], rows[0][4])]
    df = spark.createDataFrame([*points, (991, None, 1.0)], "cell_id long, x double, y double")
    got = sorted((r.cell_id, r.poly_id) for r in polygons.locate(df, rings).collect())
    assert got == sorted((r.cell_id, k) for k, a in each.items() for r in areas.inside(df, a).collect())
    assert polygons.locate(df, rings.limit(0)).count() == 0
    squares = polygons.cover(polygons.edges_of(rings))[0].collect()
    assert any(q.whole for q in squares) and len({q.level for q in squares}) > 3


def _equal_jobs(spark, cells, seeds) -> tuple[dict, int]:
    """(cells and cheaper ones by stratum, jobs) of balance.equal_strata."""
    spark.sparkContext.setJobGroup("equal", "equal")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("equal"))
    got = balance.equal_strata(cells, seeds, 1)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("equal")) - before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return {r.stratum_id: (r.n_cells, r.n_cheaper) for r in balance.certificate(got, cells).collect()}, jobs


def test_equal_sizes_take_no_more_jobs_for_copies(spark):
    """4000 places in pairs all over a square, 5 and 400 times: how often squares get finer depends on places, not on the cells in them."""
    seeds, found = [(0.1 * (k * 7 % 12), 0.1 * (k * 5 % 11)) for k in range(12)], {}
    for copies in (5, 400):
        cells = spark.range(4000 * copies).selectExpr("id AS cell_id", "(id % 4000 div 2) * 0.6180339887498949D % 1 + id % 2 * 1e-9D AS x", "(id % 4000 div 2) * 0.7548776662466927D % 1 AS y")
        sizes, found[copies] = _equal_jobs(spark, cells, seeds)
        assert sizes == {k: (n, 0) for k, n in enumerate(balance.capacities(4000 * copies, 12), 1)}
    assert found[400] <= found[5], found


def test_equal_sizes_of_places_that_no_square_parts(spark):
    """0 and 1e-17 seen from -1 are one number, and more cells lie there than places are counted at once."""
    cells = spark.range(400_000).selectExpr("id AS cell_id", "CASE id % 4 WHEN 0 THEN -1D WHEN 1 THEN 0D WHEN 2 THEN 1e-17D ELSE 1D END AS x", "0D AS y")
    sizes, jobs = _equal_jobs(spark, cells, [(-1.0, 0.0), (1.0, 0.0)])
    assert sizes == {1: (200_000, 0), 2: (200_000, 0)} and jobs < 30


@pytest.mark.parametrize("name", ["coverage_equal_area_sizes", "composite_sizes"])
def test_equal_area_queries_take_few_jobs_for_copies(spark, name, tmp_path):
    """All parts of sf0.1 six times with shifted keys: sizes by SQL, in about as many jobs as for one copy."""
    part = spark.read.parquet("/root/testdata/sf0.1/part.parquet").crossJoin(spark.range(6).withColumnRenamed("id", "c"))
    part.withColumn("p_partkey", part.p_partkey + 20000 * part.c).drop("c").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.sparkContext.setJobGroup(name, name)
    rows = registry.queries()[name](spark, str(tmp_path)).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = duckdb.sql(registry.oracle_sql()[name].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'"))
    assert rows_of(rows[0].__fields__, rows) == rows_of(want.columns, want.fetchall()) and jobs < 70, jobs


def test_equal_strata_query_goes_on_until_nothing_is_gained(spark, monkeypatch):
    """The query's strata have converged: another step from their means gains less than sums of squares are told apart by."""
    seen, certificate = [], balance.certificate
    monkeypatch.setattr(balance, "certificate", lambda found, cells: seen.append((found, cells)) or certificate(found, cells))
    registry.queries()["equal_strata"](spark, "/root/testdata/sf0.001").collect()
    (found, cells), fill = seen[0], balance._Filling(seen[0][1])
    again = fill(found.means, found.prices, np.array(balance.capacities(fill.n, len(found.means)), np.int64))
    means = again.assign(cells).groupBy("stratum_id").agg((F.count(F.lit(1)) * (F.var_pop("x") + F.var_pop("y"))).alias("cost"))
    assert found.converged and means.agg(F.sum("cost")).first()[0] >= found.cost * (1 - 1e-6)
