import math
import warnings

import pytest
from pyspark.sql import functions as F

from quadrant.functions.distance import haversine_sq_of
from quadrant.functions.rng import uniform
from quadrant.operators import layers, metrics, samplers, strata
from quadrant.operators.strata import balanced_labels, nearest_center, prepare_priors, stratify, within_sse
from quadrant.sources import areas
from quadrant.sources.areas import Area

RECT, SQUARE = Area.rectangle(0, 0, 100, 50), Area.rectangle(0, 0, 100, 100)
LONGLAT = Area.rectangle(-80, 35, -79, 36, longlat=True)


def test_grid_counts(spark):
    assert areas.grid(spark, RECT).count() == 2485
    assert areas.grid(spark, SQUARE, 400).count() == 400
    assert areas.grid(spark, RECT, cell_size=5).count() == 200
    with pytest.raises(ValueError):
        areas.grid(spark, RECT, cell_size=0)


def test_polygons_with_holes_parts_and_edges(spark):
    holed = Area(((((0, 0), (10, 0), (10, 10), (0, 10)), ((4, 4), (6, 4), (6, 6), (4, 6))),))
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 0.0, 5.0), (4, 4.0, 5.0), (5, 10.0, 10.0), (6, 11.0, 1.0)], "cell_id long, x double, y double")
    assert {r.cell_id for r in areas.inside(points, holed).collect()} == {2, 3, 4, 5}
    twice = Area(((((0, 0), (8, 0), (8, 8), (0, 8)),), (((2, 2), (10, 2), (10, 10), (2, 10)),)))
    assert {r.cell_id for r in areas.inside(points, twice).collect()} == {1, 2, 3, 4, 5}


def test_ring_table_round_trip(spark):
    rows = [(1, 0, False, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)])]
    assert Area.from_rings(spark.createDataFrame(rows, "poly_id int, ring_id int, is_hole boolean, seq int, x double, y double")).bbox == (0, 0, 4, 4)


def test_uniform_does_not_depend_on_partitions(spark):
    ids = spark.range(100)
    one = [r.u for r in ids.repartition(1).orderBy("id").select(uniform(3, "id").alias("u")).collect()]
    assert one == [r.u for r in ids.repartition(7).orderBy("id").select(uniform(3, "id").alias("u")).collect()]
    assert 0 <= min(one) and max(one) < 1


def test_lloyd_improves_on_single_step_and_on_any_partitioning(spark):
    step = stratify(spark, SQUARE, 9, n_cells=400, algorithm="single_step")
    full = stratify(spark, SQUARE, 9, n_cells=400)
    assert full.converged and full.mssd <= step.mssd and step.iterations == 1
    cells = areas.grid(spark, SQUARE, 400)
    again = stratify(spark, cells.repartition(7), 9)
    assert [tuple(r) for r in again.centroids.orderBy("stratum_id").collect()] == [tuple(r) for r in full.centroids.orderBy("stratum_id").collect()]


@pytest.mark.parametrize("area", [SQUARE, LONGLAT])
def test_carried_bounds_give_the_steps_of_full_scans(spark, area):
    cells = areas.grid(spark, area, 400)
    x0, y0, x1, y1 = area.bbox
    start = [(x0 + (x1 - x0) * a, y0 + (y1 - y0) * b) for a, b in ((0.2, 0.3), (0.7, 0.6), (0.1, 0.9), (0.15, 0.85), (0.9, 0.1))]
    bounded, centers, before, measured = strata._Lloyd(cells, area.longlat), start, None, []
    for _ in range(8):
        step = {0: centers} if before is None else {0: centers}
        got, n = bounded.step(step, None if before is None else {0: before})[0]
        full, every = strata._Lloyd(cells, area.longlat).step({0: centers})[0]
        assert got == full and every == 400
        before, centers = centers, strata._moved(centers, got, 0)
        measured.append(n)
    assert measured[0] == 400 and measured[-1] < 200


def test_best_of_tries(spark):
    got = stratify(spark, SQUARE, 5, n_cells=400, n_try=4, algorithm="single_step")
    assert got.mssd == min(got.tries) and len(got.tries) == 4


def test_priors_are_fixed_and_first(spark):
    got = stratify(spark, RECT, 5, [(25.0, 25.0), (75.0, 25.0)], n_cells=500)
    first = got.centroids.orderBy("stratum_id").collect()
    assert [(r.x, r.y, r.is_fixed) for r in first[:2]] == [(25.0, 25.0, True), (75.0, 25.0, True)] and not first[2].is_fixed
    samples = samplers.coverage(spark, got).samples.orderBy("sample_id").collect()
    assert [(r.x, r.y, r.is_prior) for r in samples[:2]] == [(25.0, 25.0, True), (75.0, 25.0, True)] and len(samples) == 5


def test_priors_outside_and_shared(spark):
    cells = areas.grid(spark, SQUARE, 100)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        kept = prepare_priors(cells, [(-9.0, 5.0), (5.0, 5.0), (55.0, 55.0), (55.1, 55.1)], area=SQUARE)
    assert [k for k, _, _ in kept] == [3] and len([w for w in said if "prior point" in str(w.message)]) == 3  # the one outside displaces the second


def test_equal_area(spark):
    got = stratify(spark, Area.rectangle(0, 0, 10, 10), 4, n_cells=100, equal_area=True)
    assert {r.n_cells for r in metrics.stratum_counts(got.cells).collect()} == {25} and got.converged
    plain = stratify(spark, Area.rectangle(0, 0, 10, 10), 4, n_cells=100, algorithm="single_step")
    assert metrics.strata_efficiency(got).first().gini <= metrics.strata_efficiency(plain).first().gini
    dealt = balanced_labels(areas.grid(spark, Area.rectangle(0, 0, 10, 10), 100), 4, 1).withColumn("stratum_id", F.col("label") + 1)
    from dataclasses import replace

    assert within_sse(got) < within_sse(replace(got, cells=dealt))


@pytest.mark.parametrize("bad", [{"n_strata": 0}, {"n_strata": 999999}, {"n_strata": 3, "n_try": 0}, {"n_strata": 3, "max_iter": 0}, {"n_strata": 3, "n_cells": 0}, {"n_strata": 3, "cell_size": -1}, {"n_strata": 3, "equal_area": True, "priors": [(50.0, 25.0)]}, {"n_strata": 3, "algorithm": "other"}])
def test_stratify_errors(spark, bad):
    with pytest.raises(ValueError):
        stratify(spark, RECT, **bad)


def test_longlat(spark):
    with pytest.raises(ValueError):
        stratify(spark, LONGLAT, 4, equal_area=True)
    got = stratify(spark, LONGLAT, 4, n_cells=100)
    assert 0 < got.mssd < haversine_sq_of(-80, 35, -79, 36)
    assert math.isclose(math.sqrt(haversine_sq_of(0, 0, 0, 1)), 6371 * math.pi / 180)


def test_simple_random(spark):
    triangle = Area(((((0, 0), (10, 0), (0, 10)),),))
    a = [tuple(r) for r in samplers.simple_random(spark, triangle, 40, seed=3).samples.collect()]
    assert len(a) == 40 and all(x >= 0 and y >= 0 and x + y <= 10 for _, x, y in a)
    assert a == [tuple(r) for r in samplers.simple_random(spark, triangle, 40, seed=3).samples.collect()]
    assert samplers.simple_random(spark, LONGLAT, 10).samples.count() == 10


def test_stratified_and_composite(spark):
    strata = stratify(spark, SQUARE, 9, n_cells=400)
    s = samplers.stratified(strata, 3, seed=2)
    assert s.n_samples == 27 and [r.sample_id for r in s.samples.orderBy("sample_id").collect()] == list(range(1, 28))
    lone = spark.createDataFrame([(1, 1, 5.0, 6.0), (2, 2, 1.0, 1.0), (2, 3, 2.0, 2.0)], "stratum_id int, cell_id long, x double, y double")
    assert {r.cell_id for r in samplers.draw(lone, 5, 1).where("stratum_id = 1").collect()} == {1}
    c = samplers.composite(spark, SQUARE, 9, 3, n_cells=400)
    per = c.samples.groupBy("composite").agg(F.countDistinct("stratum_id").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert len(per) == 3 and all(r.s == 9 and r.n == 9 for r in per)
    with pytest.raises(ValueError):
        samplers.composite(spark, strata, n_composites=3)
    with pytest.raises(ValueError):
        samplers.composite(spark, SQUARE, 9, 0)


def test_metrics(spark):
    cells = spark.createDataFrame([(k, 1 + k % 3, float(k), 0.0) for k in range(10)], "cell_id long, stratum_id int, x double, y double")
    e = metrics.coverage_efficiency(cells).first()
    assert (e.total_cells, e.min_cells, e.max_cells, e.n_strata) == (10, 3, 4, 3) and 0 <= e.gini <= 1
    one = metrics.coverage_efficiency(cells.withColumn("stratum_id", F.lit(1))).first()
    assert one.cv is None and one.efficiency_score == "Excellent"
    assert sum(r.relative_area for r in metrics.relative_area(cells).collect()) == pytest.approx(1)
    with pytest.warns(UserWarning):
        metrics.stratum_area(cells, None)
    centers = spark.createDataFrame([(k, 0.0, 0.0) for k in (1, 2, 3, 4)], "stratum_id int, x double, y double")
    d = {r.stratum_id: r for r in metrics.distance_summary(cells, centers, 4).collect()}
    assert d[4].n_cells == 0 and d[4].mean_dist is None and all(d[k].min_dist <= d[k].median_dist <= d[k].max_dist for k in (1, 2, 3))


def test_nearest_center_takes_the_first_of_equals(spark):
    p = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    assert p.select(nearest_center([(1.0, 0.0), (-1.0, 0.0)])["stratum_id"].alias("k")).first().k == 1


def test_layers_and_sinks(spark, tmp_path):
    got = samplers.coverage(spark, SQUARE, 4, n_cells=100)
    assert set(layers.plot_layers(got, show_centroids=True)) == {"cells", "boundaries", "centroids", "samples"}
    assert layers.to_data_frame(got).columns == ["sample_id", "stratum_id", "is_prior", "X", "Y"]
    assert layers.table_of(got.strata, "centroids").count() == 4 and "coverage" in repr(got).lower() and "MSSD" in got.strata.summary()
    for what in ("samples", "other"):
        with pytest.raises(ValueError):
            layers.table_of(got.strata, what)
    assert layers.summary_of(got).columns == ["method", "n_samples", "x_min", "x_max", "y_min", "y_max", "n_strata", "mssd", "equal_area"] and "x:" in got.summary()
    areas.to_csv(layers.to_data_frame(got), str(tmp_path / "c"))
    assert areas.read_csv(spark, str(tmp_path / "c"), "sample_id int, stratum_id int, is_prior boolean, X double, Y double").count() == 4
    areas.to_geojson(got.samples, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g")).where("geometry.type = 'Point'").count() == 4
