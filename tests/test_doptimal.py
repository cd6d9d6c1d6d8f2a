import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrant.operators import doptimal


@pytest.fixture(scope="module")
def sites(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(k % 10), float(k // 10), float(rng.normal(100, 10)), float(abs(rng.normal(5, 2))), 7.0) for k in range(100)]
    return spark.createDataFrame(rows, "loc_id long, x double, y double, elevation double, slope double, flat double").cache()


def picked(s):
    return [r.loc_id for r in s.samples.orderBy("sample_id").collect()]


def logdet(sites, ids, cols):
    a = np.array([tuple(r) for r in doptimal.normalize(sites, cols).where(F.col("loc_id").isin(ids)).select(*cols).collect()])
    return np.linalg.slogdet(a.T @ a)[1]


@pytest.mark.parametrize("method", ["greedy", "pivot"])
def test_distinct_and_deterministic(sites, method):
    a = picked(doptimal.d_optimal(sites, 15, ["elevation", "slope"], method=method))
    assert len(set(a)) == 15
    assert a == picked(doptimal.d_optimal(sites.repartition(7), 15, ["elevation", "slope"], method=method))


def brute_greedy(sites, k, cols, min_dist=None):
    rows = doptimal.normalize(sites, cols).select("loc_id", "x", "y", *cols).orderBy("loc_id").collect()
    xy = {r.loc_id: (r.x, r.y) for r in sites.select("loc_id", "x", "y").collect()}
    a, inverse, chosen = np.array([tuple(r)[3:] for r in rows]), np.eye(len(cols)) / doptimal.RIDGE, []
    for _ in range(k):
        s = np.einsum("ij,jk,ik->i", a, inverse, a)
        for i, r in enumerate(rows):
            if r.loc_id in chosen or min_dist and any(math.dist(xy[r.loc_id], xy[c]) < min_dist for c in chosen):
                s[i] = -1
        i = int(s.argmax())
        chosen.append(rows[i].loc_id)
        inverse = doptimal._added(inverse, a[i])
    return chosen


@pytest.mark.parametrize("batch", [512, 3])
@pytest.mark.parametrize("min_dist", [None, 2.5])
def test_passes_of_many_picks_are_greedy_picks(sites, monkeypatch, batch, min_dist):
    monkeypatch.setattr(doptimal, "BATCH", batch)
    got = doptimal.d_optimal(sites, 9, ["elevation", "slope"], add_coords=False, min_dist=min_dist)
    assert picked(got) == brute_greedy(sites, 9, ["elevation", "slope"], min_dist)
    assert got.facts["iterations"] == 1 if batch == 512 else got.facts["iterations"] > 1


@pytest.mark.parametrize("min_dist", [None, 2.0])
def test_coresets_come_near_greedy(sites, monkeypatch, min_dist):
    monkeypatch.setattr(doptimal, "PART", 48)
    cols = ["x", "y", "elevation", "slope"]
    got = doptimal.d_optimal(sites, 12, ["elevation", "slope"], method="coresets", min_dist=min_dist)
    assert len(set(picked(got))) == 12 and got.facts["iterations"] >= 2
    assert logdet(sites, picked(got), cols) >= logdet(sites, picked(doptimal.d_optimal(sites, 12, ["elevation", "slope"], min_dist=min_dist)), cols) - 0.5
    rows = got.samples.collect()
    assert not min_dist or min(math.dist((a.x, a.y), (b.x, b.y)) for a in rows for b in rows if a.loc_id < b.loc_id) >= min_dist


def test_coresets_that_run_short_are_filled_from_all_rows(sites, monkeypatch):
    monkeypatch.setattr(doptimal, "PART", 48)
    with pytest.warns(UserWarning):
        assert len(set(picked(doptimal.d_optimal(sites, 20, ["elevation"], min_dist=8.0, method="coresets")))) == 20


def test_first_rows_that_do_not_span_the_features(spark):
    """The first rows are copies of each other: the start of an exchange is chosen by leverage instead."""
    rng = np.random.default_rng(8)
    rows = [(k, float(k), 0.0, 1.0, 2.0) if k < 10 else (k, float(k), 0.0, float(rng.normal()), float(rng.normal())) for k in range(60)]
    df = spark.createDataFrame(rows, "loc_id long, x double, y double, a double, b double")
    with pytest.warns(UserWarning, match="don't span"):
        got = picked(doptimal.d_optimal(df, 5, ["a", "b"], add_coords=False, method="pivot"))
    assert len(set(got)) == 5 and np.isfinite(logdet(df, got, ["a", "b"])) and min(got) < 60 and max(got) >= 10
    same = df.withColumn("b", F.col("a") * 2)
    with pytest.raises(ValueError, match="dependent: [ab]$"):
        doptimal.d_optimal(same, 5, ["a", "b"], add_coords=False, method="pivot")


def test_greedy_beats_the_first_rows(sites):
    cols = ["x", "y", "elevation", "slope"]
    assert logdet(sites, picked(doptimal.d_optimal(sites, 15, ["elevation", "slope"])), cols) > logdet(sites, list(range(15)), cols)


@pytest.mark.parametrize("method", ["greedy", "pivot"])
def test_min_dist(sites, method):
    got = doptimal.d_optimal(sites, 8, ["elevation", "slope"], min_dist=2.5, method=method).samples.collect()
    assert min(math.dist((a.x, a.y), (b.x, b.y)) for a in got for b in got if a.loc_id < b.loc_id) >= 2.5


def test_min_dist_that_cannot_hold_warns(sites):
    with pytest.warns(UserWarning):
        assert doptimal.d_optimal(sites, 20, ["elevation"], min_dist=8.0).n_samples == 20


def test_independent_features_of_a_gram_matrix(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(80, 5)) * [1, 100, 1e-3, 1, 1]
    a[:, 3], a[:, 4] = a[:, 0] * 3 - a[:, 1], 0.0
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(a)], "loc_id long, f array<double>").repartition(5)
    found = np.zeros((5, 5))
    for r in doptimal.gram(df, 5).collect():
        found[r.i - 1, r.j - 1] = found[r.j - 1, r.i - 1] = r.value
    assert found == pytest.approx(a.T @ a)
    spanning = doptimal.independent(found)
    assert len(spanning) == 3 == np.linalg.matrix_rank(a / [1, 100, 1e-3, 1, 1]) and 2 in spanning and 4 not in spanning


def test_errors_and_edges(spark, sites):
    for bad in ({"n": 3}, {"n": 101}, {"n": 5, "features": []}, {"n": 5, "method": "other"}):
        with pytest.raises(ValueError):
            doptimal.d_optimal(sites, **bad)
    with pytest.raises(ValueError):
        doptimal.d_optimal(sites.drop("x"), 5)
    assert doptimal.numeric_features(sites) == ["elevation", "slope", "flat"]
    assert doptimal.d_optimal(sites, 6).n_samples == 6  # with a constant feature
    holes = sites.withColumn("elevation", F.when(F.col("loc_id") != 3, F.col("elevation")))
    assert 3 not in picked(doptimal.d_optimal(holes, 99, ["elevation"]))
    z = doptimal.normalize(sites, ["elevation", "flat"]).agg(F.avg("elevation"), F.stddev_samp("elevation"), F.max("flat")).first()
    assert abs(z[0]) < 1e-9 and abs(z[1] - 1) < 1e-9 and z[2] == 0
