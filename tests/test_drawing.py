import xml.etree.ElementTree as ET

import numpy as np
import pytest

from quadrant.operators import doptimal, layers, metrics, samplers
from quadrant.operators.strata import stratify
from quadrant.sources import svg
from quadrant.sources.areas import Area

SQUARE = Area.rectangle(0, 0, 20, 10)


@pytest.fixture(scope="module")
def drawn(spark):
    return samplers.coverage(spark, stratify(spark, SQUARE, 3, [(5.0, 5.0)], cell_size=2.0, max_iter=3))


@pytest.mark.filterwarnings("ignore")
def test_svg_has_an_element_a_row(spark, drawn, tmp_path):
    got = layers.plot_layers(drawn, show_centroids=True)
    svg.to_svg(got, SQUARE.bbox, str(tmp_path / "s"), drawn.strata.cell_size, "a < b & c")
    text = "\n".join(f.read_text() for f in sorted((tmp_path / "s").glob("part-*")))
    root = ET.fromstring(text)
    count = lambda tag: len(root.findall(f"{{http://www.w3.org/2000/svg}}{tag}"))
    assert (count("rect"), count("line"), count("circle")) == (50, got["boundaries"].count(), 6)
    assert root.find("{http://www.w3.org/2000/svg}title").text == "a < b & c"
    prior = [c for c in root.iter("{http://www.w3.org/2000/svg}circle") if c.get("class") == "Prior"]
    assert [(c.get("cx"), c.get("cy")) for c in prior] == [("5", "-5")]
    order = [e.tag.split("}")[1] for e in root][2:]
    assert order[:50] == ["rect"] * 50 and order[-1] == "circle"


def test_svg_of_points_without_size_and_of_nothing(spark):
    points = spark.createDataFrame([(1, 1.0, 2.0, 1), (2, None, 2.0, 1)], "cell_id long, x double, y double, stratum_id int")
    assert [r.value[:24] for r in svg.elements({"cells": points}).collect()] == ['<circle cx="1" cy="-2" r']
    with pytest.raises(ValueError):
        svg.elements({})


def test_texts(spark, drawn):
    text = metrics.efficiency_text(drawn.strata)
    r = metrics.strata_efficiency(drawn.strata).first()
    assert f"score: {r.efficiency_score}" in text and f"Gini index: {r.gini:.3f}" in text and "cells: 50" in text
    one = spark.createDataFrame([(1, 1)], "cell_id long, stratum_id int")
    assert "coefficient of variation: NA" in metrics.efficiency_text(metrics.coverage_efficiency(one))
    rng = np.random.default_rng(3)
    sites = spark.createDataFrame([(k, float(k), float(k % 7), float(v)) for k, v in enumerate(rng.normal(size=30))], "loc_id long, x double, y double, slope double")
    got = doptimal.d_optimal(sites, 4)
    lo, hi = got.samples.agg({"slope": "min"}).first()[0], got.samples.agg({"slope": "max"}).first()[0]
    assert f"slope: {lo:.2f} - {hi:.2f}" in got.summary()
