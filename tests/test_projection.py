import math

import numpy as np
import pytest
from clearstack.operators import projection
from clearstack.plans import run as runs
from pyspark.sql import Row
from pyspark.sql import functions as F


def _moved(spark, points, source, goal):
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "i int, x double, y double")
    return np.array([(r.x, r.y) for r in projection.between(rows, "x", "y", source, goal).orderBy("i").collect()], dtype=float)


def test_utm_against_a_published_place_and_the_length_of_the_meridian(spark):
    tower = _moved(spark, [(-(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600)], "EPSG:4326", "EPSG:32617")[0]
    assert np.allclose(tower, [630084, 4833438], atol=1)
    e2 = projection.FLATTENING * (2 - projection.FLATTENING)
    for lat in (10.0, 41.5, 70.0):
        phi = np.linspace(0, math.radians(lat), 200001)
        arc = np.trapezoid(projection.AXIS * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi)
        got = _moved(spark, [(15, lat)], "EPSG:4326", "EPSG:32633")[0]
        assert np.allclose(got, [500000, 0.9996 * arc], atol=2e-3)
        assert np.allclose(_moved(spark, [(15, -lat)], "EPSG:4326", "EPSG:32733")[0], [500000, 1e7 - 0.9996 * arc], atol=2e-3)


def test_utm_keeps_angles_off_the_meridian(spark):
    e2, h, lon, lat = projection.FLATTENING * (2 - projection.FLATTENING), 1e-4, 12.5, 47.0
    w, e, s, n = _moved(spark, [(lon - h, lat), (lon + h, lat), (lon, lat - h), (lon, lat + h)], "EPSG:4326", "EPSG:32633")
    curve = 1 - e2 * math.sin(math.radians(lat)) ** 2
    along = (e - w) / (math.cos(math.radians(lat)) / math.sqrt(curve))
    up = (n - s) / ((1 - e2) / curve**1.5)
    assert abs(along @ up) / (along @ along) < 1e-6 and abs(np.hypot(*along) / np.hypot(*up) - 1) < 1e-6


@pytest.mark.parametrize("crs", ["EPSG:32631", "EPSG:32731", "EPSG:3857"])
def test_there_and_back(spark, crs):
    sign = -1 if crs == "EPSG:32731" else 1
    points = np.array([(x, sign * y) for x in (-1.0, 0.5, 3.0, 6.9) for y in (0.01, 20.0, 55.0, 83.0)])
    assert np.allclose(_moved(spark, _moved(spark, points, "EPSG:4326", crs), crs, "EPSG:4326"), points, atol=2e-8)


def test_places_without_coordinates_are_null_and_unknown_systems_errors(spark):
    assert np.isnan(_moved(spark, [(120, 10), (3, 90), (3, -90)], "EPSG:4326", "EPSG:32631")).all()
    assert np.isnan(_moved(spark, [(1e9, 0), (1e300, -1e300)], "EPSG:32631", "EPSG:4326")).all()
    assert np.isnan(_moved(spark, [(0, 90), (0, float("nan"))], "EPSG:4326", "EPSG:3857")[0]).all()
    with pytest.raises(ValueError, match="no formula"):
        projection.between(spark.range(1), "id", "id", "EPSG:32661", "EPSG:4326")
    assert projection.zone(None) is None and projection.zone("EPSG:32600") is None and projection.zone("EPSG:32760") == (177.0, 1e7)


def test_a_raster_of_a_neighbouring_zone_is_brought_over(spark):
    """A plane over easting of one zone, seen from the next: its values are the places' eastings there; two bands at once."""
    own = Row(crs="EPSG:32632", width=60, height=60, transform=[100.0, 0.0, 260000.0, 0.0, -100.0, 5206000.0])
    pixels = spark.range(3600).select(F.expr("id div 60").alias("y"), F.expr("id % 60").alias("x"))
    pixels = pixels.select("y", "x", (260050.0 + 100.0 * F.col("x")).alias("e"), (5205950.0 - 100.0 * F.col("y")).alias("n"))
    mid = _moved(spark, _moved(spark, [(263000, 5203000)], "EPSG:32632", "EPSG:4326"), "EPSG:4326", "EPSG:32631")[0]
    goal = Row(crs="EPSG:32631", width=8, height=8, transform=[100.0, 0.0, mid[0] - 400, 0.0, -100.0, mid[1] + 400])
    got = runs.on_grid(pixels, own, goal, ["e", "n"]).orderBy("y", "x").collect()
    centres = [(mid[0] - 400 + 100 * (x + 0.5), mid[1] + 400 - 100 * (y + 0.5)) for y in range(8) for x in range(8)]
    expected = _moved(spark, _moved(spark, centres, "EPSG:32631", "EPSG:4326"), "EPSG:4326", "EPSG:32632")
    assert np.allclose([(r.e, r.n) for r in got], expected, atol=1e-3)
    far = Row(crs="EPSG:32651", width=2, height=2, transform=[100.0, 0.0, 500000.0, 0.0, -100.0, 5206000.0])
    assert all(r.e == 0 and r.n == 0 for r in runs.on_grid(pixels, own, far, ["e", "n"]).collect())
