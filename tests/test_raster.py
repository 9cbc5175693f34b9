"""Hand-computed cases, and the registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from clearstack.operators import components, morphology, neighborhood, pointwise, stack
from clearstack.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_weighted_median_of_four_bands(spark):
    values = {"b2": (0.12, 0.14, 0.11, 0.13), "b3": (0.15, 0.16, 0.14, 0.15), "b4": (0.18, 0.19, 0.17, 0.18), "b8": (0.25, 0.24, 0.26, 0.25)}
    rows = [(b, s, v, w) for b, vs in values.items() for s, (v, w) in enumerate(zip(vs, (0.30, 0.20, 0.25, 0.25)))]
    rows += [("zero", s, v, 0.0) for s, v in enumerate((3.0, 1.0, 2.0))] + [("half", s, v, 1.0) for s, v in enumerate((1.0, 2.0))]
    df = spark.createDataFrame(rows, "band string, scene int, v double, w double").withColumn("u", stack.in_units(F.col("w")))
    got = {r[0]: (r[1], r[2]) for r in stack.weighted_median(df, ["band"], "v", "u", ["scene"]).collect()}
    assert got == {"b2": (0.12, False), "b3": (0.15, False), "b4": (0.18, False), "b8": (0.25, False), "zero": (1.0, True), "half": (1.0, False)}


def test_pointwise(spark):
    df = spark.createDataFrame([(7,), (12000,)], "dn long").select(pointwise.denormalize(pointwise.normalize(F.col("dn"))).alias("d"))
    assert [r[0] for r in df.collect()] == [6, 10000]
    scl = spark.range(12).select("id", pointwise.is_cloud(F.col("id")).alias("c"), pointwise.is_clear(F.col("id")).alias("k"))
    assert {r[0] for r in scl.where("c").collect()} == {8, 9, 10, 11}
    assert {r[0] for r in scl.where("not k").collect()} == {3, 8, 9, 10, 11}


def grid(spark, rows):
    return spark.createDataFrame([(y, x, c == "#") for y, row in enumerate(rows) for x, c in enumerate(row)], "y long, x long, m boolean")


def flood(cells):
    left, out = set(cells), []
    while left:
        todo, blob = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            blob.add((y, x))
            for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        out.append(blob)
    return out


ROWS = ["##..#", ".#..#", "..#.#", "#...#", "###.#"]


def test_components_and_holes(spark):
    df = grid(spark, ROWS)
    cells = {(y, x) for y, r in enumerate(ROWS) for x, c in enumerate(r) if c == "#"}
    got = {}
    for y, x, b in components.label(df.where("m"), 5).collect():
        got.setdefault(b, set()).add((y, x))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, flood(cells)))
    assert all(b == min(y * 5 + x for y, x in c) for b, c in got.items())
    rest = {(y, x) for y in range(5) for x in range(5)} - cells
    expected = cells | {p for b in flood(rest) if len(b) < 8 for p in b}
    assert {(r[0], r[1]) for r in components.holes_filled(df.where("m").select("y", "x"), df, 5, 8).collect()} == expected


def test_morphology_laws(spark):
    df = grid(spark, ROWS)
    cells = {(r[0], r[1]) for r in df.where("m").collect()}
    true = lambda d: {(r[0], r[1]) for r in d.where("m").collect()}
    assert true(morphology.erode(df, 5)) <= cells <= true(morphology.dilate(df, 5))
    assert morphology.half_widths(21) == [0, 4, 6, 7, 8, 9, 9, *[10] * 7, 9, 9, 8, 7, 6, 4, 0]


def test_even_box(spark):
    df = spark.createDataFrame([(0, x, x + 1) for x in range(5)], "y long, x long, v long")
    got = {r[1]: r[2] for r in neighborhood.box_sums(df, ["v"], 2, 5, 1).collect()}
    assert got == {x: 2 * (max(x, 1) + x + 1) for x in range(5)}


@pytest.mark.parametrize("name", ["scene_search", "temporal_composite", "local_mean_std", "halo", "shadow_mask", "remove_small", "histogram_match", "pyr_down", "pyr_up", "laplacian_blend", "feather_blend", "gaussian_detail", "color_transfer", "bilinear_regrid"])
def test_query_agrees_with_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    cur = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    got = QUERIES[name](spark, DATA).select(*names).collect()
    key = lambda r: tuple((v is None, round(v, 6) if isinstance(v, float) else v or 0) for v in r)
    assert sorted(map(key, got)) == sorted(map(key, expected))


def test_windows_across_tiles(spark, monkeypatch):
    """Box sums, distances, dilation and growth are the same whatever the size of tiles."""
    import numpy as np

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(y, x, int(rng.integers(100)), bool(rng.random() < 0.06)) for y in range(23) for x in range(31)], "y long, x long, v long, m boolean").cache()

    def answers():
        labelled = components.label(df.where("m"), 31)
        parts = (neighborhood.box_sums(df, ["v"], 7, 31, 23), neighborhood.distance_squared(df.where("m"), df, 6), morphology.dilate(df, 7), components.expanded(labelled, df, 0.3, 2, 4), neighborhood.gaussian(df, ["v"], 1.0, 31, 23).withColumn("v", F.round("v", 9)))
        return [sorted(map(tuple, p.collect()), key=repr) for p in parts]

    monkeypatch.setattr(neighborhood, "TILE", 5)
    monkeypatch.setattr(neighborhood, "SQUARE", 4)
    small = answers()
    monkeypatch.setattr(neighborhood, "TILE", 512)
    monkeypatch.setattr(neighborhood, "SQUARE", 256)
    assert small == answers()


@pytest.mark.parametrize("square", [4, 256])
def test_nearest_marks_by_brute_force(spark, monkeypatch, square):
    """Pixels missing, ids too large for a float, ties between marks of other ids; squares smaller than the reach."""
    import numpy as np

    monkeypatch.setattr(neighborhood, "SQUARE", square)
    rng = np.random.default_rng(6)
    rows = [(y, x, 2**60 + int(rng.integers(4)) if rng.random() < 0.03 else None) for y in range(30) for x in range(-3, 25) if rng.random() < 0.8]
    marks = [r for r in rows if r[2] is not None]
    got = neighborhood.nearest_marks(spark.createDataFrame(rows, "y long, x long, id long"), 6).collect()
    near = lambda y, x: min((((y - a) ** 2 + (x - b) ** 2, i) for a, b, i in marks if (y - a) ** 2 + (x - b) ** 2 <= 36), default=None)
    assert len(got) == len(rows) and {(r.y, r.x): r.near and tuple(r.near) for r in got} == {(y, x): near(y, x) for y, x, _ in rows}
    none = neighborhood.nearest_marks(spark.createDataFrame([(1, 1, None)], "y long, x long, id long"), 6).collect()
    assert [tuple(r) for r in none] == [(1, 1, None)]


def test_percentiles_in_passes(spark, monkeypatch):
    """Exact percentiles with few bins and few values held, of ties, nulls, tiny ranges and one value."""
    import numpy as np

    rng = np.random.default_rng(5)
    monkeypatch.setattr(pointwise, "BINS", 4)
    monkeypatch.setattr(pointwise, "HELD", 6)
    for v in (rng.normal(size=200), np.repeat([1.0, 2.0, 5.0], 40), np.array([3.0]), np.array([1.0, 1.0 + 2**-52, 1.0 + 2**-51])):
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
        for share in (0.0, 0.2, 0.99, 1.0):
            assert pointwise.percentile(df, "v", share) == pytest.approx(np.percentile(v, 100 * share), rel=1e-14)
    assert pointwise.percentile(spark.createDataFrame([], "v double"), "v", 0.5) is None


def test_layers_take_local_colours(spark):
    """Each layer as color_transferred() gives it alone; other columns stay."""
    from clearstack.operators import color

    px = [(y, x, 1000 + 10 * y + x, 2000 + 7 * x, (y + x) % 5 > 0) for y in range(12) for x in range(9)]
    df = spark.createDataFrame(px, "y long, x long, r long, other long, clear boolean")
    layers = {k: df.select("y", "x", (F.col("other") * (k + 1)).alias("r"), F.lit(k).alias("scene")) for k in (0, 1)}
    for k, out in color.normalized_layers(layers, df.select("y", "x", "r", "clear"), ["r"], 5, 9, 12).items():
        pair = df.select("y", "x", (F.col("other") * (k + 1)).alias("source"), F.col("r").alias("target"), "clear")
        want = {(r.y, r.x): round(r.v, 6) for r in color.color_transferred(pair, 5, 9, 12).collect()}
        assert out.columns == ["y", "x", "r", "scene"] and {(r.y, r.x): round(r.r, 6) for r in out.collect()} == want
