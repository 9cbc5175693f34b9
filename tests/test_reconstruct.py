import numpy as np
import pytest

from clearstack.config import Config
from clearstack.operators import morphology
from clearstack.plans import reconstruct
from pyspark.sql import functions as F

H, W = 48, 40


@pytest.fixture(scope="module")
def scene(spark):
    """A smooth scene, a cloud over it, and two observations of the ground: one clear, one cloudy where it matters."""
    y, x = np.mgrid[:H, :W]
    ground = (2500 + 15 * y + 10 * x).astype(int)
    cloudy = ground.copy()
    cloudy[16:30, 12:26] = 9000
    scl = np.where(cloudy == 9000, 9, 4)
    px = [(int(i), int(j), int(cloudy[i, j]), int(cloudy[i, j]) - 100, int(scl[i, j])) for i in range(H) for j in range(W)]
    ob = [(int(i), int(j), k, int(ground[i, j]) + 40 * k, int(ground[i, j]) + 40 * k - 100, k == 0, 1.0) for i in range(H) for j in range(W) for k in (0, 1)]
    pixels = spark.createDataFrame(px, "y long, x long, r long, g long, scl int").repartition(4).cache()
    return ground, pixels, spark.createDataFrame(ob, "y long, x long, scene int, r long, g long, clear boolean, weight double").cache()


def test_cloud_gives_way_to_the_ground(scene):
    ground, pixels, obs = scene
    seen = {}
    out = reconstruct.reconstruct(pixels, obs, ["r", "g"], W, H, Config(use_poisson_blending=False, feather_radius=3, pyramid_levels=1), keep=lambda n, d, c: seen.update({n: d}))
    mask = np.zeros((H, W), bool)
    for r in out.mask.where("m").collect():
        mask[r.y, r.x] = True
    picked = {(r.y, r.x): r.r for r in seen["11_selected_pixels"].collect()}
    assert all(v == (ground[k] if mask[k] else 0) for k, v in picked.items()) and len(picked) == H * W
    rows = out.pixels.collect()
    assert len(rows) == H * W
    far = ~np.array([[mask[max(y - 8, 0) : y + 9, max(x - 8, 0) : x + 9].any() for x in range(W)] for y in range(H)])
    # Far from the mask only the cut to whole numbers is left to change a value.
    assert far.any() and all(-1 <= r.r - ground[r.y, r.x] <= 0 for r in rows if far[r.y, r.x])
    assert out.unresolved.count() == 0 and 10 < out.metrics["cloud_percentage"] < 60
    assert {"06_cloud_mask", "09_expanded_mask", "14_final"} <= set(seen)


def test_without_observations_masked_pixels_stay_unresolved(scene):
    _, pixels, obs = scene
    mask = pixels.select("y", "x", F.col("scl").isin(9).alias("m"))
    rows = pixels.join(mask, ["y", "x"])
    out = reconstruct.replaced(rows, obs.limit(0), ["r", "g"], W, H, Config()).collect()
    assert len(out) == H * W and sum(r.unresolved for r in out) == 14 * 14 and all(r.r == 9000 for r in out if r.m)


def test_further_bands_take_the_best_scene(scene):
    ground, pixels, obs = scene
    rows = pixels.join(pixels.select("y", "x", F.col("scl").isin(9).alias("m")), ["y", "x"])
    heavy = obs.withColumn("weight", F.when(F.col("scene") == 0, 1.5).otherwise(0.2))
    out = reconstruct.replaced(rows, heavy, ["r", "g"], W, H, Config(stack_band_count=1)).where("m").collect()
    assert len(out) == 196 and all(r.r == ground[r.y, r.x] and r.g == ground[r.y, r.x] - 100 for r in out)


def test_shadow_offsets():
    assert reconstruct.shadow_offset(Config()) == (15, -15)
    assert reconstruct.shadow_offset(Config(sun_azimuth_deg=90.0, sun_elevation_deg=45.0)) == (0, -25)


def _dilated(m, size):
    out, r = np.zeros_like(m), size // 2
    for dy, w in zip(range(-r, r + 1), morphology.half_widths(size)):
        for dx in range(-w, w + 1):
            src = m[max(-dy, 0) : m.shape[0] - max(dy, 0), max(-dx, 0) : m.shape[1] - max(dx, 0)]
            out[max(dy, 0) : m.shape[0] - max(-dy, 0), max(dx, 0) : m.shape[1] - max(-dx, 0)] |= src
    return out


def _without(m, least):
    """m without 4-connected components of fewer pixels, by flood fill."""
    out, left = np.zeros_like(m), {(y, x) for y, x in zip(*np.nonzero(m))}
    while left:
        todo = [left.pop()]
        for y, x in todo:
            for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if q in left:
                    left.remove(q)
                    todo.append(q)
        if len(todo) >= least:
            for q in todo:
                out[q] = True
    return out


def test_clean_mask_equals_flood_fill(spark):
    m = np.random.default_rng(12).uniform(size=(H, W)) < 0.97
    m[:, 18:22] = False
    m[30:36, 5:12] = False
    m[5:14, 24:36] = False
    m[8:11, 28:33] = True
    erode = lambda a: ~_dilated(~a, 5)
    shape = erode(_dilated(_dilated(erode(m), 5), 5))
    want = ~_without(~_without(shape, 40), 64)
    df = spark.createDataFrame([(y, x, bool(m[y, x])) for y in range(H) for x in range(W)], "y long, x long, m boolean")
    rows = reconstruct.clean_mask(df, W, Config()).collect()
    assert len(rows) == H * W and all(r.m == want[r.y, r.x] for r in rows)
    assert 0 < want.sum() < H * W and (want != m).any()
