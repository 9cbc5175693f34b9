import numpy as np
import pytest

from clearstack.session import written
from clearstack.operators import color, components, features, plugins, poisson
from pyspark.sql import functions as F


def _frame(spark, **grids):
    names = list(grids)
    h, w = grids[names[0]].shape
    kinds = ", ".join(f"{n} {'boolean' if grids[n].dtype == bool else 'double'}" for n in names)
    return spark.createDataFrame([(y, x, *(grids[n][y, x].item() for n in names)) for y in range(h) for x in range(w)], f"y long, x long, {kinds}")


def _grid(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[name]
    return out


def _direct(a, b, m):
    """The same equations in one dense system."""
    at = {p: i for i, p in enumerate(zip(*np.nonzero(m)))}
    left, right = np.zeros((len(at), len(at))), np.zeros(len(at))
    for (y, x), i in at.items():
        for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if 0 <= q[0] < m.shape[0] and 0 <= q[1] < m.shape[1]:
                left[i, i] += 1
                right[i] += a[y, x] - a[q]
                if q in at:
                    left[i, at[q]] -= 1
                else:
                    right[i] += b[q]
    out = b.copy()
    for p, v in zip(at, np.linalg.solve(left, right)):
        out[p] = v
    return out


def test_poisson_equals_direct_solution(spark):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0, 100, (24, 30)), rng.uniform(0, 100, (24, 30))
    m = np.zeros((24, 30), bool)
    m[3:15, 4:20] = True
    m[18:, 25:] = True  # touches the corner
    m[8, 10] = False
    for tile in (64, 8):  # one tile, and components over many
        got = _grid(poisson.poisson_blend(_frame(spark, a=a, b=b, m=m), tile=tile, tolerance=1e-5), "v", a.shape)
        assert np.abs(got - _direct(a, b, m)).max() < 0.01
    none = np.zeros_like(m)
    assert (_grid(poisson.poisson_blend(_frame(spark, a=a, b=b, m=none)), "v", a.shape) == b).all()


def test_poisson_settles_over_many_tiles(spark):
    """Where b - a is linear the answer is b; the mask is 20 tiles across."""
    rng = np.random.default_rng(7)
    a = rng.uniform(0, 100, (84, 84))
    b = a + np.add.outer(3.0 * np.arange(84), 2.0 * np.arange(84))
    m = np.zeros((84, 84), bool)
    m[2:82, 2:82] = True
    m[30:33, 40] = False
    df = _frame(spark, a=a, b=b, m=m)
    assert np.abs(_grid(poisson.poisson_blend(df, tile=4), "v", a.shape) - b).max() < 0.1
    with pytest.raises(RuntimeError):
        poisson.poisson_blend(df, tile=4, rounds=2)


def test_poisson_without_surroundings_keeps_the_fill(spark):
    a, b = np.arange(12.0).reshape(3, 4), np.zeros((3, 4))
    got = _grid(poisson.poisson_blend(_frame(spark, a=a, b=b, m=np.ones((3, 4), bool))), "v", a.shape)
    assert np.abs(got - a).max() < 1e-6


def _matched(values, source, template):
    sv, sc = np.unique(source, return_counts=True)
    tv, tc = np.unique(template, return_counts=True)
    return np.interp(np.interp(values, sv, np.cumsum(sc)), np.cumsum(tc), tv)


def test_blob_histogram_match(spark):
    rng = np.random.default_rng(6)
    r, c = rng.integers(0, 60, (30, 30)).astype(float), rng.integers(40, 90, (30, 30)).astype(float)
    m = np.zeros((30, 30), bool)
    boxes = [(2, 8, 3, 9), (15, 26, 10, 28)]
    for y0, y1, x0, x1 in boxes:
        m[y0:y1, x0:x1] = True
    want = r.copy()
    for y0, y1, x0, x1 in boxes:
        crop = slice(max(y0 - 4, 0), min(y1 + 4, 30)), slice(max(x0 - 4, 0), min(x1 + 4, 30))
        want[y0:y1, x0:x1] = _matched(r[y0:y1, x0:x1], r[crop], c[crop])
    df = _frame(spark, result=r, cloudy=c, m=m)
    lab = written(components.label(df.where("m"), 30))
    got = _grid(color.blob_histogram_match(df, lab, 30, 30, margin=4, tile=7), "v", r.shape)
    assert np.abs(got - want).max() < 1e-9
    kept = _grid(color.blob_histogram_match(df, lab, 30, 30, margin=4, least=10000), "v", r.shape)
    assert (kept == r).all()


def test_plugins(spark):
    df = spark.createDataFrame([(1, [0.5] * 12), (2, [0.5] * 9), (3, None), (4, [2.0] * 10)], "id int, bands array<double>")
    p = lambda d: [r[0] for r in df.orderBy("id").select(plugins.cloud_probability(F.col("bands"), d)).collect()]
    assert p(None) == [0, 0, 0, 0] and p(lambda b: b[0]) == [0.5, 0, 0, 1]
    px = spark.createDataFrame([(0, 0, 1, 2, 3, 9, True), (0, 1, 1, 2, 3, 9, False), (0, 2, 1, 2, 3, 9, True)], "y int, x int, r int, g int, b int, n int, unresolved boolean")
    fill = lambda d: d.where("x < 2").select("y", "x", F.lit(7).alias("r"), F.lit(8).alias("g"), F.lit(None).cast("int").alias("b"))
    assert plugins.inpaint(px) is px
    assert [(r.r, r.g, r.b, r.n) for r in plugins.inpaint(px, fill).orderBy("x").collect()] == [(7, 8, 3, 9), (1, 2, 3, 9), (1, 2, 3, 9)]


def _scene(h, w):
    rng = np.random.default_rng(8)
    return features._mean(np.kron(rng.uniform(0, 255, (h // 6 + 1, w // 6 + 1)), np.ones((6, 6)))[:h, :w], 1)


def test_registration_finds_the_shift(spark):
    wide = _scene(150, 170)
    fixed, moving = wide[10:130, 10:150], wide[14:134, 7:147]  # moving(y, x) = fixed(y + 4, x - 3)
    frame = _frame(spark, grey=moving, v=moving)
    out, error = features.refined(_frame(spark, grey=fixed), frame, ["v"], 140, 120)
    assert error is not None and error < 1
    got = _grid(out, "v", fixed.shape)
    assert np.abs(got - fixed)[10:-10, 10:-10].mean() < 2 < np.abs(moving - fixed).mean()


def test_keypoints_do_not_depend_on_tiles(spark):
    df = _frame(spark, grey=_scene(90, 100))
    one, many = ({(r.y, r.x, tuple(r.bits)) for r in features.keypoints(df, 100, 90, tile=t).collect()} for t in (256, 32))
    assert one == many and len(one) > 20


def test_registration_without_features_keeps_the_scene(spark):
    flat = np.full((60, 60), 5.0)
    out, error = features.refined(_frame(spark, grey=flat), _frame(spark, grey=flat, v=flat), ["v"], 60, 60)
    assert error is None and (_grid(out, "v", flat.shape) == flat).all()


def test_homography_ignores_wrong_points():
    rng = np.random.default_rng(9)
    h = np.array([[1.02, 0.03, 4.0], [-0.02, 0.98, -3.0], [1e-5, 2e-5, 1.0]])
    src = rng.uniform(0, 500, (60, 2))
    dst = features.project(h, src)
    dst[:15] += rng.uniform(40, 90, (15, 2))
    got, agree = features.homography(src, dst)
    assert np.allclose(got, h, atol=1e-6) and agree.sum() == 45
    assert features.homography(src[:3], dst[:3]) is None
