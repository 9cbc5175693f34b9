import numpy as np
import pytest
from clearstack.operators import components


def _flooded(m):
    """The least y * width + x of each pixel's component, by flood fill."""
    h, w = m.shape
    out = np.full((h, w), -1)
    for y, x in zip(*np.nonzero(m)):
        todo = [(y, x)] if out[y, x] < 0 else []
        while todo:
            a, b = todo.pop()
            if 0 <= a < h and 0 <= b < w and m[a, b] and out[a, b] < 0:
                out[a, b] = y * w + x
                todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return out


def _snake():
    m = np.zeros((21, 19), bool)
    m[::2] = True
    for k in range(1, 21, 2):
        m[k, -1 if k // 2 % 2 == 0 else 0] = True
    return m


def _near_percolation():
    return np.random.default_rng(3).random((30, 40)) < 0.6


@pytest.mark.parametrize("tile, mask", [(4, _snake()), (7, _near_percolation()), (256, _near_percolation()), (3, np.ones((10, 8), bool)), (5, np.zeros((6, 6), bool)), (1, _near_percolation()[:6, :6])])
def test_labels_do_not_depend_on_tiles(spark, monkeypatch, tile, mask):
    monkeypatch.setattr(components, "TILE", tile)
    rows = [(int(y), int(x)) for y, x in zip(*np.nonzero(mask))]
    got = components.label(spark.createDataFrame(rows + rows[:3], "y long, x long"), mask.shape[1]).collect()
    expected = _flooded(mask)
    assert len(got) == mask.sum() and all(r.blob == expected[r.y, r.x] for r in got)


def test_one_tile_by_itself():
    mask = _near_percolation()
    y, x = np.nonzero(mask)
    order = np.random.default_rng(1).permutation(len(y))
    y, x = y[order], x[order]
    assert ((y * 40 + x)[components.tile_components(y, x)] == _flooded(mask)[y, x]).all()
