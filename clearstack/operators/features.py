"""Refining registration by keypoints: corners, binary descriptors, matches, a homography, and a warp.

Corners and descriptors are found tile by tile, each tile with a rim wide enough for its patches, so the result doesn't
depend on the tiles. The strongest corners are kept, up to a limit that is part of the operator; everything after that
is bounded by it. Descriptors compare pairs of smoothed pixels of an upright patch, turned by the patch's own direction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearstack.session import ship, written

PATCH, BITS, HARRIS = 13, 256, 0.04
#: Rim of a tile: the patch, turned, and the smoothing about its pixels.
RIM = PATCH + 8
_PAIRS = np.clip(np.random.default_rng(7).normal(0, PATCH / 2.5, (BITS, 2, 2)), -PATCH + 4, PATCH - 4)
_FOUND = "y long, x long, strength double, bits array<long>"


def _mean(a: np.ndarray, r: int) -> np.ndarray:
    """Means over (2r + 1) squares, the edge going on."""
    s = np.cumsum(np.cumsum(np.pad(a, ((r + 1, r), (r + 1, r)), mode="edge"), axis=0), axis=1)
    k = 2 * r + 1
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def _corners(grey: np.ndarray) -> np.ndarray:
    """Harris responses, 0 where a neighbour is stronger; of equal neighbours the first in reading order stays."""
    gy, gx = np.gradient(grey)
    a, b, c = _mean(gx * gx, 2), _mean(gy * gy, 2), _mean(gx * gy, 2)
    r = np.round(a * b - c * c - HARRIS * (a + b) ** 2, 6)
    wide = np.pad(r, 1, constant_values=-np.inf)
    best = r > 0
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            near = wide[1 + dy : 1 + dy + r.shape[0], 1 + dx : 1 + dx + r.shape[1]]
            if (dy, dx) < (0, 0):
                best &= r > near
            elif (dy, dx) > (0, 0):
                best &= r >= near
    return np.where(best, r, 0.0)


def _describe(smooth: np.ndarray, y: int, x: int) -> list[int]:
    """256 comparisons as four 64-bit numbers, turned towards the patch's centre of brightness."""
    patch = smooth[y - PATCH : y + PATCH + 1, x - PATCH : x + PATCH + 1]
    d = np.arange(-PATCH, PATCH + 1)
    turn = np.arctan2((patch * d[:, None]).sum(), (patch * d[None, :]).sum())
    c, s = np.cos(turn), np.sin(turn)
    at = np.rint(np.stack([_PAIRS[..., 0] * c + _PAIRS[..., 1] * s, _PAIRS[..., 1] * c - _PAIRS[..., 0] * s], axis=-1)).astype(int)
    v = smooth[y + at[..., 0], x + at[..., 1]]
    return np.packbits(v[:, 0] < v[:, 1]).view(">i8").tolist()


def _finder(tile: int, width: int, height: int):
    def find(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(key[0]), int(key[1])
        y0, x0 = ty * tile - RIM, tx * tile - RIM
        grey = np.zeros((tile + 2 * RIM, tile + 2 * RIM))
        grey[rows["y"] - y0, rows["x"] - x0] = rows["grey"].fillna(0.0)
        strength, smooth = _corners(grey), np.round(_mean(grey, 2), 6)
        found = []
        for y, x in zip(*np.nonzero(strength), strict=True):
            gy, gx = y + y0, x + x0
            own = RIM <= y < RIM + tile and RIM <= x < RIM + tile
            if own and RIM <= gy < height - RIM and RIM <= gx < width - RIM:
                found.append((gy, gx, strength[y, x], _describe(smooth, y, x)))
        return pd.DataFrame(found, columns=["y", "x", "strength", "bits"])

    return find


def keypoints(pixels: DataFrame, width: int, height: int, limit: int = 2000, tile: int = 256) -> DataFrame:
    """id, y, x, bits of the strongest corners of pixels (y, x, grey): at most `limit`; ties in reading order.

    Corners nearer to the raster's edge than a patch have no descriptor and don't count; missing pixels are 0.
    """
    ship(pixels.sparkSession)
    tiles = lambda axis: F.sequence(F.floor((F.col(axis) - RIM) / tile), F.floor((F.col(axis) + RIM) / tile))
    dealt = pixels.select("y", "x", F.col("grey").cast("double").alias("grey"), F.explode(tiles("y")).alias("ty")).withColumn("tx", F.explode(tiles("x")))
    inside = F.col("ty").between(0, (height - 1) // tile) & F.col("tx").between(0, (width - 1) // tile)
    found = dealt.where(inside).groupBy("ty", "tx").applyInPandas(_finder(tile, width, height), _FOUND)
    best = found.orderBy(F.desc("strength"), "y", "x").limit(limit)
    return best.select((F.col("y") * width + F.col("x")).alias("id"), "y", "x", "bits")


def matches(fixed: DataFrame, moving: DataFrame, ratio: float = 0.75) -> DataFrame:
    """fy, fx, my, mx of fixed keypoints whose nearest moving one is nearer than ratio times the second; ties to the smaller id.

    Both are keypoints(), so at most `limit` by `limit` pairs are looked at, as in brute-force matching.
    """
    m = moving.select(F.col("id").alias("match"), F.col("y").alias("my"), F.col("x").alias("mx"), F.col("bits").alias("other"))
    d = F.aggregate(F.zip_with("bits", "other", lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    pairs = fixed.crossJoin(F.broadcast(m)).select("id", F.col("y").alias("fy"), F.col("x").alias("fx"), F.struct(d.alias("d"), "match", "my", "mx").alias("p"))
    two = pairs.groupBy("id", "fy", "fx").agg(F.min_by("p", "p").alias("a"), F.slice(F.sort_array(F.collect_list("p")), 1, 2).alias("two"))
    return two.where((F.size("two") == 2) & (F.col("a.d") < ratio * F.col("two")[1]["d"])).select("fy", "fx", "a.my", "a.mx")


def _fit(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The homography of least squares over points scaled to about 1; None where points don't fix one."""

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, s = p.mean(axis=0), max(np.sqrt(((p - p.mean(axis=0)) ** 2).sum(axis=1)).mean(), 1e-9) / np.sqrt(2)
        return (p - c) / s, np.array([[1 / s, 0, -c[0] / s], [0, 1 / s, -c[1] / s], [0, 0, 1]])

    (a, ta), (b, tb) = scaled(src), scaled(dst)
    one, zero = np.ones(len(a)), np.zeros((len(a), 3))
    p = np.column_stack([a, one])
    rows = np.concatenate([np.hstack([p, zero, -b[:, :1] * p]), np.hstack([zero, p, -b[:, 1:] * p])])
    _, size, v = np.linalg.svd(rows)
    if len(size) >= 8 and size[7] < 1e-8:
        return None
    h = np.linalg.inv(tb) @ v[-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def project(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.column_stack([p, np.ones(len(p))]) @ h.T
    return q[:, :2] / np.where(np.abs(q[:, 2:]) < 1e-12, 1e-12, q[:, 2:])


def homography(src: np.ndarray, dst: np.ndarray, threshold: float = 5.0, draws: int = 1000) -> tuple[np.ndarray, np.ndarray] | None:
    """(matrix, which points agree) by random samples of four with a fixed seed, fitted again to all that agree."""
    if len(src) < 4:
        return None
    rng, best = np.random.default_rng(11), np.zeros(len(src), bool)
    for _ in range(draws):
        pick = rng.choice(len(src), 4, replace=False)
        h = _fit(src[pick], dst[pick])
        if h is None:
            continue
        agree = np.hypot(*(project(h, src) - dst).T) <= threshold
        if agree.sum() > best.sum():
            best = agree
            if best.all():
                break
    if best.sum() < 4:
        return None
    h = _fit(src[best], dst[best])
    if h is None:
        return None
    return h, np.hypot(*(project(h, src) - dst).T) <= threshold


def refined(fixed: DataFrame, moving: DataFrame, values: list[str], width: int, height: int, limit: int = 2000, least: int = 10, threshold: float = 5.0) -> tuple[DataFrame, float | None]:
    """(moving on fixed's grid, mean distance of agreeing points), from fixed (y, x, grey) and moving (y, x, grey, values).

    With fewer than `least` keypoints or matches, or no homography, moving stays as it is and the distance is None. Values
    are interpolated between four pixels; outside moving's raster they are 0. At most `limit` matches reach the driver.
    """
    f, m = (written(keypoints(d, width, height, limit)) for d in (fixed, moving))
    same = moving.select("y", "x", *values)
    if f.count() < least or m.count() < least:
        return same, None
    rows = matches(f, m).orderBy("fy", "fx").collect()  # at most limit rows
    if len(rows) < least:
        return same, None
    src, dst = np.array([(r.mx, r.my) for r in rows], float), np.array([(r.fx, r.fy) for r in rows], float)
    got = homography(src, dst, threshold)
    if got is None or not got[1].any():
        return same, None
    h, agree = got
    error = float(np.hypot(*(project(h, src[agree]) - dst[agree]).T).mean())
    return warped(same, values, np.linalg.inv(h), width, height), error


def warped(df: DataFrame, values: list[str], back: np.ndarray, width: int, height: int) -> DataFrame:
    """y, x and values where back, a 3 x 3 matrix, takes (x, y) of the result to (x, y) of df."""
    y, x = F.col("y"), F.col("x")
    row = lambda i: float(back[i, 0]) * x + float(back[i, 1]) * y + float(back[i, 2])
    grid = df.sparkSession.range(width * height).select(F.expr(f"id div {width}").alias("y"), F.expr(f"id % {width}").alias("x"))
    at = grid.select("y", "x", (row(1) / row(2)).alias("sy"), (row(0) / row(2)).alias("sx"))
    fy, fx = F.floor("sy"), F.floor("sx")
    corners = F.array(*[F.struct((fy + dy).alias("gy"), (fx + dx).alias("gx"), ((1 - F.abs(F.col("sy") - fy - dy)) * (1 - F.abs(F.col("sx") - fx - dx))).alias("k")) for dy in (0, 1) for dx in (0, 1)])
    near = at.select("y", "x", F.explode(corners).alias("c")).select("y", "x", "c.*").where("k > 0")
    source = df.select(F.col("y").alias("gy"), F.col("x").alias("gx"), *values)
    got = near.join(source, ["gy", "gx"]).groupBy("y", "x").agg(*[F.sum(F.col(v) * F.col("k")).alias(v) for v in values])
    return grid.join(got, ["y", "x"], "left").select("y", "x", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])
