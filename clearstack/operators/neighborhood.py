"""Neighbourhood operators over pixels (y, x, ...), as separable windows: one shuffle by row, one by column.

Distances are found in squares of the raster, a task each, in one shuffle.

Windows run within tiles of TILE places of a row or column, whose edges are copied as far as a window reaches: a task
holds a tile, however long a row is, and windows are bounded, so time grows in proportion to the pixels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearstack.session import ship

#: Places of one tile of a row or column.
TILE = 512
#: Rows and columns of a square in which distances are found; a task holds one and its surroundings.
SQUARE = 256


def tiles(axis: str, back: int, on: int) -> Column:
    """A row for each tile whose windows see the pixel: its own, and one that its edge is copied to."""
    c = F.col(axis)
    return F.explode(F.sequence(F.floor((c - on) / TILE), F.floor((c + back) / TILE)))


def own_tile(axis: str) -> Column:
    return F.floor(F.col(axis) / TILE) == F.col("tile")


def _mirrored(df: DataFrame, axis: str, n: int, reach: int) -> DataFrame:
    """df with reflected copies beyond both edges of an axis of n pixels, the edge pixel repeated."""
    c = F.col(axis)
    places = F.array(c, F.when(c < reach, -1 - c), F.when(c >= n - reach, 2 * n - 1 - c))
    others = [x for x in df.columns if x != axis]
    return df.select(*others, F.explode(F.filter(places, lambda p: p.isNotNull())).alias(axis))


def box_sums(df: DataFrame, columns: list[str], size: int, width: int, height: int) -> DataFrame:
    """y, x and the sums of columns over size x size windows with reflected edges; an even window reaches further back."""
    back, on = size // 2, (size - 1) // 2
    out = df.select("y", "x", *columns)
    for axis, other, n in (("x", "y", width), ("y", "x", height)):
        w = Window.partitionBy(other, "tile").orderBy(axis).rangeBetween(-back, on)
        padded = _mirrored(out, axis, n, back).withColumn("tile", tiles(axis, back, on))
        sums = padded.select("y", "x", "tile", *[F.sum(c).over(w).alias(c) for c in columns])
        out = sums.where(F.col(axis).between(0, n - 1) & own_tile(axis)).drop("tile")
    return out


def local_stats(df: DataFrame, value: str, weight: str, size: int, width: int, height: int) -> DataFrame:
    """y, x, mean and std of value where weight is 1; without any weight in the window the mean is 0.

    Sums are taken over whole numbers and scaled to means over the window, so every engine gets the same.
    """
    w, v = F.col(weight), F.col(value)
    sums = box_sums(df.select("y", "x", w.alias("sw"), (v * w).alias("sv"), (v * v * w).alias("sq")), ["sw", "sv", "sq"], size, width, height)
    area = float(size * size)
    share = F.greatest(F.col("sw") / area, F.lit(1e-6))
    mean = (F.col("sv") / area) / share
    return sums.select("y", "x", mean.alias("mean"), F.sqrt(F.greatest((F.col("sq") / area) / share - mean * mean, F.lit(1e-6))).alias("std"))


def distance_squared(mask: DataFrame, pixels: DataFrame, reach: int) -> DataFrame:
    """y, x and d2, the squared distance of each pixel to the nearest mask pixel (y, x), null beyond reach.
    """
    marked = pixels.select("y", "x").join(mask.select("y", "x", F.lit(0).cast("long").alias("id")), ["y", "x"], "left")
    return nearest_marks(marked, reach).select("y", "x", F.col("near.d2").alias("d2"))


def nearest_in_square(y: np.ndarray, x: np.ndarray, my: np.ndarray, mx: np.ndarray, rank: np.ndarray, side: int, reach: int) -> np.ndarray:
    """For places (y, x) of a square from 0 on, (squared distance << 32) + rank of the nearest mark, the least rank of equally near ones.

    Marks may lie up to reach outside. The nearest in each column comes first, then the least over columns.
    """
    n = side + 2 * reach
    grid = np.full((n, n), 1 << 62)
    np.minimum.at(grid, (my + reach, mx + reach), rank)
    tall, best = np.full((side, n), 1 << 62), np.full((side, side), 1 << 62)
    for d in range(n - side + 1):
        np.minimum(tall, grid[d : d + side] + ((d - reach) ** 2 << 32), out=tall)
    for d in range(n - side + 1):
        np.minimum(best, tall[:, d : d + side] + ((d - reach) ** 2 << 32), out=best)
    return best[y, x]


def nearest_marks(marked: DataFrame, reach: int) -> DataFrame:
    """y, x and near, a struct of d2 and id of the nearest marked pixel (y, x, id; id is null for others), the least id of equally near ones.

    near is null beyond reach. Marks are copied to the squares that they reach, other pixels go to their own alone.
    """
    ship(marked.sparkSession)
    side = SQUARE

    def within(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy() - int(key[0]) * side, rows["x"].to_numpy() - int(key[1]) * side
        own, mark = (y >= 0) & (y < side) & (x >= 0) & (x < side), rows["mark"].to_numpy(dtype=bool)
        out = rows.loc[own, ["y", "x"]]
        if not mark.any():
            return out.assign(d2=pd.array([pd.NA] * len(out), "Int64"), id=pd.array([pd.NA] * len(out), "Int64"))
        ids, rank = np.unique(rows["id"].to_numpy()[mark], return_inverse=True)
        got = nearest_in_square(y[own], x[own], y[mark], x[mark], rank, side, reach)
        far = got >> 32 > reach * reach
        nearest = ids[np.where(far, 0, got & 0xFFFFFFFF)]
        return out.assign(d2=pd.arrays.IntegerArray(got >> 32, far), id=pd.arrays.IntegerArray(nearest, far))

    def squares(axis: str) -> Column:
        at = lambda c: F.floor(c / side)
        c = F.col(axis)
        return F.explode(F.when(F.col("mark"), F.sequence(at(c - reach), at(c + reach))).otherwise(F.array(at(c))))

    mark = F.col("id").isNotNull().alias("mark")
    rows = marked.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), mark)
    rows = rows.select("*", squares("y").alias("ty")).select("*", squares("x").alias("tx"))
    found = rows.groupBy("ty", "tx").applyInPandas(within, "y long, x long, d2 long, id long")
    return found.select("y", "x", F.when(F.col("d2").isNotNull(), F.struct("d2", "id")).alias("near"))


TAPS = (1, 4, 6, 4, 1)


def _folded(i: int, n: int) -> int:
    """Reflection about the edge pixel's centre, as often as needed: -1 is 1, n is n - 2."""
    while n > 1 and not 0 <= i < n:
        i = -i if i < 0 else 2 * n - 2 - i
    return i if n > 1 else 0


def _places(axis: str, outside: dict[int, int]):
    """A pixel's own position and those outside the raster that it stands for."""
    s = F.col(axis)
    others = F.array(*[F.struct(F.lit(p).cast("long").alias("p"), F.lit(i).cast("long").alias("i")) for p, i in outside.items()])
    edge = F.transform(F.filter(others, lambda o: o.i == s), lambda o: o.p)
    stands = F.when(s.isin(*sorted(set(outside.values()))), F.concat(F.array(s.cast("long")), edge)).otherwise(F.array(s.cast("long")))
    return F.explode(stands)


def _scattered(df: DataFrame, values: list[str], axis: str, outside: dict[int, int], up: bool, n: int) -> DataFrame:
    """Each pixel gives its tap-weighted values to the n results along an axis that have it under a tap; sums are partial first."""
    other = "y" if axis == "x" else "x"
    taps = F.array(*[F.struct(F.lit(t - 2).alias("d"), F.lit(k).alias("k")) for t, k in enumerate(TAPS)])
    goals = df.select(other, *values, _places(axis, outside).alias("p")).select("*", F.explode(taps).alias("t"))
    if up:
        goals = goals.withColumn(axis, 2 * F.col("p") + F.col("t.d"))
    else:
        goals = goals.withColumn("c", F.col("p") - F.col("t.d")).where("c % 2 = 0").withColumn(axis, F.expr("c div 2"))
    return goals.where(F.col(axis).between(0, n - 1)).groupBy(axis, other).agg(*[F.sum(F.col(v) * F.col("t.k")).alias(v) for v in values])


def pyramid_down(df: DataFrame, values: list[str], width: int, height: int) -> DataFrame:
    """y, x and the 5-tap weighted sums (256 times the means) at every second pixel, edges mirrored about the edge pixel."""
    out = df.select("y", "x", *values)
    for axis, n in (("x", width), ("y", height)):
        out = _scattered(out, values, axis, {p: _folded(p, n) for p in (-2, -1, n, n + 1)}, False, (n + 1) // 2)
    return out.select("y", "x", *values)


def pyramid_up(df: DataFrame, values: list[str], width: int, height: int) -> DataFrame:
    """y, x and 64 times the values of a raster of twice the size (width and height are the result's).

    Below the first pixel stands the second, beyond the last pixel stands itself.
    """
    out = df.select("y", "x", *values)
    for axis, n in (("x", width), ("y", height)):
        half = (n + 1) // 2
        out = _scattered(out, values, axis, {-1: min(1, half - 1), half: half - 1}, True, n)
    return out.select("y", "x", *values)


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights from -r to r, r four deviations, that add up to 1."""
    r = int(4 * sigma + 0.5)
    k = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [v / sum(k) for v in k]


def gaussian(df: DataFrame, values: list[str], sigma: float, width: int, height: int, mirror: bool = False) -> DataFrame:
    """y, x and values smoothed by a Gaussian; beyond the edges the edge pixel goes on, or the raster is mirrored about it.

    One shuffle an axis; a window holds 8 sigma + 1 pixels. A missing pixel counts as 0.
    """
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    weights = F.array(*[F.lit(k) for k in kernel])
    out = df.select("y", "x", *[F.col(v).cast("double").alias(v) for v in values])
    for axis, other, n in (("x", "y", width), ("y", "x", height)):
        beyond = [*range(-r, 0), *range(n, n + r)]
        outside = {p: _folded(p, n) if mirror else min(max(p, 0), n - 1) for p in beyond}
        padded = out.select(other, *values, _places(axis, outside).alias(axis))
        padded = padded.withColumn("tile", tiles(axis, r, r))
        near = F.collect_list(F.struct(axis, *values)).over(Window.partitionBy(other, "tile").orderBy(axis).rangeBetween(-r, r))
        near = padded.select("y", "x", "tile", near.alias("near")).where(F.col(axis).between(0, n - 1) & own_tile(axis))
        add = lambda v, axis=axis: F.aggregate("near", F.lit(0.0), lambda a, p: a + p[v] * F.get(weights, (p[axis] - F.col(axis) + r).cast("int")))
        out = near.select("y", "x", *[add(v).alias(v) for v in values])
    return out
