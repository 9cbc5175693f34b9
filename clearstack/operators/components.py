"""4-connected components of a mask: within square tiles in one pass, then between them.

A tile's components are found by one task in memory; only components that meet across the edge of a tile are linked.
Labels travel along these links and then jump to the label of their label, so a component over n tiles takes about log n
rounds. Every round is written to the folder in spark.checkpoint.dir; nothing but an emptiness test reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearstack.operators.neighborhood import nearest_marks
from clearstack.session import discard, ship, written


#: Rows and columns of a tile: a task holds so many pixels squared.
TILE = 256
#: Rounds of label propagation; a component over n tiles takes about log n.
MAX_ROUNDS = 60


def _roots(n: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The least of the numbers under n that each is linked with, by links of one[i] and other[i]."""
    root = np.arange(n)
    while True:
        a, b = root[one], root[other]
        apart = a != b
        if not apart.any():
            return root
        one, other, a, b = one[apart], other[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


def tile_components(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each of the pixels of a tile, each given once, the place of the first (by y, then x) of its component."""
    order = np.lexsort((x, y))
    y, x = y[order] - y.min(), x[order] - x.min()
    at = np.full((y.max() + 2, x.max() + 2), -1)
    at[y, x] = np.arange(len(y))
    right, below = at[y, x + 1], at[y + 1, x]
    own = np.arange(len(y))
    root = _roots(len(y), np.concatenate([own[right >= 0], own[below >= 0]]), np.concatenate([right[right >= 0], below[below >= 0]]))
    out = np.empty(len(y), dtype=np.int64)
    out[order] = order[root]
    return out


def label(mask: DataFrame, width: int) -> DataFrame:
    """y, x and blob (the least y * width + x of the component) of the true pixels (y, x) of a sparse mask, each once."""
    ship(mask.sparkSession)

    def within(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.drop_duplicates(["y", "x"])
        y, x = tile["y"].to_numpy(), tile["x"].to_numpy()
        return pd.DataFrame({"y": y, "x": x, "part": (y * width + x)[tile_components(y, x)]})

    pixels = mask.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    parts = written(pixels.groupBy(F.floor(F.col("y") / TILE).alias("ty"), F.floor(F.col("x") / TILE).alias("tx")).applyInPandas(lambda _, tile: within(tile), "y long, x long, part long"))
    # Pixels at a tile's last row or column, each moved on by one, meet those of the next tile.
    on = [parts.where(F.pmod(F.col(c) + 1, F.lit(TILE)) == 0).select(*[(F.col(a) + int(a == c)).alias(a) for a in ("y", "x")], F.lit(c).alias("over"), F.col("part").alias("other")) for c in ("y", "x")]
    first = [parts.where(F.pmod(F.col(c), F.lit(TILE)) == 0).select("y", "x", F.lit(c).alias("over"), F.col("part").alias("run")) for c in ("y", "x")]
    links = on[0].union(on[1]).join(first[0].union(first[1]), ["y", "x", "over"]).select("run", "other")
    ways = written(links.union(links.select("other", "run")).distinct())
    if ways.isEmpty():
        discard(ways)
        return parts.withColumnRenamed("part", "blob")
    labels = written(ways.groupBy("run").agg(F.least("run", F.min("other")).alias("blob")))
    for _ in range(MAX_ROUNDS):
        spread = ways.join(labels.select(F.col("run").alias("other"), "blob"), "other").groupBy("run").agg(F.min("blob").alias("near"))
        nearer = labels.join(spread, "run").select("run", "blob", F.least("blob", "near").alias("near"))
        jump = labels.select(F.col("run").alias("near"), F.col("blob").alias("far"))
        after = written(nearer.join(jump, "near").select("run", F.least("near", "far").alias("now"), (F.least("near", "far") < F.col("blob")).alias("moved")))
        discard(labels)
        labels = after.select("run", F.col("now").alias("blob"))
        labels._clearstack_path = after._clearstack_path
        if after.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    discard(ways)
    return parts.join(labels.withColumnRenamed("run", "part"), "part", "left").select("y", "x", F.coalesce("blob", "part").alias("blob"))


def areas(labelled: DataFrame) -> DataFrame:
    """blob, area and bounding box."""
    return labelled.groupBy("blob").agg(F.count("*").alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def without_small(labelled: DataFrame, least: int = 40) -> DataFrame:
    """The pixels of components of at least so many pixels."""
    return labelled.join(areas(labelled).where(F.col("area") >= least).select("blob"), "blob", "left_semi")


def holes_filled(mask: DataFrame, pixels: DataFrame, width: int, least: int = 64) -> DataFrame:
    """The mask with background components of fewer pixels added, also where they touch the edge."""
    rest = pixels.select("y", "x").join(mask.select("y", "x"), ["y", "x"], "left_anti")
    ground = label(rest, width)
    small = areas(ground).where(F.col("area") < least).select("blob")
    return mask.select("y", "x").union(ground.join(small, "blob", "left_semi").select("y", "x"))


def expanded(labelled: DataFrame, pixels: DataFrame, scale: float = 0.30, low: int = 3, high: int = 25) -> DataFrame:
    """The mask grown by clip(sqrt(area / pi) * scale, low, high), by the nearest component's radius; ties to the least blob."""
    sized = areas(labelled).select("blob", F.least(F.greatest(F.sqrt(F.col("area") / math.pi) * scale, F.lit(float(low))), F.lit(float(high))).alias("radius"))
    marks = pixels.select("y", "x").join(labelled.select("y", "x", F.col("blob").alias("id")), ["y", "x"], "left")
    best = nearest_marks(marks, high).where(F.col("near").isNotNull())
    grown = best.select("y", "x", "near.d2", F.col("near.id").alias("blob")).join(sized, "blob").where(F.col("d2") <= F.col("radius") * F.col("radius"))
    return pixels.select("y", "x").join(grown.select("y", "x"), ["y", "x"], "left_semi")
