"""Binary morphology with elliptical footprints over pixels (y, x, m), m a boolean; what lies outside is ignored."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearstack.operators.neighborhood import box_sums, own_tile, tiles


def half_widths(size: int) -> list[int]:
    """Half widths of the rows of a size x size ellipse: round(r * sqrt(1 - (dy / r)^2)), r = size div 2."""
    r = size // 2
    return [int(round(r * math.sqrt(max(0.0, (r * r - dy * dy) / (r * r))))) if r else 0 for dy in range(-r, r + 1)]


def dilate(df: DataFrame, size: int) -> DataFrame:
    """Row maxima for each half width by windows, shifted to the rows that they reach and combined by partial aggregation."""
    widths, r = half_widths(size), size // 2
    m = F.col("m").cast("int")
    most = max(widths)
    tiled = df.select("y", "x", "m", tiles("x", most, most).alias("tile"))
    rows = tiled.select("y", "x", "tile", *[F.max(m).over(Window.partitionBy("y", "tile").orderBy("x").rangeBetween(-w, w)).alias(f"w{w}") for w in sorted(set(widths))]).where(own_tile("x"))
    reach = F.array(*[F.struct((F.col("y") + dy).alias("y"), F.col(f"w{w}").alias("m")) for dy, w in zip(range(-r, r + 1), widths, strict=True)])
    got = rows.select("x", F.explode(reach).alias("p")).where("p.m = 1").groupBy(F.col("p.y").alias("y"), "x").agg(F.lit(1).alias("hit"))
    return df.select("y", "x").join(got, ["y", "x"], "left").select("y", "x", F.col("hit").isNotNull().alias("m"))


def invert(df: DataFrame) -> DataFrame:
    return df.select("y", "x", (~F.col("m")).alias("m"))


def erode(df: DataFrame, size: int) -> DataFrame:
    return invert(dilate(invert(df), size))


def opened(df: DataFrame, size: int = 5) -> DataFrame:
    return dilate(erode(df, size), size)


def closed(df: DataFrame, size: int = 5) -> DataFrame:
    return erode(dilate(df, size), size)


def border_ring(df: DataFrame, radius: int = 3) -> DataFrame:
    """Dilation less erosion: both sides of the edge."""
    size = 2 * radius + 1
    inner = erode(df, size).withColumnRenamed("m", "inner")
    return dilate(df, size).join(inner, ["y", "x"]).select("y", "x", (F.col("m") & ~F.col("inner")).alias("m"))


def halo(df: DataFrame, radius: int, margin: float, width: int, height: int) -> DataFrame:
    """Pixels (y, x, m, dn) near the mask and outside it that outshine their surroundings by margin (of 10,000)."""
    near = dilate(df, 2 * radius + 1).withColumnRenamed("m", "near")
    size = max(4 * radius, 21)
    around = box_sums(df.select("y", "x", "dn"), ["dn"], size, width, height).withColumnRenamed("dn", "sum")
    bright = F.col("dn") * size * size > F.col("sum") + int(margin * 10000) * size * size
    return df.join(near, ["y", "x"]).join(around, ["y", "x"]).select("y", "x", (F.col("near") & ~F.col("m") & bright).alias("m"))


def shifted(mask: DataFrame, dy: int, dx: int, width: int, height: int) -> DataFrame:
    """The true pixels (y, x) of a sparse mask moved, without those that leave the image."""
    return mask.select((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")).where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
