"""Blending of a filled raster into the original, and detail put back: pixels (y, x, a, b, m), a inside the mask m, b outside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearstack.session import written
from clearstack.operators.neighborhood import distance_squared, gaussian, pyramid_down, pyramid_up


def laplacian_blend(df: DataFrame, width: int, height: int, radius: int = 15, levels: int = 5) -> DataFrame:
    """y, x, v: low frequencies change over along a wide seam, high ones along a narrow one.

    The mask is smoothed by a deviation of radius / 2. Each level has a quarter of the pixels of the one before and is
    written once, as the level below and the difference above both read it.
    """
    soft = gaussian(df.select("y", "x", F.col("m").cast("double").alias("m")), ["m"], radius / 2, width, height)
    soft = soft.select("y", "x", F.least(F.greatest("m", F.lit(0.0)), F.lit(1.0)).alias("m"))
    level = df.select("y", "x", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")).join(soft, ["y", "x"])
    sizes, stack = [(width, height)], [written(level)]
    for _ in range(levels):
        w, h = sizes[-1]
        less = pyramid_down(stack[-1], ["a", "b", "m"], w, h)
        stack.append(written(less.select("y", "x", *[(F.col(c) / 256.0).alias(c) for c in ("a", "b", "m")])))
        sizes.append(((w + 1) // 2, (h + 1) // 2))
    mixed = lambda a, b: F.col(a) * F.col("m") + F.col(b) * (1 - F.col("m"))
    v = stack[-1].select("y", "x", mixed("a", "b").alias("v"))
    for k in range(levels - 1, -1, -1):
        # a, b and the blend so far go up together: one pass over the taps.
        up = pyramid_up(stack[k + 1].select("y", "x", "a", "b").join(v, ["y", "x"]), ["a", "b", "v"], *sizes[k])
        up = up.select("y", "x", *[(F.col(c) / 64.0).alias(f"{c}_up") for c in ("a", "b", "v")])
        fine = stack[k].join(up, ["y", "x"]).withColumn("da", F.col("a") - F.col("a_up")).withColumn("db", F.col("b") - F.col("b_up"))
        v = fine.select("y", "x", (F.col("v_up") + mixed("da", "db")).alias("v"))
    return v


def feather_blend(df: DataFrame, width: int, height: int, radius: int = 15) -> DataFrame:
    """y, x, v: a's share grows with the distance to the mask's edge, from either side, and is smoothed by radius / 3.

    Without any mask pixel the share is 0, without any other pixel 1.
    """
    pixels = df.select("y", "x")
    inner = distance_squared(df.where(~F.col("m")), pixels, radius).withColumnRenamed("d2", "inner")
    outer = distance_squared(df.where("m"), pixels, radius).withColumnRenamed("d2", "outer")
    share = F.when(F.col("m"), F.coalesce(F.least(F.sqrt("inner") / radius, F.lit(1.0)), F.lit(1.0))).otherwise(F.coalesce(F.greatest(1 - F.sqrt("outer") / radius, F.lit(0.0)), F.lit(0.0)))
    shares = df.join(inner, ["y", "x"]).join(outer, ["y", "x"]).select("y", "x", share.alias("s"))
    soft = gaussian(shares, ["s"], radius / 3, width, height)
    return df.join(soft, ["y", "x"]).select("y", "x", (F.col("s") * F.col("a") + (1 - F.col("s")) * F.col("b")).alias("v"))


def refined_texture(df: DataFrame, width: int, height: int, strength: float = 0.55, sigma: float = 3.0) -> DataFrame:
    """y, x, v of pixels (y, x, v, detail, m): inside the mask the fine structure of detail, less its smoothed form, is added."""
    low = gaussian(df.select("y", "x", F.col("detail").alias("low")), ["low"], sigma, width, height, mirror=True)
    v = F.when(F.col("m"), F.col("v") + strength * (F.col("detail") - F.col("low"))).otherwise(F.col("v").cast("double"))
    return df.join(low, ["y", "x"]).select("y", "x", v.alias("v"))
