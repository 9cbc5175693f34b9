"""Operators that look at one pixel at a time, and global percentiles of one column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCL_CLOUD, SCL_SHADOW = (8, 9, 10, 11), 3


def normalize(dn: Column, top: float = 10000.0) -> Column:
    """Digital numbers as 32-bit reflectance, clipped to 0..1."""
    return F.least(F.greatest(dn / top, F.lit(0.0)), F.lit(1.0)).cast("float")


def denormalize(v: Column, top: float = 10000.0) -> Column:
    """Reflectance as digital numbers by a 32-bit product, cut off rather than rounded: 7 comes back as 6."""
    clipped = F.least(F.greatest(v.cast("float"), F.lit(0.0).cast("float")), F.lit(1.0).cast("float"))
    return (clipped * F.lit(top).cast("float")).cast("float").cast("int")


def is_cloud(scl: Column) -> Column:
    return scl.isin(*SCL_CLOUD)


def is_clear(scl: Column) -> Column:
    """Neither cloud nor shadow; class 0, no data, counts as clear."""
    return ~scl.isin(*SCL_CLOUD, SCL_SHADOW)


def luminance(bands: Column) -> Column:
    return F.aggregate(bands, F.lit(0.0), lambda a, b: a + b.cast("double"), lambda a: a / F.size(bands))


def spread(bands: Column) -> Column:
    """Population standard deviation over a pixel's bands."""
    m = luminance(bands)
    return F.sqrt(F.aggregate(bands, F.lit(0.0), lambda a, b: a + (b.cast("double") - m) * (b.cast("double") - m), lambda a: a / F.size(bands)))


#: Bins of a pass over a column's values, and values that the driver may hold of one bin.
BINS, HELD = 1 << 12, 1 << 14


def percentile(df: DataFrame, column: str, share: float) -> float | None:
    """The exact percentile of a column of numbers, interpolated between its two neighbours; null without values.

    Passes count values by bins, and each goes on with the bins that hold the two places, until these have few distinct
    values: no task or driver holds more than BINS counts or HELD values, whatever the column's length and type.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    place = share * (n - 1)
    under, over = math.floor(place), math.ceil(place)
    one, other = (_at_rank(values, k, low, high) for k in (under, over)) if over > under else [_at_rank(values, under, low, high)] * 2
    return one if one == other else (over - place) * one + (place - under) * other


def _at_rank(values: DataFrame, rank: int, low: float, high: float) -> float:
    """The value at a place, from 0, of the values from low to high in order."""
    while low < high:
        step = (high - low) / BINS
        bin_ = F.least(F.floor((F.col("v") - low) / step), F.lit(BINS - 1)) if step > 0 else F.lit(0)
        inside = values.where(F.col("v").between(low, high))
        rows = inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.approx_count_distinct("v").alias("kinds")).orderBy("bin").collect()
        for r in rows:
            if rank < r.n:
                break
            rank -= r.n
        if r.low == r.high:
            return r.low
        if r.kinds <= HELD // 2 or (r.low, r.high) == (low, high):
            counts = inside.where(F.col("v").between(r.low, r.high)).groupBy("v").count().orderBy("v").toLocalIterator()
            for v, k in counts:
                if rank < k:
                    return v
                rank -= k
        low, high = r.low, r.high
    return low


def with_percentiles(df: DataFrame, **wanted: tuple[str, float]) -> DataFrame:
    """df with exact percentiles (column, share) as further columns, all rows alike."""
    return df.withColumns({name: F.lit(percentile(df, c, p)).cast("double") for name, (c, p) in wanted.items()})


def bright_flat(spectra: DataFrame) -> DataFrame:
    """Fallback cloud mask: luminance in the top and spread in the bottom hundredth."""
    rows = spectra.withColumn("lum", luminance(F.col("bands"))).withColumn("spread", spread(F.col("bands")))
    return with_percentiles(rows, p99=("lum", 0.99), p1=("spread", 0.01)).withColumn("bright_flat", (F.col("lum") >= F.col("p99")) & (F.col("spread") <= F.col("p1")))


def dark_objects(pixels: DataFrame, column: str = "dn", percentile: float = 20.0) -> DataFrame:
    """Pixels at most as bright as the scene's percentile, cloud included."""
    return with_percentiles(pixels, limit=(column, percentile / 100)).withColumn("dark", F.col(column) <= F.col("limit")).drop("limit")


def stretch_u8(pixels: DataFrame, column: str = "dn") -> DataFrame:
    """0..255 by the 99th percentile (1 where that is 0), cut off."""
    rows = with_percentiles(pixels, p99=(column, 0.99))
    share = F.col(column) / F.coalesce(F.nullif(F.col("p99"), F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("u8", (F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")).drop("p99")


def threshold_masks(p: Column, core: float = 0.22, thin: float = 0.10) -> dict[str, Column]:
    """core, thin and their union, of a cloud probability."""
    return {"core": p >= core, "thin": (p >= thin) & (p < core), "s2": p >= thin}
