"""Interfaces of the optional models, a cloud detector and an inpainter, and what holds without them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A detector gives the cloud probability (0 to 1) as a column of an array of ten bands: built-in functions or a pandas UDF.
Detector = Callable[[Column], Column]
#: An inpainter gives (y, x, r, g, b) for pixels it can fill, from pixels (y, x, r, g, b, unresolved).
Inpainter = Callable[[DataFrame], DataFrame]


def detector_bands(bands: Column) -> Column:
    """The first ten bands."""
    return F.slice(bands, 1, 10)


def cloud_probability(bands: Column, detector: Detector | None = None) -> Column:
    """The detector's probability; 0 without a detector, for null, or for fewer than ten bands."""
    none = F.lit(0.0)
    if detector is None:
        return none
    enough = F.coalesce(F.size(bands) >= 10, F.lit(False))
    return F.when(enough, F.least(F.greatest(detector(detector_bands(bands)).cast("double"), none), F.lit(1.0))).otherwise(none)


def inpaint(df: DataFrame, inpainter: Inpainter | None = None) -> DataFrame:
    """df (y, x, r, g, b, unresolved, ...) with unresolved pixels filled where the inpainter gives values; unchanged without one."""
    if inpainter is None:
        return df
    new = inpainter(df.select("y", "x", "r", "g", "b", "unresolved")).select("y", "x", *[F.col(c).alias(f"new_{c}") for c in "rgb"])
    both = df.join(new, ["y", "x"], "left")
    swap = {c: F.when(F.col("unresolved"), F.coalesce(F.col(f"new_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) for c in "rgb"}
    return both.select(*[swap.get(c, F.col(c)) for c in df.columns])
