"""Catalog search: filters that reach the scan, and a top-k without a full sort."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_bbox(bbox: tuple[float, float, float, float] | None, latitude: float | None, longitude: float | None, buffer: float = 0.02) -> tuple[float, float, float, float] | None:
    """(min lon, min lat, max lon, max lat): the given box, else a square about the point, else none."""
    if bbox is not None:
        return bbox
    if latitude is None or longitude is None:
        return None
    return longitude - buffer, latitude - buffer, longitude + buffer, latitude + buffer


def search(catalog: DataFrame, target: dt.datetime, bbox: tuple[float, float, float, float] | None, window_days: int = 365, max_cloud: float = 20.0, limit: int = 15) -> DataFrame:
    """The `limit` scenes nearest in time, then least cloudy, within the box and the window and under max_cloud, strictly.

    Without a box there are none. Ties go to the smaller id; a missing cloud cover sorts as 100, and fails the filter.
    """
    if bbox is None:
        return catalog.limit(0)
    low, high = target - dt.timedelta(days=window_days), target + dt.timedelta(days=window_days)
    t = F.lit(target).cast("timestamp_ntz")
    near = F.abs(F.expr("timestampdiff(MICROSECOND, datetime, target)")).alias("distance_us")
    rows = catalog.where(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))
    rows = rows.where(F.col("datetime").between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")) & (F.col("cloud_cover") < max_cloud))
    return rows.withColumn("target", t).select("id", "cloud_cover", near).orderBy("distance_us", F.coalesce("cloud_cover", F.lit(100.0)), "id").limit(limit)
