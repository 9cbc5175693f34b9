"""From a cloudy raster and a stack of other scenes to a clear one: masks, replacement, colours, seams, detail.

Pixels are (y, x, bands ..., scl or not); values are digital numbers, 10,000 for a reflectance of 1. What several later
steps read is written once to the shared folder. The only values that reach the driver are counts.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearstack.config import Config
from clearstack.operators import blending, color, components, morphology, neighborhood, plugins, pointwise, poisson, stack
from clearstack.session import written

#: Told of each named stage: its name, its pixels, and the column or columns to look at.
Keep = Callable[[str, DataFrame, list[str]], Any]


@dataclass
class Result:
    pixels: DataFrame
    mask: DataFrame
    unresolved: DataFrame
    metrics: dict[str, Any] = field(default_factory=dict)


def shadow_offset(config: Config) -> tuple[int, int]:
    """(dy, dx) from a cloud to its shadow, by the sun's place; (15, -15) where that is unknown."""
    if config.sun_azimuth_deg is None or config.sun_elevation_deg is None:
        return 15, -15
    far = config.assumed_cloud_height_px / math.tan(math.radians(max(config.sun_elevation_deg, 1.0)))
    turn = math.radians(config.sun_azimuth_deg)
    return round(-far * math.cos(turn)), round(-far * math.sin(turn))


def shadow_offsets(azimuth: Column, elevation: Column, height: float) -> tuple[Column, Column]:
    """(dy, dx) as columns, for the sun's place of each row in degrees."""
    far = F.lit(height) / F.tan(F.radians(F.greatest(elevation, F.lit(1))))
    turn = F.radians(azimuth)
    return F.rint(-far * F.cos(turn)).cast("int"), F.rint(-far * F.sin(turn)).cast("int")


def _luminance(bands: list[str]) -> Column:
    return sum((F.col(b).cast("double") for b in bands), F.lit(0.0)) / len(bands)


def cloud_mask(pixels: DataFrame, bands: list[str], width: int, height: int, config: Config, detector: plugins.Detector | None = None) -> DataFrame:
    """y, x, m: classes and the detector's probability, with borders and halo.

    Without classes, and without a detector or ten bands for it, pixels that are bright and flat stand in.
    """
    has_scl = "scl" in pixels.columns
    spectra = pixels.withColumn("bands", F.array(*[F.col(b).cast("double") / 10000.0 for b in bands])).withColumn("dn", _luminance(bands))
    core, thin = config.cloud_prob_threshold, config.thin_cloud_threshold
    if detector is not None and len(bands) >= 10:
        rows = written(spectra.withColumn("p", plugins.cloud_probability(F.col("bands"), detector)))
        seen = F.col("p") >= min(core, thin)
        if config.use_adaptive_threshold:
            size = config.adaptive_block_size | 1
            sums = neighborhood.box_sums(rows, ["p"], size, width, height).withColumnRenamed("p", "around")
            rows = rows.join(sums, ["y", "x"])
            seen = seen | (F.col("p") >= F.col("around") / float(size * size) + config.adaptive_offset)
    elif not has_scl:
        rows, seen = pointwise.bright_flat(spectra), F.col("bright_flat")
    else:
        rows, seen = spectra, F.lit(False)
    if has_scl:
        seen = seen | F.coalesce(F.col("scl").isin(*config.scl_cloud_classes), F.lit(False))
    base = written(rows.select("y", "x", "dn", seen.alias("m")))
    only = base.select("y", "x", "m")
    ring = morphology.border_ring(only, config.border_ring_px).withColumnRenamed("m", "ring")
    glow = morphology.halo(base, config.halo_search_px, config.halo_brightness_margin, width, height).withColumnRenamed("m", "glow")
    return only.join(ring, ["y", "x"]).join(glow, ["y", "x"]).select("y", "x", (F.col("m") | F.col("ring") | F.col("glow")).alias("m"))


def shadow_mask(pixels: DataFrame, cloud: DataFrame, bands: list[str], width: int, height: int, config: Config) -> DataFrame:
    """y, x, m: the shadow class, and dark pixels where clouds throw their shadow, grown, without cloud."""
    dy, dx = shadow_offset(config)
    dark = pointwise.dark_objects(pixels.withColumn("lum", _luminance(bands)), "lum", config.shadow_dark_percentile)
    spots = cloud.where("m").select("y", "x")
    moved = morphology.shifted(spots, dy, dx, width, height).withColumn("moved", F.lit(True))
    near = neighborhood.distance_squared(spots, cloud, max(abs(dy), abs(dx)) + 5)
    rows = dark.join(cloud, ["y", "x"]).join(moved, ["y", "x"], "left").join(near, ["y", "x"])
    core = F.col("dark") & ~F.col("m") & F.col("moved").isNotNull() & F.col("d2").isNotNull()
    if "scl" in pixels.columns:
        core = core | F.coalesce(F.col("scl") == config.scl_shadow_class, F.lit(False))
    grown = rows.select("y", "x", core.alias("m"))
    if config.shadow_grow_px > 0:
        grown = morphology.dilate(grown, 2 * config.shadow_grow_px + 1)
    return grown.withColumnRenamed("m", "grown").join(cloud, ["y", "x"]).select("y", "x", (F.col("grown") & ~F.col("m")).alias("m"))


def clean_mask(mask: DataFrame, width: int, config: Config, keep: Keep | None = None) -> DataFrame:
    """y, x, m opened, closed, without small objects and small holes."""
    shape = written(morphology.closed(written(morphology.opened(mask, config.morph_kernel_size)), config.morph_kernel_size))
    large = written(components.without_small(components.label(shape.where("m"), width), config.min_object_size).select("y", "x"))
    full = components.holes_filled(large, shape, width, config.min_hole_size).distinct().withColumn("full", F.lit(True))
    out = written(shape.select("y", "x").join(full, ["y", "x"], "left").select("y", "x", F.col("full").isNotNull().alias("m")))
    if keep is not None:
        keep("08_cleaned_mask", out, ["m"])
    return out


def grown_mask(mask: DataFrame, width: int, config: Config) -> DataFrame:
    labelled = written(components.label(mask.where("m"), width))
    grown = components.expanded(labelled, mask, config.dilation_scale, config.dilation_min_px, config.dilation_max_px).withColumn("in", F.lit(True))
    return mask.select("y", "x").join(grown, ["y", "x"], "left").select("y", "x", F.col("in").isNotNull().alias("m"))


def replaced(pixels: DataFrame, observations: DataFrame, bands: list[str], width: int, height: int, config: Config) -> DataFrame:
    """pixels (y, x, m, bands) with masked values from the stack, and unresolved: masked, and no layer for any stacked band.

    Stacked bands take the weighted median, weighted by the scene, by the likeness to the mean of clear pixels around, and
    by clearness; further bands take the scene of greatest weight where that is clear. Bands a stack lacks stay.
    """
    have = [b for b in bands if b in observations.columns]
    first, more = have[: config.stack_band_count], have[config.stack_band_count :]
    clear = pixels.select("y", "x", (~F.col("m")).cast("long").alias("w"), *[(F.when(F.col("m"), 0).otherwise(F.col(b))).cast("double").alias(b) for b in first])
    sums = neighborhood.box_sums(clear, ["w", *first], config.local_color_window, width, height)
    area = float(config.local_color_window**2)
    means = sums.select("y", "x", *[((F.col(b) / area) / F.greatest(F.col("w") / area, F.lit(1e-6))).alias(f"mean_{b}") for b in first])
    wanted = pixels.where("m").select("y", "x").join(means, ["y", "x"])
    rows = observations.join(wanted, ["y", "x"]).withColumn("clear", F.coalesce("clear", F.lit(True)))

    def units(b: str) -> Column:
        likeness = stack.similarity(F.col(b).cast("double") / 10000.0, F.col(f"mean_{b}") / 10000.0, config.spectral_similarity_sigma)
        return stack.in_units(F.when(F.col("clear"), F.col("weight") * likeness).otherwise(0.0))

    medians = stack.weighted_medians(rows, ["y", "x"], {b: (F.col(b).cast("double"), units(b)) for b in first}, "scene")
    has = {b: ~F.coalesce(f"no_data_{b}", F.lit(True)) for b in first}
    found = medians.select("y", "x", *[F.when(has[b], F.col(f"median_{b}")).alias(f"new_{b}") for b in first], functools.reduce(operator.or_, has.values(), F.lit(False)).alias("any")).where("any")
    out = pixels.join(found, ["y", "x"], "left")
    if more:
        top = observations.groupBy("scene").agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "scene").limit(1).select("scene")
        best = observations.join(F.broadcast(top), "scene", "left_semi").where(F.coalesce("clear", F.lit(True))).select("y", "x", *[F.col(b).alias(f"new_{b}") for b in more])
        out = out.join(best, ["y", "x"], "left")
    value = lambda b: F.when(F.col("m"), F.coalesce(F.col(f"new_{b}"), F.col(b))).otherwise(F.col(b)) if b in have else F.col(b)
    return out.select("y", "x", "m", *[value(b).cast("double").alias(b) for b in bands], (F.col("m") & F.col("any").isNull()).alias("unresolved"))


def reconstruct(pixels: DataFrame, observations: DataFrame, bands: list[str], width: int, height: int, config: Config | None = None, detector: plugins.Detector | None = None, inpainter: plugins.Inpainter | None = None, keep: Keep | None = None) -> Result:
    """The clear raster (y, x, bands as whole digital numbers), its masks and metrics.

    pixels must hold each place of the raster once. observations are (y, x, scene, bands, clear, weight), at most one for
    a place and scene; none at all leave the raster as it is but for blending. Null values count as 0.
    """
    config = config or Config()
    look = keep or (lambda *_: None)
    clip = lambda b: F.least(F.greatest(F.coalesce(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(10000.0)).alias(b)
    target = written(pixels.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *[clip(b) for b in bands], *(["scl"] if "scl" in pixels.columns else [])))
    cloud = written(cloud_mask(target, bands, width, height, config, detector))
    look("06_cloud_mask", cloud, ["m"])
    shadow = written(shadow_mask(target, cloud, bands, width, height, config))
    look("07_shadow_mask", shadow, ["m"])
    both = cloud.join(shadow.withColumnRenamed("m", "s"), ["y", "x"]).select("y", "x", (F.col("m") | F.col("s")).alias("m"))
    mask = written(grown_mask(clean_mask(both, width, config, keep), width, config))
    look("09_expanded_mask", mask, ["m"])
    filled = written(replaced(target.join(mask, ["y", "x"]), observations, bands, width, height, config))
    sums = filled.agg(F.count("*").alias("n"), F.count_if("m").alias("m"), F.count_if("unresolved").alias("u")).first()
    metrics = {"cloud_percentage": 100.0 * sums.m / max(sums.n, 1), "cloud_pixels": sums.m, "unfilled_pixels": sums.u}
    if inpainter is not None and config.use_ai_inpainting and sums.u and len(bands) >= 3:
        names = dict(zip(bands[:3], "rgb", strict=True))
        as_rgb = filled.select("y", "x", "m", *[F.col(b).alias(names.get(b, b)) for b in bands], "unresolved")
        got = plugins.inpaint(as_rgb, inpainter)
        filled = written(got.select("y", "x", "m", *[F.col(names.get(b, b)).cast("double").alias(b) for b in bands], "unresolved"))
    look("11_selected_pixels", filled.select("y", "x", *[pointwise_masked(b) for b in bands]), bands[:3])
    if not sums.m:  # nothing to fit in
        out = target.select("y", "x", *[_whole(b) for b in bands])
        return Result(out, mask, filled.where("unresolved").select("y", "x"), metrics)
    labelled = written(components.label(mask.where("m"), width))
    final = filled.select("y", "x")
    for b in bands:
        pair = written(filled.select("y", "x", "m", F.col(b).alias("result")).join(target.select("y", "x", F.col(b).alias("cloudy")), ["y", "x"]))
        matched = color.blob_histogram_match(pair, labelled, width, height, config.local_match_margin)
        evened = written(color.brightness_corrected(pair.drop("result").join(matched.withColumnRenamed("v", "result"), ["y", "x"]), config.local_color_window, width, height))
        seam = written(pair.select("y", "x", "m", F.col("cloudy").alias("b")).join(evened.withColumnRenamed("v", "a"), ["y", "x"]))
        blended = blending.laplacian_blend(seam, width, height, config.feather_radius, config.pyramid_levels)
        if config.use_poisson_blending and b in bands[:3]:
            soft = written(blended)
            inner = poisson.poisson_blend(seam.select("y", "x", "m", "b").join(soft.withColumnRenamed("v", "a"), ["y", "x"]))
            both_v = soft.join(inner.withColumnRenamed("v", "inner"), ["y", "x"]).join(mask, ["y", "x"])
            blended = both_v.select("y", "x", F.when(F.col("m"), F.col("inner")).otherwise(F.col("v")).alias("v"))
        rows = written(blended.join(pair.select("y", "x", "m", F.col("result").alias("detail")), ["y", "x"]))
        refined = written(blending.refined_texture(rows, width, height, config.texture_refinement_strength, config.texture_blur_sigma))
        final = final.join(refined.withColumnRenamed("v", b), ["y", "x"])
    out = written(final.select("y", "x", *[_whole(b) for b in bands]))
    look("14_final", out, bands[:3])
    return Result(out, mask, filled.where("unresolved").select("y", "x"), metrics)


def pointwise_masked(band: str) -> Column:
    return F.when(F.col("m"), F.col(band)).otherwise(0).alias(band)


def _whole(band: str) -> Column:
    return pointwise.denormalize(F.col(band) / 10000.0).alias(band)
