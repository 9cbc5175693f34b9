"""A run over files: read, align, search, reconstruct, and write the results to a folder of its own."""

from __future__ import annotations

import dataclasses
import datetime as dt
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from clearstack.config import Config
from clearstack.operators import features, plugins, pointwise, projection, register
from clearstack.session import written
from clearstack.plans.reconstruct import reconstruct
from clearstack.sources import png, search, tiff
from clearstack.sources.files import RunFolder
from clearstack.sources.runlog import RunLog

#: Bands of a scene's file, in order.
SCENE_BANDS = ["r", "g", "b", "n"]


def wide(pixels: DataFrame, names: list[str]) -> DataFrame:
    """y, x and one column for each band."""
    return pixels.groupBy("y", "x").agg(*[F.max(F.when(F.col("band") == i + 1, F.col("v"))).alias(n) for i, n in enumerate(names)])


def same_grid(a: Row, b: Row) -> bool:
    return (a.crs, a.width, a.height, a.transform) == (b.crs, b.width, b.height, b.transform)


def on_grid(pixels: DataFrame, meta: Row, goal: Row, names: list[str], nearest: bool = False) -> DataFrame:
    """y, x, names on the goal's grid: as they are where the grids agree, else by the affine maps; 0 outside.

    Pixels of another coordinate system are sought by the formulas of `projection`; other systems raise ValueError.
    """
    if same_grid(meta, goal):
        return pixels
    if meta.transform is None or goal.transform is None:
        raise ValueError("a raster without a place can't be aligned")
    a, b, c, d, e, f = goal.transform
    p, q, r, s, t, u = meta.transform
    det = p * t - q * s
    # Pixel centres: half a pixel on, to coordinates, to the source's system, back, half a pixel off.
    cx, cy = F.col("x") + 0.5, F.col("y") + 0.5
    spark = pixels.sparkSession
    grid = spark.range(goal.width * goal.height).select(F.expr(f"id div {goal.width}").alias("y"), F.expr(f"id % {goal.width}").alias("x"))
    at = grid.select("y", "x", (a * cx + b * cy + c).alias("east"), (d * cx + e * cy + f).alias("north"))
    if meta.crs != goal.crs:
        at = projection.between(at, "east", "north", goal.crs, meta.crs)
    X, Y = F.col("east") - r, F.col("north") - u
    at = at.select("y", "x", ((p * Y - s * X) / det - 0.5).alias("at_y"), ((t * X - q * Y) / det - 0.5).alias("at_x"))
    got = (register.nearest if nearest else register.bilinear)(at, pixels, F.col("at_y"), F.col("at_x"), *names)
    return grid.join(got, ["y", "x"], "left").select("y", "x", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def _read(spark: SparkSession, path: str, names: list[str] | None = None) -> tuple[Row, DataFrame, list[str]]:
    meta, pixels = tiff.read_tiff(spark, path)
    m = meta.first()
    use = (names or [*SCENE_BANDS, *[f"b{i}" for i in range(5, m.band_count + 1)]])[: m.band_count]
    return m, wide(pixels, use), use


def _grey(pixels: DataFrame, bands: list[str]) -> DataFrame:
    grey = sum((F.col(b) for b in bands[:3]), F.lit(0.0)) / len(bands[:3])
    return pointwise.stretch_u8(pixels.withColumn("grey", grey), "grey").drop("grey").withColumnRenamed("u8", "grey")


#: Assets of a scene with a file for each band, in the order of SCENE_BANDS, and of its classes.
BAND_ASSETS, CLASS_ASSET = ("B04", "B03", "B02", "B08"), "SCL"
#: Scenes of which a run keeps a picture.
SHOWN = 5


def _scene(spark: SparkSession, row: Row, goal: Row, sign: Callable[[str], str]) -> tuple[DataFrame, str | None]:
    """A scene's bands on the goal's grid, and the file of its classes: from one file, or from its assets, a file each."""
    assets = row.asDict().get("assets")
    if assets is None:
        meta, pixels, _ = _read(spark, sign(row.path), SCENE_BANDS)
        if meta.band_count < len(SCENE_BANDS):
            raise tiff.TiffError("fewer than four bands")
        return on_grid(pixels, meta, goal, SCENE_BANDS), row.asDict().get("scl_path")
    out = None
    for name, asset in zip(SCENE_BANDS, BAND_ASSETS, strict=True):
        if asset not in assets:
            raise tiff.TiffError(f"no asset {asset}")
        meta, pixels, _ = _read(spark, sign(assets[asset]), [name])
        band = on_grid(pixels, meta, goal, [name])
        out = band if out is None else out.join(band, ["y", "x"])
    return out, assets.get(CLASS_ASSET)


def scenes(spark: SparkSession, catalog: DataFrame, goal: Row, target: DataFrame, bands: list[str], config: Config, when: dt.datetime, log: RunLog, sign: Callable[[str], str] = str, show: Callable[[str, DataFrame], Any] | None = None) -> list[DataFrame]:
    """Observations of the scenes that the search finds; those without four readable bands are left out and logged.

    catalog has id, datetime, cloud_cover, lon, lat, and path with scl_path or not, or assets, a map of names to files; a
    collection column is held to the configured one. sign gives the name under which a file can be read now, such as a
    signed address; show is given the first SHOWN scenes. The scenes are at most max_historical_images, so their list is the driver's.
    """
    if "collection" in catalog.columns:
        catalog = catalog.where(F.col("collection") == config.stac_collection)
    box = search.resolve_bbox(config.bbox, config.latitude, config.longitude, config.point_buffer_deg)
    chosen = search.search(catalog, when, box, config.search_window_days, config.cloud_cover_threshold, config.max_historical_images)
    facts = [c for c in ("datetime", "path", "scl_path", "assets") if c in catalog.columns]
    rows = chosen.join(catalog.select("id", *facts), "id").orderBy("distance_us", "id").collect()
    fixed, out = _grey(target, bands), []
    for k, row in enumerate(rows, 1):
        try:
            there, classes_path = _scene(spark, row, goal, sign)
            there = written(there)
            clear = target.select("y", "x", F.lit(True).alias("clear"))
            if classes_path:
                own, classes, _ = _read(spark, sign(classes_path), ["scl"])
                clear = on_grid(classes, own, goal, ["scl"], nearest=True).select("y", "x", pointwise.is_clear(F.col("scl").cast("int")).alias("clear"))
            moved, error = features.refined(fixed, _grey(there, SCENE_BANDS), SCENE_BANDS, goal.width, goal.height, config.orb_features, config.min_match_count, config.ransac_reproj_threshold)
            days = abs((row.datetime - when).total_seconds()) / 86400
            scene = moved.join(clear, ["y", "x"], "left").withColumn("scene", F.lit(k)).withColumn("weight", F.lit(1.0 / (1.0 + days)))
            out.append(written(scene))
            if show is not None and k <= SHOWN:
                show(str(row.id), out[-1])
            log.scene(str(row.id), row.datetime, row.cloud_cover, error)
        except Exception as e:  # one unreadable scene mustn't end a run: it is named in the log
            log.say(f"scene {row.id} left out: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
    return out


def run(spark: SparkSession, cloudy: str, reference: str | None = None, scl: str | None = None, catalog: DataFrame | None = None, config: Config | None = None, detector: plugins.Detector | None = None, inpainter: plugins.Inpainter | None = None, log: RunLog | None = None, sign: Callable[[str], str] = str) -> dict[str, Any]:
    """run_dir, geotiff, png, log, cloud_percentage and temporal_layers of a run; paths are of any store that Spark reads."""
    config, log = config or Config(), log or RunLog()
    folder = RunFolder(spark, config.output_root)
    log.say(f"results go to {folder.folder}")
    try:
        return _run(spark, folder, cloudy, reference, scl, catalog, config, detector, inpainter, log, sign)
    except Exception as e:
        log.say(f"failed: {type(e).__name__}")
        log.write(spark, folder.path("processing_log.txt"), config)
        raise


def _run(spark: SparkSession, folder: RunFolder, cloudy: str, reference: str | None, scl: str | None, catalog: DataFrame | None, config: Config, detector: plugins.Detector | None, inpainter: plugins.Inpainter | None, log: RunLog, sign: Callable[[str], str]) -> dict[str, Any]:
    goal, target, bands = _read(spark, cloudy)
    target = written(target)
    width, height = goal.width, goal.height
    picture = lambda name, df, columns, ramp=False: png.write_png(df, columns, folder.path(f"{name}.png"), width, height, ramp)
    picture("01_input", target, bands[:3])
    stack_of: list[DataFrame] = []
    if reference:
        meta, pixels, names = _read(spark, reference)
        layer = written(on_grid(pixels, meta, goal, names))
        picture("02_reference", layer, names[:3])
        # It comes first: layer 0, of its own weight.
        stack_of.append(layer.withColumn("clear", F.lit(True)).withColumn("scene", F.lit(0)).withColumn("weight", F.lit(config.uploaded_reference_weight)))
    pixels = target
    if scl:
        own, classes, _ = _read(spark, scl, ["scl"])
        pixels = written(target.join(on_grid(classes, own, goal, ["scl"]).withColumn("scl", F.col("scl").cast("int")), ["y", "x"]))
    if catalog is not None:
        when = dt.datetime.fromisoformat(config.target_date) if config.target_date else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        show = (lambda name, df: picture(f"04_registered_images/{re.sub('[^A-Za-z0-9._-]', '_', name)}", df, SCENE_BANDS[:3])) if config.debug_mode else None
        stack_of += scenes(spark, catalog, goal, target, bands, config, when, log, sign, show)
    log.metrics["temporal_stack_layers"] = len(stack_of)
    log.say(f"{len(stack_of)} layers in the stack")
    if config.debug_mode:
        png.write_contact_sheet(stack_of, bands[:3] if all(b in d.columns for d in stack_of for b in bands[:3]) else bands[:1], folder.path("10_temporal_stack_preview.png"), width, height)
    if stack_of:
        observations = stack_of[0]
        for more in stack_of[1:]:
            observations = observations.unionByName(more, allowMissingColumns=True)
    else:
        observations = target.limit(0).withColumn("scene", F.lit(0)).withColumn("clear", F.lit(True)).withColumn("weight", F.lit(0.0))
    keep = picture if config.debug_mode else None
    result = reconstruct(pixels, observations, bands, width, height, config, detector, inpainter, keep)
    log.metrics.update(result.metrics)
    out = tiff.write_tiff(result.pixels, bands, folder.path("15_final.tif"), width, height, goal.dtype, config.export_compression, goal.transform, goal.crs)
    shown = picture("14_final", result.pixels, bands[:3])
    log.say("results written")
    wrote = log.write(spark, folder.path("processing_log.txt"), config)
    return {"run_dir": folder.folder, "geotiff": out, "png": shown, "log": wrote, "cloud_percentage": result.metrics["cloud_percentage"], "temporal_layers": len(stack_of)}


def with_options(config: Config, **given: Any) -> Config:
    """config with the options that were given."""
    return dataclasses.replace(config, **{k: v for k, v in given.items() if v is not None})
