"""python -m clearstack: removes the clouds of one raster with the help of others."""

from __future__ import annotations

import argparse

from clearstack.config import Config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("clearstack", description=__doc__.split(": ")[1])
    p.add_argument("--cloudy", help="GeoTIFF with clouds")
    p.add_argument("--environment", action="store_true", help="say what there is to work with, and end")
    p.add_argument("--reference", help="clear GeoTIFF")
    p.add_argument("--scl", help="GeoTIFF of scene classes")
    p.add_argument("--catalog", help="Parquet table of other scenes: id, datetime, cloud_cover, lon, lat, path, scl_path")
    p.add_argument("--lat", type=float, dest="latitude")
    p.add_argument("--lon", type=float, dest="longitude")
    p.add_argument("--bbox", type=float, nargs=4, metavar=("MIN_LON", "MIN_LAT", "MAX_LON", "MAX_LAT"))
    p.add_argument("--date", dest="target_date", help="day of the cloudy raster, YYYY-MM-DD; now if not given")
    d = Config()
    for name in ("max_historical_images", "search_window_days", "cloud_cover_threshold", "cloud_prob_threshold", "output_root"):
        value = getattr(d, name)
        p.add_argument("--" + name.replace("_", "-"), type=type(value), default=value, help=f"({value})")
    p.add_argument("--no-ai-inpainting", action="store_true")
    p.add_argument("--no-poisson-blending", action="store_true")
    p.add_argument("--quiet-debug", action="store_true", help="no pictures of single steps")
    return p


def configure(args: argparse.Namespace) -> Config:
    from clearstack.plans.run import with_options

    names = ("latitude", "longitude", "target_date", "max_historical_images", "search_window_days", "cloud_cover_threshold", "cloud_prob_threshold", "output_root")
    base = Config(use_ai_inpainting=not args.no_ai_inpainting, use_poisson_blending=not args.no_poisson_blending, debug_mode=not args.quiet_debug)
    return with_options(base, bbox=tuple(args.bbox) if args.bbox else None, **{n: getattr(args, n) for n in names})


def main() -> None:
    args = parser().parse_args()
    from pyspark.sql import SparkSession

    from clearstack.plans.run import run
    from clearstack.sources.runlog import environment

    spark = SparkSession.builder.appName("clearstack").getOrCreate()
    if args.environment:
        for name, value in environment(spark).items():
            print(f"{name}: {value}")
        return
    if not args.cloudy:
        parser().error("--cloudy is needed")
    catalog = spark.read.parquet(args.catalog) if args.catalog else None
    for name, value in run(spark, args.cloudy, args.reference, args.scl, catalog, configure(args)).items():
        print(f"{name}: {value}")


if __name__ == "__main__":
    main()
