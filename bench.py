"""Runs the raster queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line; each after one warm-up query."""

import json
import os
import time

from pyspark.sql import SparkSession

from clearstack.plans.queries import QUERIES

HEADLINE = ["scene_search", "temporal_composite", "weighted_median", "best_layer_fill", "local_mean_std", "adaptive_mask", "shadow_mask", "halo", "expand_adaptive", "histogram_match", "pyr_down", "bilinear_regrid"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["coverage_metrics"](spark, sf_dir).collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
