"""A deterministic raster over the order tables: 50 pixels wide, a row of pixels for each 50 order keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 50
SCL = {"1-URGENT": 9, "2-HIGH": 8, "3-MEDIUM": 4, "4-NOT SPECIFIED": 3, "5-LOW": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, dn, acq, scl of each pixel of the target."""
    o = table(spark, sf_dir, "orders")
    scl = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in SCL.items()])
    return o.select(F.expr("o_orderkey div 50").alias("y"), F.expr("o_orderkey % 50").alias("x"), F.floor(F.col("o_totalprice") / 50.0).cast("long").alias("dn"), F.col("o_orderdate").alias("acq"), scl.alias("scl"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, scene, r, g, b, n, clear, acq; lines that repeat a key make one observation by max, min and bool_and."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        (F.max("l_quantity") * 200).cast("long").alias("r"),
        F.max(F.floor(F.col("l_extendedprice") * 10000 / 105000)).cast("long").alias("g"),
        F.max(F.round(F.col("l_discount") * 100000)).cast("long").alias("b"),
        F.max(F.round(F.col("l_tax") * 125000)).cast("long").alias("n"),
        F.bool_and(F.col("l_returnflag") != "R").alias("clear"),
        F.min("l_shipdate").alias("acq"),
    )
    return rows.select(F.expr("l_orderkey div 50").alias("y"), F.expr("l_orderkey % 50").alias("x"), F.col("l_linenumber").alias("scene"), "r", "g", "b", "n", "clear", "acq")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("datetime"), F.col("value").alias("cloud_cover"), (F.col("event_id") % 360 - 180).alias("lon"), (F.col("user_id") % 180 - 90).alias("lat"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("bands"), F.col("label").alias("scl"))


def height(pixels: DataFrame) -> int:
    """Rows of a raster, from its greatest y: one aggregate."""
    return int(pixels.agg(F.coalesce(F.max("y") + 1, F.lit(0))).first()[0])
