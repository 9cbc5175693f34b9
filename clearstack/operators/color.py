"""Histogram matching and brightness correction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearstack.operators.neighborhood import box_sums, local_stats


def _shares(df: DataFrame, value: str) -> DataFrame:
    """value and how many rows have at most it: partial counts first, so the window sees distinct values only."""
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    w = Window.orderBy("v")
    return counts.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def histogram_match(source: DataFrame, template: DataFrame, value: str = "dn") -> DataFrame:
    """v and matched for each distinct source value: the template value at the same share, interpolated and flat beyond the ends.

    Distinct values are bounded by the sample type (65,536), so the windows over them are too.
    """
    s, t = _shares(source, value), _shares(template, value)
    total_s, total_t = source.agg(F.count("*").alias("all_s")), template.agg(F.count("*").alias("all_t"))
    s = s.crossJoin(F.broadcast(total_s)).select("v", (F.col("upto") / F.col("all_s")).alias("share"), F.lit(None).cast("long").alias("tv"))
    t = t.crossJoin(F.broadcast(total_t)).select(F.lit(None).cast("long").alias("v"), (F.col("upto") / F.col("all_t")).alias("share"), F.col("v").alias("tv"))
    w = Window.orderBy("share", F.col("v").isNotNull())
    back = Window.orderBy(F.desc("share"), F.col("v").isNotNull().desc())  # a frame to the end would be read anew for each row
    point = F.when(F.col("tv").isNotNull(), F.struct("share", "tv"))
    both = s.union(t).withColumn("a", F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.last(point, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    line = F.col("a.tv") + (F.col("share") - F.col("a.share")) * (F.col("b.tv") - F.col("a.tv")) / (F.col("b.share") - F.col("a.share"))
    matched = F.when(F.col("a").isNull(), F.col("b.tv").cast("double")).when(F.col("b").isNull() | (F.col("share") == F.col("a.share")), F.col("a.tv").cast("double")).otherwise(line)
    return both.where(F.col("v").isNotNull()).select("v", F.round(matched, 6).alias("matched"))


def brightness_corrected(df: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """y, x, v of pixels (y, x, result, cloudy, m): inside the mask the local mean of clear cloudy pixels less that of masked result is added.

    Windows without weight have mean 0.
    """
    m = F.col("m").cast("long")
    sums = box_sums(df.select("y", "x", (1 - m).alias("cw"), (F.col("cloudy") * (1 - m)).alias("cv"), m.alias("mw"), (F.col("result") * m).alias("mv")), ["cw", "cv", "mw", "mv"], size, width, height)
    area = float(size * size)
    mean = lambda v, w: (F.col(v) / area) / F.greatest(F.col(w) / area, F.lit(1e-6))
    out = df.select("y", "x", "result", "m").join(sums, ["y", "x"])
    return out.select("y", "x", F.round(F.when(F.col("m"), F.col("result") + mean("cv", "cw") - mean("mv", "mw")).otherwise(F.col("result").cast("double")), 6).alias("v"))


def color_transferred(df: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """y, x, v of pixels (y, x, source, target, clear): source with the local mean and deviation of target's clear pixels."""
    own = local_stats(df.withColumn("w", F.lit(1)), "source", "w", size, width, height).toDF("y", "x", "ms", "ss")
    goal = local_stats(df.withColumn("w", F.col("clear").cast("long")), "target", "w", size, width, height).toDF("y", "x", "mt", "st")
    v = (F.col("source") - F.col("ms")) * (F.col("st") / F.greatest("ss", F.lit(1e-6))) + F.col("mt")
    return df.select("y", "x", "source").join(own, ["y", "x"]).join(goal, ["y", "x"]).select("y", "x", v.alias("v"))


def normalized_layers(layers: dict[int, DataFrame], target: DataFrame, bands: list[str], size: int, width: int, height: int) -> dict[int, DataFrame]:
    """Each layer (y, x, bands, ...) with its bands' local colours transferred from the clear pixels of target (y, x, bands, clear).

    A stack bounds the number of layers. Other columns stay; a layer's missing pixels stay missing.
    """
    out = {}
    for k, layer in layers.items():
        keep = layer.select("y", "x", *[c for c in layer.columns if c not in ("y", "x", *bands)])
        for b in bands:
            pair = layer.select("y", "x", F.col(b).alias("source")).join(target.select("y", "x", F.col(b).alias("target"), "clear"), ["y", "x"])
            keep = keep.join(color_transferred(pair, size, width, height).withColumnRenamed("v", b), ["y", "x"])
        out[k] = keep.select(layer.columns)
    return out


def blob_histogram_match(df: DataFrame, labelled: DataFrame, width: int, height: int, margin: int = 40, least: int = 20, tile: int = 64) -> DataFrame:
    """y, x, v of pixels (y, x, result, cloudy, m): each component's result pixels matched within its box and a margin.

    The distribution of result over the whole crop goes to that of cloudy over the same crop; components whose crop has
    fewer than `least` pixels outside the mask stay as they are. Every component reads the unmatched result, so the order
    of components doesn't matter. Pixels meet crops by tiles, and only counts of distinct values are shuffled on.
    """
    clamp = lambda c, n: F.least(F.greatest(c, F.lit(0).cast("long")), F.lit(n - 1).cast("long"))
    boxes = labelled.groupBy("blob").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    boxes = boxes.select("blob", clamp(F.col("y0") - margin, height).alias("y0"), clamp(F.col("y1") + margin, height).alias("y1"), clamp(F.col("x0") - margin, width).alias("x0"), clamp(F.col("x1") + margin, width).alias("x1"))
    tiles = boxes.withColumn("ty", F.explode(F.sequence(F.expr(f"y0 div {tile}"), F.expr(f"y1 div {tile}")))).withColumn("tx", F.explode(F.sequence(F.expr(f"x0 div {tile}"), F.expr(f"x1 div {tile}"))))
    at = df.select("y", "x", "result", "cloudy", "m", F.expr(f"y div {tile}").alias("ty"), F.expr(f"x div {tile}").alias("tx"))
    crops = at.join(tiles, ["ty", "tx"]).where(F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1")))
    both = F.array(F.struct(F.lit(True).alias("own"), F.col("result").cast("double").alias("v")), F.struct(F.lit(False).alias("own"), F.col("cloudy").cast("double").alias("v")))
    counts = crops.select("blob", "m", F.explode(both).alias("e")).groupBy("blob", "e.own", "e.v").agg(F.count("*").alias("n"), F.count_if(~F.col("m")).alias("outside"))
    # Both sides of a crop have the same number of pixels, so running counts stand for shares.
    run = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("blob", "own").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("clear", F.sum(F.when(~F.col("own"), F.col("outside")).otherwise(0)).over(Window.partitionBy("blob"))).where(F.col("clear") >= least)
    point = F.when(~F.col("own"), F.struct("upto", "v"))
    w = Window.partitionBy("blob").orderBy("upto", "own").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("blob").orderBy(F.desc("upto"), F.desc("own")).rowsBetween(Window.unboundedPreceding, -1)
    run = run.withColumn("a", F.last(point, ignorenulls=True).over(w)).withColumn("b", F.last(point, ignorenulls=True).over(back))
    line = F.col("a.v") + (F.col("upto") - F.col("a.upto")) * (F.col("b.v") - F.col("a.v")) / (F.col("b.upto") - F.col("a.upto"))
    matched = F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull() | (F.col("upto") == F.col("a.upto")), F.col("a.v")).otherwise(line)
    table = run.where("own").select("blob", F.col("v").alias("own_v"), matched.alias("matched"))
    rows = df.select("y", "x", F.col("result").cast("double").alias("own_v")).join(labelled.select("y", "x", "blob"), ["y", "x"], "left").join(table, ["blob", "own_v"], "left")
    return rows.select("y", "x", F.coalesce("matched", "own_v").alias("v"))
