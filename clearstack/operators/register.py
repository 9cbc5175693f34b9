"""Regridding to places in a source raster, and descriptor matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearstack.session import ship


def nearest(grid: DataFrame, source: DataFrame, sy: Column, sx: Column, *values: str) -> DataFrame:
    """y, x and values of the source pixel nearest to (sy, sx); 0 outside the source, as for a footprint's outside."""
    at = grid.select("y", "x", F.floor(sy + 0.5).cast("long").alias("gy"), F.floor(sx + 0.5).cast("long").alias("gx"))
    s = source.select(F.col("y").alias("gy"), F.col("x").alias("gx"), *values)
    return at.join(s, ["gy", "gx"], "left").select("y", "x", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def bilinear(grid: DataFrame, source: DataFrame, sy: Column, sx: Column, *values: str) -> DataFrame:
    """y, x and values interpolated from the source pixels about (sy, sx); those outside the source weigh nothing."""
    at = grid.select("y", "x", sy.alias("sy"), sx.alias("sx")).withColumn("fy", F.floor("sy").cast("long")).withColumn("fx", F.floor("sx").cast("long"))
    corners = F.array(*[F.struct((F.col("fy") + dy).alias("gy"), (F.col("fx") + dx).alias("gx"), ((1 - F.abs(F.col("sy") - F.col("fy") - dy)) * (1 - F.abs(F.col("sx") - F.col("fx") - dx))).alias("k")) for dy in (0, 1) for dx in (0, 1)])
    near = at.select("y", "x", F.explode(corners).alias("c")).select("y", "x", "c.*").where("k > 0")
    s = source.select(F.col("y").alias("gy"), F.col("x").alias("gx"), F.array(*[F.col(v).cast("double") for v in values]).alias("vs"))
    share = lambda i, v: F.round(F.sum(F.col("vs")[i] * F.col("k")) / F.sum("k"), 6).alias(v)
    return near.join(s, ["gy", "gx"]).groupBy("y", "x").agg(*[share(i, v) for i, v in enumerate(values)])


def sign_bits(bands: Column) -> Column:
    """A 64-bit descriptor: bit i tells whether band i is positive."""
    bits = F.transform(bands, lambda b, i: F.when(b > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def hamming_matches(queries: DataFrame, train: DataFrame, ratio: float = 0.75) -> DataFrame:
    """id, match and distance of queries (id, bits) whose nearest in train is nearer than ratio times the second; ties to the smaller id.

    Every query meets every train descriptor, as in brute-force matching; train is a scene's keypoints, at most
    2,000 by contract, and is broadcast.
    """
    t = train.select(F.col("id").alias("match"), F.col("bits").alias("other")).limit(2001)
    if t.count() > 2000:
        raise ValueError("more than 2,000 descriptors to match with")
    pairs = queries.crossJoin(F.broadcast(t)).select("id", "match", F.bit_count(F.col("bits").bitwiseXOR(F.col("other"))).alias("distance"))
    two = pairs.groupBy("id").agg(F.min(F.struct("distance", "match")).alias("a"), F.count("*").alias("n"))
    second = pairs.join(two.select("id", F.col("a.match").alias("best")), "id").where("match <> best").groupBy("id").agg(F.min("distance").alias("second"))
    return two.join(second, "id").where(F.col("a.distance") < ratio * F.col("second")).select("id", "a.match", F.col("a.distance").cast("int").alias("distance"))


def hamming_matches_among(rows: DataFrame, ratio: float = 0.75, block: int = 2000) -> DataFrame:
    """id, match and distance as in hamming_matches, each of rows (id, bits) with unique ids matched with all others.

    Every pair is compared: rows are dealt into blocks of about `block`, a task takes a pair of blocks and keeps the two
    nearest of each row, so rows grow with the rows times the blocks.
    """
    ship(rows.sparkSession)
    blocks = max(1, -(-rows.count() // block))
    dealt = rows.select("id", "bits", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("own"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    ones, others = dealt.select("id", "bits", F.col("own").alias("q"), every.alias("t")), dealt.select("id", "bits", F.col("own").alias("t"), every.alias("q"))

    def nearest(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        other = other.sort_values("id")
        ids, match = one["id"].to_numpy(), other["id"].to_numpy()
        # Unsigned: of a negative number bitwise_count counts the absolute value.
        own_bits, bits = (d["bits"].to_numpy().astype(np.uint64) for d in (one, other))
        out = []
        for i in range(0, len(ids) if len(match) else 0, 256):
            own = ids[i : i + 256]
            away = np.bitwise_count(own_bits[i : i + 256, None] ^ bits).astype(np.int64)
            away[own[:, None] == match] = 65  # itself
            # The order of ids within equal distances.
            rank = away * len(match) + np.arange(len(match))
            for _ in range(min(2, len(match))):
                k, row = rank.argmin(axis=1), np.arange(len(own))
                out.append(pd.DataFrame({"id": own, "match": match[k], "distance": away[row, k]}))
                rank[row, k] = np.iinfo(np.int64).max
        found = pd.concat(out) if out else pd.DataFrame({"id": ids[:0], "match": ids[:0], "distance": ids[:0]})
        return found[found["distance"] < 65]

    near = ones.groupBy("q", "t").cogroup(others.groupBy("q", "t")).applyInPandas(nearest, "id long, match long, distance long")
    two = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "match"))), 1, 2).alias("n")).where(F.size("n") == 2)
    first = F.col("n")[0]
    return two.where(first["distance"] < ratio * F.col("n")[1]["distance"]).select("id", first["match"].alias("match"), first["distance"].cast("int").alias("distance"))
