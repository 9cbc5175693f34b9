"""Operators over a stack of observations (y, x, scene, bands ..., clear, acq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights are summed as whole multiples of 1e-12, so sums don't depend on their order.
UNIT = 1e12


def temporal_weight(days: Column) -> Column:
    return 1.0 / (1.0 + F.abs(days))


def days_between(a: str, b: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {a}, {b})") / 8.64e10


def similarity(v: Column, m: Column, sigma: float = 0.08) -> Column:
    return F.exp(-(v - m) * (v - m) / (2 * sigma * sigma))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, order: list[str]) -> DataFrame:
    """keys, median (the first value whose running weight reaches half), and no_data where the total is at most 1e-9.

    weight holds whole numbers of UNIT. Where all weights are 0 the median is the least value, flagged. One shuffle by keys.
    """
    w = Window.partitionBy(*keys).orderBy(value, *order)
    run = df.withColumn("_run", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(weight).over(Window.partitionBy(*keys)))
    reached = F.when(F.col("_run") * 2 >= F.col("_all"), F.col(value))
    return run.groupBy(*keys).agg(F.min(reached).alias("median"), (F.max("_all") <= 1000).alias("no_data"))


def weighted_medians(df: DataFrame, keys: list[str], bands: dict[str, tuple[Column, Column]], order: str) -> DataFrame:
    """keys, and of each band (value, whole weight) its median_ and no_data_, as weighted_median(); null values don't count.

    One shuffle of the rows by keys for all bands: a key's layers, which a stack bounds, are sorted in arrays. no_data is
    null where a band has no value.
    """
    layers = [F.collect_list(F.when(v.isNotNull(), F.struct(v.alias("v"), F.col(order).alias("o"), u.alias("u")))).alias(f"layers_{b}") for b, (v, u) in bands.items()]
    rows = df.groupBy(*keys).agg(*layers)
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({f"layers_{b}": F.array_sort(f"layers_{b}") for b in bands}).withColumns({f"all_{b}": F.aggregate(f"layers_{b}", zero, lambda a, e: a + e["u"]) for b in bands})

    def median(b: str) -> Column:
        """The running weight goes down from the half that is to be reached; the first value at which it gets there stays."""
        first = F.struct((F.col(f"all_{b}")).alias("left"), F.get(f"layers_{b}", F.lit(0))["v"].alias("v"), F.lit(False).alias("done"))
        step = lambda a, e: F.struct((a["left"] - 2 * e["u"]).alias("left"), F.when(a["done"], a["v"]).otherwise(e["v"]).alias("v"), (a["done"] | (a["left"] - 2 * e["u"] <= 0)).alias("done"))
        return F.aggregate(f"layers_{b}", first, step, lambda a: a["v"])

    flag = lambda b: F.when(F.size(f"layers_{b}") > 0, F.col(f"all_{b}") <= 1000)
    return rows.select(*keys, *[median(b).alias(f"median_{b}") for b in bands], *[flag(b).alias(f"no_data_{b}") for b in bands])


def in_units(weight: Column) -> Column:
    return F.round(weight * UNIT).cast("long")


def best_layer(df: DataFrame, keys: list[str], weight: str, order: str) -> DataFrame:
    """The row of greatest weight of each key, the first by order on ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc(weight), order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
