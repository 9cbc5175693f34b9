"""The registered queries of the raster operators over the driver tables, and the SQL that each must agree with."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from clearstack.config import Config
from clearstack.operators import blending, color, components, features, morphology, neighborhood, plugins, pointwise, poisson, register, stack
from clearstack.plans import reconstruct
from clearstack.plans import run as run_plan
from clearstack.session import shared_path, written
from clearstack.sources import search, tiff, virtual
from clearstack.sources.virtual import WIDTH

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_T = """t AS (SELECT o_orderkey // 50 AS y, o_orderkey % 50 AS x, CAST(floor(o_totalprice / 50.0) AS BIGINT) AS dn, o_orderdate AS acq,
 CASE o_orderpriority WHEN '1-URGENT' THEN 9 WHEN '2-HIGH' THEN 8 WHEN '3-MEDIUM' THEN 4 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 5 END AS scl FROM orders),
h AS (SELECT max(y) + 1 AS n FROM t)"""
_O = """o AS (SELECT l_orderkey // 50 AS y, l_orderkey % 50 AS x, l_linenumber AS scene, CAST(max(l_quantity) * 200 AS BIGINT) AS r,
 CAST(max(floor(l_extendedprice * 10000 / 105000)) AS BIGINT) AS g, CAST(max(round(l_discount * 100000)) AS BIGINT) AS b, CAST(max(round(l_tax * 125000)) AS BIGINT) AS n,
 bool_and(l_returnflag <> 'R') AS clear, min(l_shipdate) AS acq FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def _box(name: str, source: str, columns: list[str], size: int) -> str:
    """A CTE with box sums of columns by joining every pixel with its window, mirrored at the edges."""
    lo, hi = size // 2, (size - 1) // 2
    sums = ", ".join(f"CAST(sum(q.{c}) AS BIGINT) AS {c}" for c in columns)
    return f"""{name} AS (SELECT p.y, p.x, {sums} FROM (SELECT y, x, n FROM {source}, h) p, range(-{lo}, {hi} + 1) a(dy), range(-{lo}, {hi} + 1) b(dx), {source} q
 WHERE q.y = CASE WHEN p.y + dy < 0 THEN -1 - p.y - dy WHEN p.y + dy >= n THEN 2 * n - 1 - p.y - dy ELSE p.y + dy END
 AND q.x = CASE WHEN p.x + dx < 0 THEN -1 - p.x - dx WHEN p.x + dx >= 50 THEN 99 - p.x - dx ELSE p.x + dx END GROUP BY p.y, p.x)"""


_BLOB = _box("s9", "t", ["dn"], 9) + ", blob AS (SELECT y, x, dn >= 81 * 5300 AS m FROM s9)"


def _foot(name: str, source: str, size: int, erode: bool = False) -> str:
    widths = morphology.half_widths(size)
    rows = ", ".join(f"({d - size // 2}, {w})" for d, w in enumerate(widths))
    agg = "bool_and" if erode else "bool_or"
    return f"""{name} AS (SELECT p.y, p.x, {agg}(q.m) AS m FROM {source} p, (VALUES {rows}) f(dy, w), {source} q
 WHERE q.y = p.y + dy AND q.x BETWEEN p.x - w AND p.x + w GROUP BY p.y, p.x)"""


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pixels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    t = virtual.target(spark, sf_dir)
    return t, virtual.height(t)


def _blob(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    t, n = _pixels(spark, sf_dir)
    sums = neighborhood.box_sums(t, ["dn"], 9, WIDTH, n)
    return sums.select("y", "x", (F.col("dn") >= 81 * 5300).alias("m")), n


@query("SELECT id, cloud_cover, abs(date_diff('microsecond', datetime, TIMESTAMP '2024-01-15')) AS distance_us FROM (SELECT event_id AS id, ts AS datetime, value AS cloud_cover, event_id % 360 - 180 AS lon, user_id % 180 - 90 AS lat FROM events) WHERE datetime BETWEEN TIMESTAMP '2023-01-15' AND TIMESTAMP '2025-01-14' AND cloud_cover < 20 AND lon BETWEEN -10 AND 30 AND lat BETWEEN 20 AND 60 ORDER BY distance_us, coalesce(cloud_cover, 100), id LIMIT 15")
def scene_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(virtual.catalog(spark, sf_dir), dt.datetime(2024, 1, 15), search.resolve_bbox(None, 40.0, 10.0, 20.0))


@query("SELECT event_id AS id, event_id % 360 - 180 AS lon, user_id % 180 - 90 AS lat FROM events WHERE event_id % 360 - 180 BETWEEN 8 AND 12 AND user_id % 180 - 90 BETWEEN 38 AND 42")
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = search.resolve_bbox(None, 40.0, 10.0, 2.0)
    return virtual.catalog(spark, sf_dir).where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])).select("id", "lon", "lat")


@query(f"WITH {_T} SELECT y, x, round(CAST(least(greatest(dn / 10000.0, 0), 1) AS DOUBLE), 6) AS v FROM t")
def normalize_dn(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = virtual.target(spark, sf_dir)
    return t.select("y", "x", F.round(pointwise.normalize(F.col("dn")).cast("double"), 6).alias("v"))


@query(f"WITH {_T} SELECT y, x, CAST(trunc(CAST(CAST(dn / 10000.0 AS FLOAT) * CAST(10000 AS FLOAT) AS FLOAT)) AS INTEGER) AS dn FROM t")
def denormalize_dn(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = virtual.target(spark, sf_dir)
    return t.select("y", "x", pointwise.denormalize(pointwise.normalize(F.col("dn"))).alias("dn"))


@query("SELECT vec_id AS id, label IN (8, 9, 10, 11) AS cloud FROM embeddings")
def scl_cloud_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.spectra(spark, sf_dir).select("id", pointwise.is_cloud(F.col("scl")).alias("cloud"))


@query("SELECT vec_id AS id, label NOT IN (3, 8, 9, 10, 11) AS clear FROM embeddings")
def scl_clear_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.spectra(spark, sf_dir).select("id", pointwise.is_clear(F.col("scl")).alias("clear"))


_LS = "ls AS (SELECT vec_id AS id, list_avg(CAST(embedding AS DOUBLE[])) AS lum, list_stddev_pop(CAST(embedding AS DOUBLE[])) AS spread FROM embeddings)"


@query(f"WITH {_LS} SELECT id, round(lum, 6) AS lum, round(spread, 6) AS spread FROM ls")
def band_luminance_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = virtual.spectra(spark, sf_dir)
    return s.select("id", F.round(pointwise.luminance(F.col("bands")), 6).alias("lum"), F.round(pointwise.spread(F.col("bands")), 6).alias("spread"))


@query(f"WITH {_LS} SELECT id, lum >= (SELECT quantile_cont(lum, 0.99) FROM ls) AND spread <= (SELECT quantile_cont(spread, 0.01) FROM ls) AS bright_flat FROM ls")
def bright_flat_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointwise.bright_flat(virtual.spectra(spark, sf_dir)).select("id", "bright_flat")


@query(f"WITH {_T} SELECT y, x, dn <= (SELECT quantile_cont(dn, 0.2) FROM t) AS dark FROM t")
def dark_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointwise.dark_objects(virtual.target(spark, sf_dir)).select("y", "x", "dark")


@query(f"WITH {_T} SELECT y, x, dn >= 2200 AS core, dn >= 1000 AND dn < 2200 AS thin, dn >= 1000 AS s2 FROM t")
def threshold_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = pointwise.threshold_masks(F.col("dn"), 2200, 1000)
    return virtual.target(spark, sf_dir).select("y", "x", *[c.alias(k) for k, c in masks.items()])


@query(f"WITH {_T} SELECT y, x, CAST(trunc(least(greatest(dn / (SELECT coalesce(nullif(quantile_cont(dn, 0.99), 0), 1) FROM t), 0), 1) * 255) AS INTEGER) AS u8 FROM t")
def percentile_stretch_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointwise.stretch_u8(virtual.target(spark, sf_dir)).select("y", "x", "u8")


@query(f"WITH {_T} SELECT y, x, CASE WHEN scl IN (8, 9) THEN dn ELSE 0 END AS dn FROM t")
def extract_by_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.target(spark, sf_dir).select("y", "x", F.when(pointwise.is_cloud(F.col("scl")), F.col("dn")).otherwise(0).cast("long").alias("dn"))


def _two_masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = virtual.target(spark, sf_dir)
    return t.where(pointwise.is_cloud(F.col("scl"))).select("y", "x"), t.where("dn >= 5000").select("y", "x")


@query(f"WITH {_T} SELECT y, x FROM t WHERE scl IN (8, 9) UNION SELECT y, x FROM t WHERE dn >= 5000")
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_masks(spark, sf_dir)
    return a.union(b).distinct()


@query(f"WITH {_T} SELECT y, x FROM t WHERE scl IN (8, 9) INTERSECT SELECT y, x FROM t WHERE dn >= 5000")
def mask_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_masks(spark, sf_dir)
    return a.join(b, ["y", "x"], "left_semi")


@query(f"WITH {_T} SELECT y, x FROM t WHERE scl IN (8, 9) EXCEPT SELECT y, x FROM t WHERE dn >= 5000")
def mask_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_masks(spark, sf_dir)
    return a.join(b, ["y", "x"], "left_anti")


@query(f"WITH {_T} SELECT 100.0 * sum(CASE WHEN scl IN (8, 9) THEN 1 ELSE 0 END) / count(*) AS cloud_percentage, CAST(sum(CASE WHEN scl IN (8, 9) THEN 1 ELSE 0 END) AS BIGINT) AS cloud_pixels, CAST(trunc(avg(CASE WHEN scl IN (8, 9) THEN x END)) AS INTEGER) AS cx, CAST(trunc(avg(CASE WHEN scl IN (8, 9) THEN y END)) AS INTEGER) AS cy FROM t")
def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = pointwise.is_cloud(F.col("scl"))
    return virtual.target(spark, sf_dir).agg((100.0 * F.count_if(cloud) / F.count("*")).alias("cloud_percentage"), F.count_if(cloud).alias("cloud_pixels"), F.avg(F.when(cloud, F.col("x"))).cast("int").alias("cx"), F.avg(F.when(cloud, F.col("y"))).cast("int").alias("cy"))


@query(f"WITH {_O} SELECT y, x, scene, r, g, b, n, clear FROM o")
def mosaic_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.observations(spark, sf_dir).select("y", "x", "scene", "r", "g", "b", "n", "clear")


_W = "w AS (SELECT o.*, t.dn, t.scl, 1.0 / (1.0 + abs(date_diff('microsecond', t.acq, o.acq) / 8.64e10)) AS weight FROM o JOIN t USING (y, x))"


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of cloudy pixels only: the mask comes first, so others are never shuffled into the stack."""
    t = virtual.target(spark, sf_dir).withColumnRenamed("acq", "wanted")
    joined = virtual.observations(spark, sf_dir).join(t, ["y", "x"])
    return joined.withColumn("weight", stack.temporal_weight(stack.days_between("wanted", "acq")))


@query(f"WITH {_T}, {_O}, {_W} SELECT y, x, scene, round(weight, 9) AS weight FROM w")
def temporal_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir).select("y", "x", "scene", F.round("weight", 9).alias("weight"))


_MEDIAN = """run AS (SELECT *, sum(u) OVER (PARTITION BY y, x ORDER BY v, scene ROWS UNBOUNDED PRECEDING) AS run, sum(u) OVER (PARTITION BY y, x) AS total FROM u),
med AS (SELECT y, x, min(CASE WHEN run * 2 >= total THEN v END) AS median, max(total) <= 1000 AS no_data FROM run GROUP BY y, x)"""


@query(f"WITH {_T}, {_O}, {_W}, u AS (SELECT y, x, scene, g AS v, CAST(round(CASE WHEN clear THEN weight ELSE 0 END * 1e12) AS BIGINT) AS u FROM w), {_MEDIAN} SELECT y, x, median, no_data FROM med")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _weighted(spark, sf_dir).select("y", "x", "scene", F.col("g").alias("v"), stack.in_units(F.when(F.col("clear"), F.col("weight")).otherwise(0.0)).alias("u"))
    return stack.weighted_median(rows, ["y", "x"], "v", "u", ["scene"])


_LOCAL = "c AS (SELECT y, x, CASE WHEN scl IN (3, 8, 9) THEN 0 ELSE 1 END AS sw, CASE WHEN scl IN (3, 8, 9) THEN 0 ELSE dn END AS sv, CASE WHEN scl IN (3, 8, 9) THEN 0 ELSE dn * dn END AS sq FROM t), " + _box("bx", "c", ["sw", "sv", "sq"], 41) + ", loc AS (SELECT y, x, (sv / 1681.0) / greatest(sw / 1681.0, 1e-6) AS mean, (sq / 1681.0) / greatest(sw / 1681.0, 1e-6) AS sq FROM bx)"


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = _pixels(spark, sf_dir)
    clear = t.select("y", "x", "dn", pointwise.is_clear(F.col("scl")).cast("long").alias("w"))
    return neighborhood.local_stats(clear, "dn", "w", 41, WIDTH, n)


@query(f"WITH {_T}, {_LOCAL} SELECT y, x, round(mean, 6) AS mean, round(sqrt(greatest(sq - mean * mean, 1e-6)), 4) AS std FROM loc")
def local_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _local(spark, sf_dir).select("y", "x", F.round("mean", 6).alias("mean"), F.round("std", 4).alias("std"))


_FILL = f"""WITH {_T}, {_O}, {_W}, {_LOCAL},
 e AS (SELECT w.y, w.x, scene, unnest(['r', 'g', 'b', 'n']) AS band, unnest([r, g, b, n]) AS v, weight, clear FROM w WHERE scl IN (8, 9)),
 u0 AS (SELECT e.*, CAST(round(CASE WHEN clear THEN weight * exp(-(v / 10000.0 - mean / 10000.0) * (v / 10000.0 - mean / 10000.0) / (2 * 0.08 * 0.08)) ELSE 0 END * 1e12) AS BIGINT) AS u FROM e JOIN loc USING (y, x)),
 run AS (SELECT *, sum(u) OVER (PARTITION BY y, x, band ORDER BY v, scene ROWS UNBOUNDED PRECEDING) AS run, sum(u) OVER (PARTITION BY y, x, band) AS total FROM u0),
 med AS (SELECT y, x, band, min(CASE WHEN run * 2 >= total THEN v END) AS median, max(total) <= 1000 AS no_data FROM run GROUP BY y, x, band),
 f AS (SELECT t.y, t.x, max(t.dn) AS dn, max(CASE WHEN NOT no_data AND band = 'r' THEN median END) AS r, max(CASE WHEN NOT no_data AND band = 'g' THEN median END) AS g,
  max(CASE WHEN NOT no_data AND band = 'b' THEN median END) AS b, max(CASE WHEN NOT no_data AND band = 'n' THEN median END) AS n, coalesce(bool_and(no_data), true) AS none, bool_or(t.scl IN (8, 9)) AS m FROM t LEFT JOIN med USING (y, x) GROUP BY t.y, t.x)
"""


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, r, g, b, n of every pixel: the weighted median under the mask where there is one, else the target's own; unresolved."""
    t = virtual.target(spark, sf_dir)
    cloudy = t.where(pointwise.is_cloud(F.col("scl"))).select("y", "x", F.col("acq").alias("wanted"))
    obs = virtual.observations(spark, sf_dir).join(cloudy, ["y", "x"]).join(_local(spark, sf_dir).select("y", "x", "mean"), ["y", "x"])
    rows = obs.withColumn("weight", stack.temporal_weight(stack.days_between("wanted", "acq")))
    units = lambda b: stack.in_units(F.when(F.col("clear"), F.col("weight") * stack.similarity(F.col(b) / 10000.0, F.col("mean") / 10000.0)).otherwise(0.0))
    medians = stack.weighted_medians(rows, ["y", "x"], {b: (F.col(b), units(b)) for b in "rgbn"}, "scene")
    nothing = F.col("no_data_r") & F.col("no_data_g") & F.col("no_data_b") & F.col("no_data_n")
    found = medians.select("y", "x", *[F.when(~F.col(f"no_data_{b}"), F.col(f"median_{b}")).alias(b) for b in "rgbn"], nothing.alias("none"))
    out = t.join(found, ["y", "x"], "left")
    m = pointwise.is_cloud(F.col("scl"))
    return out.select("y", "x", *[F.coalesce(b, "dn").alias(b) for b in "rgbn"], (m & F.coalesce("none", F.lit(True))).alias("unresolved"))


@query(_FILL + "SELECT y, x, coalesce(r, dn) AS r, coalesce(g, dn) AS g, coalesce(b, dn) AS b, coalesce(n, dn) AS n, m AND none AS unresolved FROM f")
def temporal_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir)


@query(_FILL + "SELECT count(*) AS unresolved FROM f WHERE m AND none")
def unresolved_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).agg(F.count_if("unresolved").alias("unresolved"))


@query(f"WITH {_T}, {_O}, {_W} SELECT y, x, scene, n AS v FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY CAST(round(weight * 1e12) AS BIGINT) DESC, scene) AS k FROM w WHERE scl IN (8, 9)) WHERE k = 1")
def best_layer_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _weighted(spark, sf_dir).where(pointwise.is_cloud(F.col("scl"))).withColumn("u", stack.in_units(F.col("weight")))
    return stack.best_layer(rows, ["y", "x"], "u", "scene").select("y", "x", "scene", F.col("n").alias("v"))


@query(f"WITH {_T}, {_box('bx', 't', ['dn'], 41)} SELECT y, x, dn AS box_sum, round(dn / 1681.0, 6) AS box_mean FROM bx")
def box_mean_41(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = _pixels(spark, sf_dir)
    return neighborhood.box_sums(t, ["dn"], 41, WIDTH, n).select("y", "x", F.col("dn").alias("box_sum"), F.round(F.col("dn") / 1681.0, 6).alias("box_mean"))


@query(f"WITH {_T}, {_box('bx', 't', ['dn'], 41)} SELECT y, x, t.dn * 1681 >= bx.dn + 600 * 1681 AND t.dn < 2200 AS adaptive FROM t JOIN bx USING (y, x)")
def adaptive_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = _pixels(spark, sf_dir)
    sums = neighborhood.box_sums(t, ["dn"], 41, WIDTH, n).withColumnRenamed("dn", "box")
    return t.join(sums, ["y", "x"]).select("y", "x", ((F.col("dn") * 1681 >= F.col("box") + 600 * 1681) & (F.col("dn") < 2200)).alias("adaptive"))


@query(f"WITH {_T}, {_BLOB}, {_foot('d', 'blob', 7)} SELECT y, x, m FROM d")
def dilate_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.dilate(_blob(spark, sf_dir)[0], 7)


@query(f"WITH {_T}, {_BLOB}, {_foot('d', 'blob', 7, True)} SELECT y, x, m FROM d")
def erode_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.erode(_blob(spark, sf_dir)[0], 7)


@query(f"WITH {_T}, {_BLOB}, {_foot('a', 'blob', 5, True)}, {_foot('d', 'a', 5)} SELECT y, x, m FROM d")
def mask_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.opened(_blob(spark, sf_dir)[0])


@query(f"WITH {_T}, {_BLOB}, {_foot('a', 'blob', 5)}, {_foot('d', 'a', 5, True)} SELECT y, x, m FROM d")
def mask_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.closed(_blob(spark, sf_dir)[0])


@query(f"WITH {_T}, {_BLOB}, {_foot('a', 'blob', 7)}, {_foot('d', 'blob', 7, True)} SELECT y, x, a.m AND NOT d.m AS m FROM a JOIN d USING (y, x)")
def border_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.border_ring(_blob(spark, sf_dir)[0])


@query(f"WITH {_T}, {_BLOB}, {_foot('a', 'blob', 21)}, {_box('bx', 't', ['dn'], 40)} SELECT y, x, a.m AND NOT blob.m AND t.dn * 1600 > bx.dn + 500 * 1600 AS m FROM a JOIN blob USING (y, x) JOIN t USING (y, x) JOIN bx USING (y, x)")
def halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask, n = _blob(spark, sf_dir)
    t = virtual.target(spark, sf_dir).select("y", "x", "dn")
    return morphology.halo(mask.join(t, ["y", "x"]), 10, 0.05, WIDTH, n)


@query(f"WITH {_T} SELECT t.y + 15 AS y, x - 15 AS x FROM t, h WHERE scl IN (8, 9) AND t.y + 15 < n AND x >= 15")
def shift_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = _pixels(spark, sf_dir)
    return morphology.shifted(t.where(pointwise.is_cloud(F.col("scl"))), 15, -15, WIDTH, n)


@query(f"""WITH {_T}, {_BLOB}, near AS (SELECT DISTINCT p.y, p.x FROM blob q, range(-20, 21) a(dy), range(-20, 21) b(dx), t p WHERE q.m AND p.y = q.y + dy AND p.x = q.x + dx AND dy * dy + dx * dx <= 400),
 core AS (SELECT t.y, t.x, t.scl = 3 OR (t.dn <= (SELECT quantile_cont(dn, 0.2) FROM t) AND NOT blob.m AND s.m IS NOT NULL AND s.m AND near.y IS NOT NULL) AS m
  FROM t JOIN blob USING (y, x) LEFT JOIN blob s ON s.y = t.y - 12 AND s.x = t.x + 9 LEFT JOIN near ON near.y = t.y AND near.x = t.x), {_foot('d', 'core', 7)}
 SELECT y, x, d.m AND NOT blob.m AS m FROM d JOIN blob USING (y, x)""")
def shadow_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class 3, or dark, in the mask shifted by (12, -9), outside it and within 20 pixels of it; dilated by 3, less the mask."""
    mask, n = _blob(spark, sf_dir)
    mask = written(mask)
    t = virtual.target(spark, sf_dir)
    cloud = mask.where("m").select("y", "x")
    moved = morphology.shifted(cloud, 12, -9, WIDTH, n).withColumn("moved", F.lit(True))
    near = neighborhood.distance_squared(cloud, t, 20)
    rows = pointwise.dark_objects(t).join(mask, ["y", "x"]).join(moved, ["y", "x"], "left").join(near, ["y", "x"])
    core = rows.select("y", "x", ((F.col("scl") == 3) | (F.col("dark") & ~F.col("m") & F.col("moved").isNotNull() & F.col("d2").isNotNull())).alias("m"))
    grown = morphology.dilate(core, 7).withColumnRenamed("m", "grown")
    return grown.join(mask, ["y", "x"]).select("y", "x", (F.col("grown") & ~F.col("m")).alias("m"))


@query(f"WITH {_T}, {_BLOB}, d AS (SELECT p.y, p.x, min(dy * dy + dx * dx) AS d2 FROM blob q, range(-15, 16) a(dy), range(-15, 16) b(dx), t p WHERE q.m AND p.y = q.y + dy AND p.x = q.x + dx AND dy * dy + dx * dx <= 225 GROUP BY p.y, p.x) SELECT t.y, t.x, d2 FROM t LEFT JOIN d USING (y, x)")
def distance_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighborhood.distance_squared(_blob(spark, sf_dir)[0].where("m"), virtual.target(spark, sf_dir), 15)


def _labels_sql(name: str, source: str) -> str:
    return f"""{name}_r AS (SELECT y, x, y * 50 + x AS l FROM {source} UNION SELECT p.y, p.x, r.l FROM {name}_r r JOIN {source} p ON (abs(p.y - r.y) + abs(p.x - r.x)) = 1 AND p.y BETWEEN r.y - 1 AND r.y + 1 AND r.l < p.y * 50 + p.x),
 {name} AS (SELECT y, x, min(l) AS blob FROM {name}_r GROUP BY y, x)"""


_COMP = f"WITH RECURSIVE {_T}, {_BLOB}, src AS (SELECT y, x FROM blob WHERE m), {_labels_sql('lab', 'src')}, ar AS (SELECT blob, count(*) AS area, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM lab GROUP BY blob) "


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.label(_blob(spark, sf_dir)[0].where("m"), WIDTH)


@query(_COMP + "SELECT y, x, blob FROM lab")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)


@query(_COMP + "SELECT blob, area FROM ar")
def blob_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.areas(_labelled(spark, sf_dir)).select("blob", "area")


@query(_COMP + ", lim AS (SELECT * FROM ar, h) SELECT blob, greatest(y0 - 40, 0) AS y0, least(y1 + 40, n - 1) AS y1, greatest(x0 - 40, 0) AS x0, least(x1 + 40, 49) AS x1 FROM lim")
def blob_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = virtual.height(virtual.target(spark, sf_dir))
    a, zero = components.areas(_labelled(spark, sf_dir)), F.lit(0).cast("long")
    return a.select("blob", F.greatest(F.col("y0") - 40, zero).alias("y0"), F.least(F.col("y1") + 40, F.lit(n - 1).cast("long")).alias("y1"), F.greatest(F.col("x0") - 40, zero).alias("x0"), F.least(F.col("x1") + 40, F.lit(WIDTH - 1).cast("long")).alias("x1"))


@query(_COMP + "SELECT y, x, blob FROM lab JOIN ar USING (blob) WHERE area >= 40")
def remove_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.without_small(_labelled(spark, sf_dir)).select("y", "x", "blob")


def _keyed_labels_sql(name: str, source: str) -> str:
    """Labels by a recursion that keeps one row a pixel, so a large background takes no more than its pixels."""
    return f"""{name}(y, x, l) USING KEY (y, x) AS (SELECT y, x, y * 50 + x FROM {source} UNION
 (SELECT p.y, p.x, min(r.l) FROM {name} r, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dy, dx), {source} p JOIN recurring.{name} own ON own.y = p.y AND own.x = p.x WHERE p.y = r.y + dy AND p.x = r.x + dx AND r.l < own.l GROUP BY p.y, p.x))"""


@query(f"""WITH RECURSIVE {_T}, {_BLOB}, src AS MATERIALIZED (SELECT y, x FROM blob WHERE NOT m), {_keyed_labels_sql('bg', 'src')}
 SELECT y, x FROM blob WHERE m UNION ALL SELECT y, x FROM bg WHERE l IN (SELECT l FROM bg GROUP BY l HAVING count(*) < 64)""")
def fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = written(_blob(spark, sf_dir)[0])
    return components.holes_filled(mask.where("m"), mask, WIDTH)


@query(_COMP + """, n AS (SELECT p.y, p.x, min(struct_pack(d := dy * dy + dx * dx, b := q.blob)) AS k FROM lab q, range(-25, 26) a(dy), range(-25, 26) b(dx), t p WHERE p.y = q.y + dy AND p.x = q.x + dx AND dy * dy + dx * dx <= 625 GROUP BY p.y, p.x)
 SELECT y, x FROM n JOIN ar ON ar.blob = k.b WHERE k.d <= least(greatest(sqrt(area / pi()) * 0.30, 3), 25) * least(greatest(sqrt(area / pi()) * 0.30, 3), 25)""")
def expand_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.expanded(written(_labelled(spark, sf_dir)), virtual.target(spark, sf_dir))


@query(f"""WITH {_T}, {_O}, s AS (SELECT dn AS v, count(*) AS n FROM t GROUP BY dn), t2 AS (SELECT g AS v, count(*) AS n FROM o GROUP BY g),
 sc AS (SELECT v, sum(n) OVER (ORDER BY v) / (SELECT count(*) FROM t) AS share FROM s), tc AS (SELECT v, sum(n) OVER (ORDER BY v) / (SELECT count(*) FROM o) AS share FROM t2),
 lo AS (SELECT sc.v, sc.share, a.v AS av, a.share AS ash FROM sc ASOF LEFT JOIN tc a ON sc.share >= a.share),
 hi AS (SELECT lo.*, b.v AS bv, b.share AS bsh FROM lo ASOF LEFT JOIN tc b ON lo.share < b.share)
 SELECT v, round(CASE WHEN av IS NULL THEN bv WHEN bv IS NULL OR share = ash THEN av ELSE av + (share - ash) * (bv - av) / (bsh - ash) END, 6) AS matched FROM hi""")
def histogram_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = virtual.observations(spark, sf_dir).select(F.col("g").alias("dn"))
    return color.histogram_match(virtual.target(spark, sf_dir), template)


@query(f"""WITH {_T}, c AS (SELECT y, x, dn, 10000 - dn AS res, scl IN (8, 9) AS m FROM t), w AS (SELECT y, x, CASE WHEN m THEN 0 ELSE 1 END AS cw, CASE WHEN m THEN 0 ELSE dn END AS cv, CASE WHEN m THEN 1 ELSE 0 END AS mw, CASE WHEN m THEN res ELSE 0 END AS mv FROM c),
 {_box('bx', 'w', ['cw', 'cv', 'mw', 'mv'], 41)} SELECT y, x, round(CASE WHEN m THEN res + (cv / 1681.0) / greatest(cw / 1681.0, 1e-6) - (mv / 1681.0) / greatest(mw / 1681.0, 1e-6) ELSE CAST(res AS DOUBLE) END, 6) AS v FROM c JOIN bx USING (y, x)""")
def brightness_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = _pixels(spark, sf_dir)
    rows = t.select("y", "x", F.col("dn").alias("cloudy"), (10000 - F.col("dn")).alias("result"), pointwise.is_cloud(F.col("scl")).alias("m"))
    return color.brightness_corrected(rows, 41, WIDTH, n)


@query(f"""WITH {_T}, k AS (SELECT * FROM (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) f(d, k)),
 g AS (SELECT DISTINCT y // 2 AS y, x // 2 AS x FROM t), p AS (SELECT g.y, g.x, a.k * b.k AS k, 2 * g.y + a.d AS sy, 2 * g.x + b.d AS sx, n FROM g, k a, k b, h),
 f AS (SELECT y, x, k, CASE WHEN sy < 0 THEN -sy WHEN sy >= n THEN 2 * n - 2 - sy ELSE sy END AS sy, CASE WHEN sx < 0 THEN -sx WHEN sx >= 50 THEN 98 - sx ELSE sx END AS sx FROM p)
 SELECT f.y, f.x, CAST(sum(k * dn) AS BIGINT) AS dn FROM f JOIN t ON t.y = sy AND t.x = sx GROUP BY f.y, f.x""")
def pyr_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = _pixels(spark, sf_dir)
    return neighborhood.pyramid_down(t, ["dn"], WIDTH, n)


_K = "k AS (SELECT * FROM (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) f(d, k))"


def _fold_sql(i: str, n: str) -> str:
    around = f"((({i}) % (2 * {n} - 2) + 2 * {n} - 2) % (2 * {n} - 2))"
    return f"CASE WHEN {n} = 1 THEN 0 ELSE least({around}, 2 * {n} - 2 - {around}) END"


def _down_sql(name: str, source: str, columns: list[str], width: int, height: str) -> str:
    sums = ", ".join(f"sum(q.{c} * p.k) / 256.0 AS {c}" for c in columns)
    return f"""{name} AS MATERIALIZED (SELECT p.y, p.x, {sums} FROM (SELECT g.y, g.x, a.k * b.k AS k, 2 * g.y + a.d AS sy, 2 * g.x + b.d AS sx, {height} AS h FROM (SELECT DISTINCT y // 2 AS y, x // 2 AS x FROM {source}) g, k a, k b, h) p, {source} q
 WHERE q.y = {_fold_sql("p.sy", "p.h")} AND q.x = {_fold_sql("p.sx", str(width))} GROUP BY p.y, p.x)"""


def _up_sql(name: str, source: str, grid: str, columns: dict[str, str], width: int, height: str) -> str:
    """64 times the values of source on the pixels of grid, whose size is given."""
    half = (width + 1) // 2
    sums = ", ".join(f"sum(q.{c} * p.k) AS {n}" for c, n in columns.items())
    return f"""{name} AS (SELECT p.y, p.x, {sums} FROM (SELECT g.y, g.x, a.k * b.k AS k, (g.y - a.d) // 2 AS cy, (g.x - b.d) // 2 AS cx, ({height} + 1) // 2 AS hh FROM {grid} g, k a, k b, h WHERE (g.y - a.d) % 2 = 0 AND (g.x - b.d) % 2 = 0) p, {source} q
 WHERE q.y = CASE WHEN cy < 0 THEN least(1, hh - 1) WHEN cy >= hh THEN hh - 1 ELSE cy END AND q.x = CASE WHEN cx < 0 THEN {min(1, half - 1)} WHEN cx >= {half} THEN {half - 1} ELSE cx END GROUP BY p.y, p.x)"""


def _gauss_sql(name: str, source: str, column: str, sigma: float, mirror: bool = False) -> str:
    kernel = neighborhood.gaussian_kernel(sigma)
    taps = ", ".join(f"({i - len(kernel) // 2}, CAST({k!r} AS DOUBLE))" for i, k in enumerate(kernel))
    at = _fold_sql if mirror else lambda i, n: f"least(greatest({i}, 0), {n} - 1)"
    return f"""{name}_k AS (SELECT * FROM (VALUES {taps}) f(d, k)),
 {name}_px AS MATERIALIZED (SELECT y, x, k, {at("x + d", "50")} AS sx FROM {source}, {name}_k),
 {name}_x AS MATERIALIZED (SELECT p.y, p.x, sum(q.{column} * k) AS {column} FROM {name}_px p JOIN {source} q ON q.y = p.y AND q.x = p.sx GROUP BY p.y, p.x),
 {name}_py AS MATERIALIZED (SELECT y, x, k, {at("y + d", "n")} AS sy FROM {name}_x, {name}_k, h),
 {name} AS (SELECT p.y, p.x, sum(q.{column} * k) AS {column} FROM {name}_py p JOIN {name}_x q ON q.x = p.x AND q.y = p.sy GROUP BY p.y, p.x)"""


@query(f"WITH {_T}, {_K}, g AS (SELECT gy.y, gx.x FROM (SELECT DISTINCT 2 * y + e AS y FROM t, range(2) r(e)) gy, (SELECT DISTINCT 2 * x + e AS x FROM t, range(2) r(e)) gx), {_up_sql('u', 't', 'g', {'dn': 'dn'}, 100, '(2 * n)')} SELECT y, x, CAST(dn AS BIGINT) AS dn FROM u")
def pyr_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = _pixels(spark, sf_dir)
    return neighborhood.pyramid_up(t, ["dn"], 2 * WIDTH, 2 * n)


def _seam(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The inverted target inside the blob mask, the target outside."""
    blob, n = _blob(spark, sf_dir)
    return virtual.target(spark, sf_dir).select("y", "x", (10000 - F.col("dn")).alias("a"), F.col("dn").alias("b")).join(blob, ["y", "x"]), n


_SEAM = f"{_T}, {_BLOB}, s AS MATERIALIZED (SELECT y, x, 10000 - dn AS a, dn AS b, m, CASE WHEN m THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f FROM t JOIN blob USING (y, x))"


def _laplacian_sql() -> str:
    w, h = [50], ["n"]
    for _ in range(5):
        w.append((w[-1] + 1) // 2)
        h.append(f"(({h[-1]} + 1) // 2)")
    parts = [_SEAM, _K, _gauss_sql("soft", "s", "f", 7.5), "l0 AS MATERIALIZED (SELECT s.y, s.x, s.a::DOUBLE AS a, s.b::DOUBLE AS b, least(greatest(soft.f, 0), 1) AS m FROM s JOIN soft USING (y, x))"]
    parts += [_down_sql(f"l{k + 1}", f"l{k}", ["a", "b", "m"], w[k], h[k]) for k in range(5)]
    parts.append("v5 AS (SELECT y, x, a, b, a * m + b * (1 - m) AS v FROM l5)")
    for k in range(4, -1, -1):
        parts.append(_up_sql(f"u{k}", f"v{k + 1}", f"l{k}", {"a": "ua", "b": "ub", "v": "uv"}, w[k], h[k]))
        parts.append(f"v{k} AS MATERIALIZED (SELECT y, x, a, b, uv / 64.0 + (a - ua / 64.0) * m + (b - ub / 64.0) * (1 - m) AS v FROM l{k} JOIN u{k} USING (y, x))")
    return f"WITH {', '.join(parts)} SELECT y, x, round(v, 3) AS v FROM v0"


@query(_laplacian_sql())
def laplacian_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    seam, n = _seam(spark, sf_dir)
    return blending.laplacian_blend(seam, WIDTH, n).withColumn("v", F.round("v", 3))


@query(f"""WITH {_SEAM}, d AS (SELECT p.y, p.x, sqrt(min(dy * dy + dx * dx)) AS d FROM s p, range(-15, 16) a(dy), range(-15, 16) b(dx), s q WHERE dy * dy + dx * dx <= 225 AND q.y = p.y + dy AND q.x = p.x + dx AND q.m <> p.m GROUP BY p.y, p.x),
 al AS (SELECT s.y, s.x, CASE WHEN m THEN coalesce(least(d / 15, 1), 1) ELSE coalesce(greatest(1 - d / 15, 0), 0) END AS f FROM s LEFT JOIN d USING (y, x)),
 {_gauss_sql('soft', 'al', 'f', 5.0)} SELECT s.y, s.x, round(soft.f * a + (1 - soft.f) * b, 3) AS v FROM s JOIN soft USING (y, x)""")
def feather_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    seam, n = _seam(spark, sf_dir)
    return blending.feather_blend(seam, WIDTH, n).withColumn("v", F.round("v", 3))


@query(f"WITH {_SEAM}, {_gauss_sql('low', 's', 'b', 3.0, True)} SELECT s.y, s.x, round(CASE WHEN m THEN s.a + 0.55::DOUBLE * (s.b - low.b) ELSE s.a::DOUBLE END, 3) AS v FROM s JOIN low USING (y, x)")
def gaussian_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    seam, n = _seam(spark, sf_dir)
    return blending.refined_texture(seam.select("y", "x", F.col("a").alias("v"), F.col("b").alias("detail"), "m"), WIDTH, n).withColumn("v", F.round("v", 3))


def _stats_sql(v: str, s: str, w: str) -> tuple[str, str]:
    mean = f"({s} / 1681.0::DOUBLE) / greatest({w} / 1681.0::DOUBLE, 1e-6)"
    return mean, f"sqrt(greatest(({v} / 1681.0::DOUBLE) / greatest({w} / 1681.0::DOUBLE, 1e-6) - ({mean}) * ({mean}), 1e-6))"


_OWN, _GOAL = _stats_sql("oq", "os", "ow"), _stats_sql("gq", "gs", "gw")


@query(f"""WITH {_T}, c AS (SELECT y, x, 10000 - dn AS src, CASE WHEN scl NOT IN (3, 8, 9, 10, 11) THEN 1 ELSE 0 END AS gw, dn FROM t),
 w AS (SELECT y, x, 1 AS ow, src AS os, src * src AS oq, gw, gw * dn AS gs, gw * dn * dn AS gq FROM c), {_box('bx', 'w', ['ow', 'os', 'oq', 'gw', 'gs', 'gq'], 41)}
 SELECT c.y, c.x, round((src - {_OWN[0]}) * ({_GOAL[1].replace('gw', 'bx.gw')} / greatest({_OWN[1]}, 1e-6)) + {_GOAL[0].replace('gw', 'bx.gw')}, 3) AS v FROM c JOIN bx USING (y, x)""")
def color_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = _pixels(spark, sf_dir)
    rows = t.select("y", "x", (10000 - F.col("dn")).alias("source"), F.col("dn").alias("target"), pointwise.is_clear(F.col("scl")).alias("clear"))
    return color.color_transferred(rows, 41, WIDTH, n).withColumn("v", F.round("v", 3))


_GRID = "gr AS (SELECT y, x, y * 0.5 + 0.25 AS sy, x * 0.75 + 3.5 AS sx FROM t)"


def _grid() -> tuple:
    return F.col("y") * 0.5 + 0.25, F.col("x") * 0.75 + 3.5


@query(f"WITH {_T}, {_GRID} SELECT gr.y, gr.x, coalesce(t.dn, 0) AS dn FROM gr LEFT JOIN t ON t.y = floor(sy + 0.5) AND t.x = floor(sx + 0.5)")
def nearest_regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = virtual.target(spark, sf_dir)
    return register.nearest(t, t, *_grid(), "dn")


@query(f"WITH {_T}, {_GRID}, c AS (SELECT gr.y, gr.x, floor(sy) + dy AS gy, floor(sx) + dx AS gx, (1 - abs(sy - floor(sy) - dy)) * (1 - abs(sx - floor(sx) - dx)) AS k FROM gr, range(2) a(dy), range(2) b(dx)) SELECT c.y, c.x, round(CAST(sum(dn * k) / sum(k) AS DOUBLE), 6) AS dn FROM c JOIN t ON t.y = gy AND t.x = gx WHERE k > 0 GROUP BY c.y, c.x")
def bilinear_regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = virtual.target(spark, sf_dir)
    return register.bilinear(t, t, *_grid(), "dn")


_BITS = "d AS (SELECT vec_id AS id, [CASE WHEN v > 0 THEN 1 ELSE 0 END for v in embedding] AS bits FROM embeddings)"


@query(f"WITH {_BITS}, p AS (SELECT q.id, t.id AS match, list_sum([abs(q.bits[i] - t.bits[i]) for i in range(1, 65)]) AS distance FROM d q, d t WHERE q.id <> t.id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, match) AS n FROM p) SELECT a.id, a.match, CAST(a.distance AS BIGINT) AS distance FROM k a JOIN k b ON a.id = b.id AND a.n = 1 AND b.n = 2 WHERE a.distance < 0.95 * b.distance")
def hamming_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the table matched with all others, in pairs of blocks; a ratio at which random bits have matches."""
    rows = virtual.spectra(spark, sf_dir).select("id", register.sign_bits(F.col("bands")).alias("bits"))
    return register.hamming_matches_among(rows, 0.95).select("id", "match", F.col("distance").cast("long").alias("distance"))


@query(_COMP + """, bx AS (SELECT blob, greatest(y0 - 40, 0) AS y0, least(y1 + 40, n - 1) AS y1, greatest(x0 - 40, 0) AS x0, least(x1 + 40, 49) AS x1 FROM ar, h),
 crop AS MATERIALIZED (SELECT bx.blob, p.dn AS cloudy, 10000 - p.dn AS res, b.m FROM bx JOIN t p ON p.y BETWEEN bx.y0 AND bx.y1 AND p.x BETWEEN bx.x0 AND bx.x1 JOIN blob b ON b.y = p.y AND b.x = p.x),
 ok AS (SELECT blob FROM crop GROUP BY blob HAVING sum(CASE WHEN m THEN 0 ELSE 1 END) >= 20),
 sc AS (SELECT blob, v, sum(c) OVER (PARTITION BY blob ORDER BY v) AS u FROM (SELECT blob, res AS v, count(*) AS c FROM crop GROUP BY blob, res)),
 tc AS (SELECT blob, v, sum(c) OVER (PARTITION BY blob ORDER BY v) AS u FROM (SELECT blob, cloudy AS v, count(*) AS c FROM crop GROUP BY blob, cloudy)),
 lo AS (SELECT sc.blob, sc.v, sc.u, a.v AS av, a.u AS au FROM sc ASOF LEFT JOIN tc a ON sc.blob = a.blob AND sc.u >= a.u),
 hi AS (SELECT lo.*, b.v AS bv, b.u AS bu FROM lo ASOF LEFT JOIN tc b ON lo.blob = b.blob AND lo.u < b.u),
 mt AS (SELECT blob, v, CASE WHEN av IS NULL THEN bv WHEN bv IS NULL OR u = au THEN av ELSE av + CAST(u - au AS DOUBLE) * (bv - av) / CAST(bu - au AS DOUBLE) END AS matched FROM hi JOIN ok USING (blob))
 SELECT t.y, t.x, round(CAST(coalesce(matched, 10000 - t.dn) AS DOUBLE), 6) AS v FROM t LEFT JOIN lab ON lab.y = t.y AND lab.x = t.x LEFT JOIN mt ON mt.blob = lab.blob AND mt.v = 10000 - t.dn""")
def blob_histogram_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    seam, n = _seam(spark, sf_dir)
    rows = written(seam.select("y", "x", F.col("a").alias("result"), F.col("b").alias("cloudy"), "m"))
    labelled = written(components.label(rows.where("m"), WIDTH))
    return color.blob_histogram_match(rows, labelled, WIDTH, n).withColumn("v", F.round("v", 6))


# An iterative solution is no SQL; tests compare with a direct solution of the same equations.
@query()
def poisson_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson.poisson_blend(_seam(spark, sf_dir)[0]).withColumn("v", F.round("v", 2))


@query("SELECT vec_id AS id, round(least(greatest(list_avg(CAST(embedding[1:10] AS DOUBLE[])) * 4, 0), 1), 6) AS probability, 0.0::DOUBLE AS without FROM embeddings")
def cloud_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a detector whose values leave 0 to 1 at both ends, and without one."""
    p = plugins.cloud_probability(F.col("bands"), lambda bands: pointwise.luminance(bands) * 4)
    return virtual.spectra(spark, sf_dir).select("id", F.round(p, 6).alias("probability"), plugins.cloud_probability(F.col("bands")).alias("without"))


@query("SELECT vec_id AS id, list_avg(CAST(embedding[1:10] AS DOUBLE[])) >= 0.05::DOUBLE AS cloud FROM embeddings")
def detected_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a detector: the mean of the ten bands."""
    p = plugins.cloud_probability(F.col("bands"), pointwise.luminance)
    return virtual.spectra(spark, sf_dir).select("id", (p >= 0.05).alias("cloud"))


@query(_FILL + """, whole AS (SELECT y, x, coalesce(r, dn) AS r, coalesce(g, dn) AS g, coalesce(b, dn) AS b, m AND none AS u FROM f),
 known AS (SELECT x, sum(r) // count(*) AS kr, sum(g) // count(*) AS kg FROM whole WHERE NOT u GROUP BY x)
 SELECT y, whole.x, CAST(CASE WHEN u AND y % 2 = 0 THEN coalesce(kr, r) ELSE r END AS BIGINT) AS r, CAST(CASE WHEN u AND y % 2 = 0 THEN coalesce(kg, g) ELSE g END AS BIGINT) AS g, CAST(CASE WHEN u AND y % 2 = 0 THEN coalesce(7, b) ELSE b END AS BIGINT) AS b FROM whole LEFT JOIN known USING (x)""")
def inpaint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inpainter that knows even rows only: the mean of the column's resolved pixels. Other unresolved pixels stay."""

    def column_means(df: DataFrame) -> DataFrame:
        mean = lambda c: F.expr(f"sum({c}) div count(*)").alias(c)
        known = df.where(~F.col("unresolved")).groupBy("x").agg(mean("r"), mean("g"))
        return df.where("y % 2 = 0").select("y", "x").join(known, "x", "left").withColumn("b", F.lit(7).cast("long"))

    return plugins.inpaint(_filled(spark, sf_dir), column_means).select("y", "x", "r", "g", "b")


@query("SELECT event_id AS id, CAST(round_even(-25.0 / tan(radians(greatest(user_id % 90, 1))) * cos(radians(event_id % 360)), 0) AS INTEGER) AS dy, CAST(round_even(-25.0 / tan(radians(greatest(user_id % 90, 1))) * sin(radians(event_id % 360)), 0) AS INTEGER) AS dx FROM events")
def shadow_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets for the sun's places that the events give."""
    e = virtual.table(spark, sf_dir, "events")
    dy, dx = reconstruct.shadow_offsets(F.col("event_id") % 360, F.col("user_id") % 90, 25.0)
    return e.select(F.col("event_id").alias("id"), dy.alias("dy"), dx.alias("dx"))


@query(f"""WITH {_T}, {_BLOB}, {_foot('a', 'blob', 7)}, {_foot('d', 'blob', 7, True)}, {_foot('w', 'blob', 21)}, {_box('bx', 't', ['dn'], 40)}
 SELECT y, x, blob.m OR a.m AND NOT d.m OR (w.m AND NOT blob.m AND t.dn * 1600 > bx.dn + 500 * 1600) AS m FROM blob JOIN a USING (y, x) JOIN d USING (y, x) JOIN w USING (y, x) JOIN t USING (y, x) JOIN bx USING (y, x)""")
def merged_cloud_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, without a detector, with their border ring and halo, by the plan's own gating."""
    blob, n = _blob(spark, sf_dir)
    pixels = virtual.target(spark, sf_dir).select("y", "x", "dn").join(blob, ["y", "x"]).select("y", "x", "dn", F.when(F.col("m"), 9).otherwise(4).alias("scl"))
    return reconstruct.cloud_mask(written(pixels), ["dn"], WIDTH, n, Config())


_AT = "gr AS (SELECT y, x, (y + 0.5) * 0.5 + 2 - 0.5 AS sy, (x + 0.5) * 0.5 + 5 - 0.5 AS sx FROM t)"


@query(f"WITH {_T}, {_AT}, c AS (SELECT gr.y, gr.x, floor(sy) + dy AS gy, floor(sx) + dx AS gx, (1 - abs(sy - floor(sy) - dy)) * (1 - abs(sx - floor(sx) - dx)) AS k FROM gr, range(2) a(dy), range(2) b(dx)), f AS (SELECT c.y, c.x, sum(dn * k) / sum(k) AS dn FROM c JOIN t ON t.y = gy AND t.x = gx WHERE k > 0 GROUP BY c.y, c.x) SELECT t.y, t.x, round(CAST(coalesce(f.dn, 0) AS DOUBLE), 6) AS dn FROM t LEFT JOIN f USING (y, x)")
def aligned_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target brought, by the affine maps of both, to a grid of half its pixel size that begins 5 columns and 2 rows further."""
    t, n = _pixels(spark, sf_dir)
    grid = lambda a, c, e, f: Row(crs="EPSG:32631", width=WIDTH, height=n, transform=[a, 0.0, c, 0.0, e, f])
    own, goal = grid(10.0, 500000.0, -10.0, 4600000.0), grid(5.0, 500050.0, -5.0, 4599980.0)
    out = run_plan.on_grid(t.select("y", "x", F.col("dn").cast("double").alias("dn")), own, goal, ["dn"])
    return out.select("y", "x", F.round("dn", 6).alias("dn"))


_K = "(SELECT y, x, (x + 0.5) * 0.00012 + 2.163 AS lon, 41.545 - (y + 0.5) * 0.00009 AS lat, 1 / 298.257223563 / (2 - 1 / 298.257223563) AS n FROM t)"


@query(f"""WITH {_T}, a AS (SELECT y, x, radians(lon - 3) AS l, sin(radians(lat)) AS s, n, 2 * sqrt(n) / (1 + n) AS e FROM {_K}), b AS (SELECT *, sinh(atanh(s) - e * atanh(e * s)) AS c FROM a),
 d AS (SELECT *, atan2(c, cos(l)) AS p, asinh(sin(l) / sqrt(c * c + cos(l) * cos(l))) AS q, 0.9996 * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS r, [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16, 13 * n ** 2 / 48 - 3 * n ** 3 / 5, 61 * n ** 3 / 240] AS k FROM b),
 f AS (SELECT y, x, 500000 + r * (q + list_sum([k[j] * cos(2 * j * p) * sinh(2 * j * q) for j in [1, 2, 3]])) AS east, r * (p + list_sum([k[j] * sin(2 * j * p) * cosh(2 * j * q) for j in [1, 2, 3]])) AS north FROM d)
 SELECT f.y, f.x, CAST(coalesce(t.dn, 0) AS DOUBLE) AS dn FROM f LEFT JOIN t ON t.x = floor((east - 430000) / 10) AND t.y = floor((4600000 - north) / 10)""")
def geographic_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target, of a UTM zone, brought to a grid of degrees by the nearest pixel."""
    t, n = _pixels(spark, sf_dir)
    own = Row(crs="EPSG:32631", width=WIDTH, height=n, transform=[10.0, 0.0, 430000.0, 0.0, -10.0, 4600000.0])
    goal = Row(crs="EPSG:4326", width=WIDTH, height=n, transform=[0.00012, 0.0, 2.163, 0.0, -0.00009, 41.545])
    return run_plan.on_grid(t.select("y", "x", F.col("dn").cast("double").alias("dn")), own, goal, ["dn"], nearest=True)


@query(f"WITH {_T}, {_O}, r AS (SELECT y, x, scene, g, clear, round(1.0 / (1.0 + abs(date_diff('microsecond', t.acq, o.acq) / 8.64e10)), 9) AS weight FROM o JOIN t USING (y, x)) SELECT * FROM r UNION ALL SELECT y, x, 0 AS scene, dn AS g, true AS clear, 1.5 AS weight FROM t")
def stack_with_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations with a reference layer before them, as scene 0 of its own weight."""
    rows = _weighted(spark, sf_dir).select("y", "x", F.col("scene").cast("int").alias("scene"), "g", "clear", F.round("weight", 9).alias("weight"))
    layer = virtual.target(spark, sf_dir).select("y", "x", F.lit(0).alias("scene"), F.col("dn").alias("g"), F.lit(True).alias("clear"), F.lit(Config().uploaded_reference_weight).alias("weight"))
    return layer.unionByName(rows)


@query(f"WITH {_T} SELECT y, x, dn, 9 - scl AS other FROM t")
def geotiff_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bands written as one file in the shared folder, and read again."""
    t, n = _pixels(spark, sf_dir)
    path = shared_path(spark) + ".tif"
    tiff.write_tiff(t.select("y", "x", "dn", (9 - F.col("scl")).alias("other")), ["dn", "other"], path, WIDTH, n)
    rows = tiff.read_tiff(spark, path)[1]
    band = lambda i, kind: F.max(F.when(F.col("band") == i, F.col("v"))).cast(kind)
    return rows.groupBy("y", "x").agg(band(1, "long").alias("dn"), band(2, "int").alias("other"))


def _registered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float | None]:
    """The smoothed target registered to itself moved by (2, -3), and the mean distance of the matches that agree."""
    t, n = _pixels(spark, sf_dir)
    grey = written(neighborhood.box_sums(t, ["dn"], 5, WIDTH, n).select("y", "x", (F.col("dn") / 25.0).alias("grey")))
    moving = grey.select((F.col("y") + 2).alias("y"), (F.col("x") - 3).alias("x"), "grey", F.col("grey").alias("v")).where(F.col("y").between(0, n - 1) & F.col("x").between(0, WIDTH - 1))
    return features.refined(grey, written(moving), ["v"], WIDTH, n)


# No SQL for corners, random samples and a least-squares fit; tests find a known shift, and the error is bounded below.
@query()
def image_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registered(spark, sf_dir)[0].withColumn("v", F.round("v", 3))


@query("SELECT true AS found, true AS within_half_a_pixel")
def registration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the known move is found, and the mean distance of the matches that agree is under half a pixel."""
    error = _registered(spark, sf_dir)[1]
    return spark.createDataFrame([(error is not None, error is not None and error < 0.5)], "found boolean, within_half_a_pixel boolean")


_CLEAN = f"""WITH RECURSIVE {_T}, {_BLOB}, {_foot('o1', 'blob', 5, True)}, {_foot('o2', 'o1', 5)}, {_foot('c1', 'o2', 5)}, {_foot('c2', 'c1', 5, True)}, shape AS MATERIALIZED (SELECT y, x, m FROM c2),
 src AS MATERIALIZED (SELECT y, x FROM shape WHERE m), {_keyed_labels_sql('fg', 'src')}, large AS MATERIALIZED (SELECT y, x FROM fg WHERE l IN (SELECT l FROM fg GROUP BY l HAVING count(*) >= 40)),
 rest AS MATERIALIZED (SELECT y, x FROM shape EXCEPT SELECT y, x FROM large), {_keyed_labels_sql('bg', 'rest')}, small AS (SELECT y, x FROM bg WHERE l IN (SELECT l FROM bg GROUP BY l HAVING count(*) < 64))
 SELECT s.y, s.x, g.y IS NOT NULL AS m FROM shape s LEFT JOIN (SELECT y, x FROM large UNION SELECT y, x FROM small) g ON g.y = s.y AND g.x = s.x"""


@query(_CLEAN)
def clean_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconstruct.clean_mask(written(_blob(spark, sf_dir)[0]), WIDTH, Config())


@query()
def reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps for one band, g of the observations into dn; tests check the steps."""
    t, n = _pixels(spark, sf_dir)
    obs = virtual.observations(spark, sf_dir).join(t.select("y", "x", F.col("acq").alias("wanted")), ["y", "x"])
    obs = obs.select("y", "x", "scene", F.col("g").alias("dn"), "clear", stack.temporal_weight(stack.days_between("wanted", "acq")).alias("weight"))
    # The virtual classes are noise, of which the whole raster would become mask: the smooth blobs are the cloud.
    blob = written(_blob(spark, sf_dir)[0])
    pixels = t.select("y", "x", "dn").join(blob, ["y", "x"]).select("y", "x", "dn", F.when(F.col("m"), 9).otherwise(4).alias("scl"))
    return reconstruct.reconstruct(pixels, obs, ["dn"], WIDTH, n, Config()).pixels
