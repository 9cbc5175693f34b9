import datetime as dt

import numpy as np
import pytest

from clearstack.__main__ import configure, parser
from clearstack.plans import run as runs
from clearstack.sources import tiff
from clearstack.sources.runlog import RunLog
from pyspark.sql import functions as F

H, W = 30, 32
AFFINE = [10.0, 0.0, 1000.0, 0.0, -10.0, 2000.0]


def _write(spark, path, values, affine=AFFINE, crs="EPSG:32633"):
    values = values if values.ndim == 3 else values[:, :, None]
    h, w, n = values.shape
    df = spark.createDataFrame([(y, x, *map(float, values[y, x])) for y in range(h) for x in range(w)], "y long, x long, " + ", ".join(f"b{i} double" for i in range(n)))
    return tiff.write_tiff(df, [f"b{i}" for i in range(n)], f"file://{path}", w, h, affine=affine, crs=crs, compression="deflate")


def test_a_run_writes_its_results(spark, tmp_path):
    y, x = np.mgrid[:H, :W]
    ground = (2000 + 20 * y + 10 * x)[:, :, None] + np.array([0])
    cloudy = ground.copy()
    cloudy[10:20, 8:18] = 9000
    scl = np.where(cloudy[:, :, 0] == 9000, 9, 4)
    paths = [_write(spark, tmp_path / f"{n}.tif", v) for n, v in (("cloudy", cloudy), ("reference", ground), ("scl", scl))]
    args = parser().parse_args(["--cloudy", paths[0], "--no-poisson-blending", "--quiet-debug", "--output-root", f"file://{tmp_path}/out", "--bbox", "1", "2", "3", "4"])
    config = configure(args)
    assert config.bbox == (1, 2, 3, 4) and not config.use_poisson_blending and not config.debug_mode
    got = runs.run(spark, *paths, config=config, log=RunLog(echo=False))
    assert got["temporal_layers"] == 1 and got["cloud_percentage"] > 5
    meta, pixels = tiff.read_tiff(spark, got["geotiff"])
    m = meta.first()
    assert (m.width, m.height, m.band_count, m.crs, list(m.transform)) == (W, H, 1, "EPSG:32633", AFFINE)
    assert pixels.count() == H * W and pixels.agg(F.max("v")).first()[0] < 9000
    folder = tmp_path / "out" / got["run_dir"].rsplit("/", 1)[1]
    assert {"01_input.png", "02_reference.png", "14_final.png", "15_final.tif", "processing_log.txt"} <= {p.name for p in folder.iterdir()}
    text = (folder / "processing_log.txt").read_text()
    assert "cloud_percentage" in text and "temporal_stack_layers: 1" in text and "pyspark" in text


def test_scenes_of_single_band_assets_behind_signed_names(spark, tmp_path):
    """Assets of a map column, read under signed names, of the configured collection only; previews of what was read."""
    y, x = np.mgrid[:H, :W]
    ground = np.repeat((2000 + 20 * y + 10 * x)[:, :, None], 4, axis=2) + np.arange(4) * 100
    files = {a: _write(spark, tmp_path / f"signed-{a}.tif", ground[:, :, i]) for i, a in enumerate(runs.BAND_ASSETS)}
    files["SCL"] = _write(spark, tmp_path / "signed-SCL.tif", np.where(x < 4, 9, 4))
    plain = {a: p.replace("signed-", "") for a, p in files.items()}
    day = dt.datetime(2024, 1, 10)
    rows = [("a/1", day, 1.0, 5.0, 5.0, "sentinel-2-l2a", plain), ("b", day, 1.0, 5.0, 5.0, "other", plain), ("c", day, 1.0, 5.0, 5.0, "sentinel-2-l2a", {"B04": plain["B04"]})]
    catalog = spark.createDataFrame(rows, "id string, datetime timestamp_ntz, cloud_cover double, lon double, lat double, collection string, assets map<string,string>")
    config = configure(parser().parse_args(["--lat", "5", "--lon", "5", "--date", "2024-01-10", "--no-poisson-blending", "--output-root", f"file://{tmp_path}/out"]))
    log, sign = RunLog(echo=False), lambda p: p.replace(f"{tmp_path}/", f"{tmp_path}/signed-")
    goal, target, bands = runs._read(spark, _write(spark, tmp_path / "t.tif", ground))
    shown = []
    got = runs.scenes(spark, catalog, goal, target.cache(), bands, config, day, log, sign, lambda n, d: shown.append(n))
    assert len(got) == 1 and shown == ["a/1"] and len(log.events) == 1 and "no asset B03" in log.events[0]
    out = got[0].collect()
    assert len(out) == H * W and all([r.r, r.g, r.b, r.n] == ground[r.y, r.x].tolist() and r.clear == (r.x >= 4) for r in out)
    from clearstack.sources import png

    png.write_contact_sheet([got[0], target, target], ["r", "g", "b"], f"file://{tmp_path}/sheet.png", W, H, across=2, side=16)
    head = (tmp_path / "sheet.png").read_bytes()[16:24]
    assert (int.from_bytes(head[:4], "big"), int.from_bytes(head[4:], "big")) == (2 * (16 + 4), 2 * (15 + 4))


def test_a_failed_run_leaves_its_log(spark, tmp_path):
    config = configure(parser().parse_args(["--cloudy", "x", "--output-root", f"file://{tmp_path}"]))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        runs.run(spark, f"file://{tmp_path}/none.tif", config=config, log=RunLog(echo=False))
    assert "failed" in next(tmp_path.glob("run_*/processing_log.txt")).read_text()


def test_scenes_are_aligned_and_broken_ones_left_out(spark, tmp_path):
    y, x = np.mgrid[:H, :W]
    ground = np.repeat((2000 + 20 * y + 10 * x)[:, :, None], 4, axis=2)
    wide = np.pad(ground, ((3, 3), (5, 5), (0, 0)), mode="edge")
    good = _write(spark, tmp_path / "good.tif", wide, [10.0, 0.0, 950.0, 0.0, -10.0, 2030.0])
    other = _write(spark, tmp_path / "other.tif", ground, crs="EPSG:2154")
    few = _write(spark, tmp_path / "few.tif", ground[:, :, :2])
    day = dt.datetime(2024, 1, 10)
    rows = [("a", day - dt.timedelta(days=3), 1.0, 5.0, 5.0, good), ("b", day, 1.0, 5.0, 5.0, other), ("c", day, 1.0, 5.0, 5.0, few), ("d", day, 1.0, 5.0, 5.0, good + "x"), ("e", day, 50.0, 5.0, 5.0, good)]
    catalog = spark.createDataFrame(rows, "id string, datetime timestamp_ntz, cloud_cover double, lon double, lat double, path string")
    goal, target, bands = runs._read(spark, _write(spark, tmp_path / "t.tif", ground))
    log = RunLog(echo=False)
    config = configure(parser().parse_args(["--cloudy", "x", "--lat", "5", "--lon", "5"]))
    got = runs.scenes(spark, catalog, goal, target.cache(), bands, config, day, log)
    assert len(got) == 1 and [s["id"] for s in log.scenes] == ["a"] and len(log.events) == 3
    out = got[0].collect()
    assert len(out) == H * W and all(r.r == ground[r.y, r.x, 0] and r.weight == 0.25 and r.clear for r in out)
