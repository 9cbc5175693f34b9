"""Files of their own kind in any store that Spark reaches, by the session's file systems; run folders."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    """The file system and path of a name; a plain name is in the session's default file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return bool(fs.exists(p))


def make_folder(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    fs.mkdirs(p)
    return path


def write_bytes(spark: SparkSession, path: str, parts: Iterable[bytes]) -> str:
    """One file from parts in order: written under another name and renamed, so that no reader sees half of it."""
    fs, p = _path(spark, path)
    fresh = spark._jvm.org.apache.hadoop.fs.Path(path + ".writing")
    out = fs.create(fresh, True)
    try:
        for part in parts:
            out.write(bytearray(part))
    except BaseException:
        out.close()
        fs.delete(fresh, False)
        raise
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(fresh, p):
        raise OSError(f"could not rename {path}.writing")
    return path


class RunFolder:
    """A folder of its own for each run: run_YYYYmmdd_HHMMSS, with _1, _2 ... where that is taken."""

    PARTS = ("03_downloaded_images", "04_registered_images")

    def __init__(self, spark: SparkSession, root: str, now: dt.datetime | None = None) -> None:
        base = f"{root.rstrip('/')}/run_{(now or dt.datetime.now()):%Y%m%d_%H%M%S}"
        name, k = base, 0
        while exists(spark, name):
            k += 1
            name = f"{base}_{k}"
        self.folder = make_folder(spark, name)
        for part in self.PARTS:
            make_folder(spark, f"{name}/{part}")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"
