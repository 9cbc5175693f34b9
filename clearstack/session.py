"""What every part needs of a session: this package on the executors, and tables in the cluster's shared folder."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, which needn't share the driver's disk or path; once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_clearstack_shipped", False):
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    path = Path(tempfile.mkdtemp()) / "clearstack_code.zip"
    path.write_bytes(buffer.getvalue())
    sc.addPyFile(str(path))
    sc._clearstack_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a local session, as in tests, gets one; a cluster is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="clearstack-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str = "table") -> str:
    """A fresh name in the shared folder."""
    return f"{shared_dir(spark)}/clearstack/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df by way of a table in the shared folder: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._clearstack_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made and nothing reads any more; anything else is left alone."""
    for df in tables:
        path = getattr(df, "_clearstack_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
