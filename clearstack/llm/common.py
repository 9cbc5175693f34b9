"""What the operators share: Arrow batches, bounded samples, held-out rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearstack.session import discard, shared_dir, ship  # noqa: F401 (the operators take discard and shared_dir from here)
from clearstack.session import written as materialize  # noqa: F401

#: Rows in one Arrow batch: texts can be very long, and a worker holds a batch at a time.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches of the session and ship this package to its executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of doc_id as text is divisible by 5; false for a null doc_id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def release() -> None:
    """Give this process's free memory back to the system: a worker is kept, and would hold it while other stages run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, f: Callable[[dict[str, list]], dict[str, list] | None], schema: str) -> DataFrame:
    """Map batches of df, as lists by column, with f to lists by column of schema; f may return None for no rows.

    Narrow: no shuffle, and a worker holds one batch of at most BATCH_ROWS rows.
    """
    prepare(df.sparkSession)
    names, types = _arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                out = f(batch.to_pydict())
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[n], type=t) for n, t in zip(names, types, strict=True)], names=names)
        finally:
            batch = out = None
            release()

    return df.mapInArrow(run, schema)


def arrow_stream(df: DataFrame, f: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """As arrow_map, but f gets all batches of a partition, so it can keep what it needs between them."""
    prepare(df.sparkSession)
    names, types = _arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in f(b.to_pydict() for b in batches):
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=t) for n, t in zip(names, types, strict=True)], names=names)
        finally:
            out = None
            release()

    return df.mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _arrow_types(schema: str) -> tuple[list[str], list[pa.DataType]]:
    def kind(t: str) -> pa.DataType:
        return pa.list_(kind(t[6:-1])) if t.startswith("array<") else _ARROW[t]

    pairs = [x.strip().split(" ", 1) for x in schema.split(",")]
    return [p[0] for p in pairs], [kind(p[1].strip()) for p in pairs]


def least_hashed(df: DataFrame, key: str, n: int, *ties: str) -> DataFrame:
    """At most n rows of df, those of least hash of key (then key and ties).

    A threshold on the hash leaves about 4 n rows first, so what tasks send on doesn't grow with their number. Where
    many rows share few keys it may leave fewer than n.
    """
    total = df.count()
    turn = F.xxhash64(key)
    if total > 4 * n:
        df = df.where(F.pmod(turn, F.lit(1 << 40)) < int(4 * n / total * (1 << 40)))
    return df.orderBy(F.pmod(turn, F.lit(1 << 40)), key, *ties).limit(n)


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """At least the session's shuffle partitions, and more where that would give them more rows than rows_each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))
