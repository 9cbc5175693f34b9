"""Pixel rows as a PNG picture: tasks compress strips of rows, the driver passes them on to the one file."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearstack.session import written
from clearstack.operators.pointwise import stretch_u8
from clearstack.sources.files import write_bytes

#: Corner colours of a dark-to-bright ramp, interpolated between.
RAMP = ((68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37))
ADLER = 65521


def displayable(pixels: DataFrame, columns: list[str]) -> DataFrame:
    """y, x, u0 .. of booleans as 0 and 255, and of numbers stretched to their 99th percentile and cut off.

    One column makes a grey picture, else the first three make its colours; a second of two stands for the third too.
    """
    use = columns[:1] if len(columns) == 1 else (columns + columns[-1:])[:3]
    kinds, out = dict(pixels.dtypes), pixels
    for i, c in enumerate(use):
        if kinds[c] == "boolean":
            out = out.withColumn(f"u{i}", F.when(F.col(c), 255).otherwise(0))
        else:
            out = stretch_u8(out, c).withColumnRenamed("u8", f"u{i}")
    return out.select("y", "x", *[f"u{i}" for i in range(len(use))])


def _strips(width: int, height: int, rows: int, channels: int, ramp: bool):
    def encode(frame: pd.DataFrame) -> pd.DataFrame:
        strip = int(frame["strip"].iloc[0])
        n = min(rows, height - strip * rows)
        block = np.zeros((n, width, channels), np.uint8)
        at = (frame["y"].to_numpy() - strip * rows, frame["x"].to_numpy())
        for b in range(channels):
            block[(*at, b)] = frame[f"u{b}"].fillna(0).to_numpy().astype(np.uint8)
        if ramp:
            places = np.linspace(0, 255, len(RAMP))
            block = np.stack([np.interp(block[:, :, 0], places, [c[i] for c in RAMP]) for i in range(3)], axis=2).astype(np.uint8)
        raw = np.concatenate([np.zeros((n, 1), np.uint8), block.reshape(n, -1)], axis=1).tobytes()
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH)  # ends on a byte, so strips can follow one another
        return pd.DataFrame({"strip": [strip], "data": [data], "sum": [zlib.adler32(raw)], "n": [len(raw)]})

    return encode


def _joined(one: int, two: int, n: int) -> int:
    """The check sum of two runs of bytes from those of each; n is the second's length."""
    a, b = one & 0xFFFF, one >> 16
    c, d = two & 0xFFFF, two >> 16
    return ((b + d + n * (a - 1)) % ADLER) << 16 | (a + c - 1) % ADLER


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(pixels: DataFrame, columns: list[str], path: str, width: int, height: int, ramp: bool = False, strip_bytes: int = 1 << 18) -> str:
    """A picture of columns of pixels (y, x, ...); missing pixels are black. With ramp, one column is drawn in colours."""
    return write_shown(displayable(pixels, columns), path, width, height, ramp, strip_bytes)


def write_contact_sheet(layers: list[DataFrame], columns: list[str], path: str, width: int, height: int, across: int = 4, side: int = 256) -> str | None:
    """Small pictures of the layers in rows of `across`, every k-th pixel so that none is longer than side; none without layers."""
    if not layers:
        return None
    k = max(1, -(-max(width, height) // side))
    w, h = -(-width // k) + 4, -(-height // k) + 4
    sheet = None
    for i, layer in enumerate(layers):
        small = displayable(layer, columns).where((F.col("y") % k == 0) & (F.col("x") % k == 0))
        small = small.withColumns({"y": F.expr(f"y div {k}") + i // across * h, "x": F.expr(f"x div {k}") + i % across * w})
        sheet = small if sheet is None else sheet.unionByName(small)
    return write_shown(sheet, path, min(len(layers), across) * w, -(-len(layers) // across) * h)


def write_shown(shown: DataFrame, path: str, width: int, height: int, ramp: bool = False, strip_bytes: int = 1 << 18) -> str:
    """A picture of y, x, u0 ... of displayable()."""
    channels = len(shown.columns) - 2
    ramp = ramp and channels == 1
    rows = max(1, strip_bytes // (width * channels))
    spark = shown.sparkSession
    frame = shown.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).withColumn("strip", F.expr(f"y div {rows}"))
    blank = spark.range(-(-height // rows)).select((F.col("id") * rows).alias("y"), F.lit(0).cast("long").alias("x"), *[F.lit(None).cast("int").alias(f"u{b}") for b in range(channels)], F.col("id").alias("strip"))
    frame = frame.unionByName(blank.join(frame.select("strip").distinct(), "strip", "left_anti"))
    strips = written(frame.groupBy("strip").applyInPandas(_strips(width, height, rows, channels, ramp), "strip long, data binary, sum long, n long"))

    def parts() -> Iterator[bytes]:
        yield b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if ramp or channels == 3 else 0, 0, 0, 0))
        yield _chunk(b"IDAT", b"\x78\x9c")
        total = 1
        for r in strips.orderBy("strip").toLocalIterator():
            total = _joined(total, r["sum"], r["n"])
            yield _chunk(b"IDAT", bytes(r["data"]))
        yield _chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", total)) + _chunk(b"IEND", b"")

    return write_bytes(spark, path, parts())
