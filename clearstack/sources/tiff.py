"""GeoTIFF files as pixel rows, and pixel rows as GeoTIFF files.

Reading: the header of each file gives its blocks, strips or tiles; blocks are decoded one by one in the task that holds the
file's bytes, and leave as Arrow batches. Writing: tasks encode strips of rows; the driver passes the encoded strips on,
one at a time, to the one file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearstack.session import ship, written
from clearstack.sources.files import write_bytes

# Fixed values of the format: byte sizes and struct codes of field types, and tags.
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, BANDS, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, SAMPLE = 284, 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, GEO_DOUBLES, GEO_TEXT, NO_DATA = 33550, 33922, 34264, 34735, 34736, 34737, 42113
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


class TiffError(ValueError):
    pass


def header(data: bytes) -> dict:
    """Tags of the first image, as tuples or text, with "order"; the classic form and the 64-bit form."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    big = struct.unpack_from(order + "H", data, 2)[0]
    if big not in (42, 43):
        raise TiffError("not a TIFF file")
    at, n_code, n_size, entry, cell = (struct.unpack_from(order + "Q", data, 8)[0], "Q", 8, 20, 8) if big == 43 else (struct.unpack_from(order + "I", data, 4)[0], "H", 2, 12, 4)
    try:
        tags: dict = {"order": order}
        for i in range(struct.unpack_from(order + n_code, data, at)[0]):
            here = at + n_size + i * entry
            tag, kind = struct.unpack_from(order + "HH", data, here)
            count = struct.unpack_from(order + ("Q" if cell == 8 else "I"), data, here + 4)[0]
            code = KINDS.get(kind)
            if code is None:
                continue
            form = f"{order}{count}s" if code == "s" else f"{order}{count * len(code)}{code[0]}"
            value_at = here + 4 + cell
            if struct.calcsize(form) > cell:
                value_at = struct.unpack_from(order + ("Q" if cell == 8 else "I"), data, value_at)[0]
            values = struct.unpack_from(form, data, value_at)
            tags[tag] = values[0].split(b"\0")[0].decode("utf-8", "replace") if code == "s" else values
    except struct.error as e:
        raise TiffError("a cut TIFF file") from e
    if WIDTH not in tags or HEIGHT not in tags:
        raise TiffError("a TIFF file without a size")
    if tags.get(BANDS, (1,))[0] < 1:
        raise TiffError("a TIFF file without bands")
    return tags


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, each width left one code early."""
    out, table, last = bytearray(), [], b""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    width, hold, held = 9, 0, 0
    for byte in data:
        hold, held = (hold << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code = (hold >> held) & ((1 << width) - 1)
        hold &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = base.copy(), 9, b""
            continue
        if not table:
            table = base.copy()
        if last:
            if code > len(table):
                raise TiffError("broken LZW data")
            now = table[code] if code < len(table) else last + last[:1]
            table.append(last + now[:1])
        else:
            now = table[code]
        out += now
        last = now
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, hold, held, width = bytearray(), 256, 9, 9
    known: dict[bytes, int] = {bytes([i]): i for i in range(256)}
    following, word = 258, b""

    def put(code: int) -> None:
        nonlocal hold, held
        hold, held = (hold << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append((hold >> held) & 255)
            hold &= (1 << held) - 1

    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in known:
            word = more
            continue
        put(known[word])
        known[more] = following
        following += 1
        word = data[i : i + 1]
        if following == 4094:
            put(256)
            known, following, width = {bytes([j]): j for j in range(256)}, 258, 9
        elif following >= 1 << width:
            width += 1
    if word:
        put(known[word])
        following += 1
        if following >= 1 << width and width < 12:
            width += 1
    put(257)
    if held:
        out.append((hold << (8 - held)) & 255)
    return bytes(out)


def _type(tags: dict) -> np.dtype:
    bits, kind = set(tags.get(BITS, (1,))), set(tags.get(SAMPLE, (1,)))
    if len(bits) > 1 or len(kind) > 1 or next(iter(bits)) % 8:
        raise TiffError("bands of unlike or broken widths")
    return np.dtype({1: "u", 2: "i", 3: "f"}.get(next(iter(kind)), "u") + str(next(iter(bits)) // 8))


def blocks(data: bytes, tags: dict | None = None) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first y, first x, first band, values (rows, columns, bands)) of each block of the first image."""
    tags = tags or header(data)
    width, height, bands = tags[WIDTH][0], tags[HEIGHT][0], tags.get(BANDS, (1,))[0]
    kind, apart, way = _type(tags), tags.get(PLANAR, (1,))[0] == 2, tags.get(COMPRESSION, (1,))[0]
    tiled = TILE_WIDTH in tags
    bw, bh = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(tags.get(STRIP_ROWS, (height,))[0], height))
    starts, sizes = (tags[TILE_AT], tags[TILE_BYTES]) if tiled else (tags[STRIP_AT], tags[STRIP_BYTES])
    across, down, depth = -(-width // bw), -(-height // bh), 1 if apart else bands
    for k, (at, size) in enumerate(zip(starts, sizes, strict=True)):
        raw = data[at : at + size]
        if way in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompress(raw)
        elif way == LZW:
            raw = unpack_lzw(raw)
        elif way != PLAIN:
            raise TiffError(f"compression {way} isn't supported")
        plane, rest = divmod(k, across * down)
        y, x = rest // across * bh, rest % across * bw
        rows = bh if tiled else min(bh, height - y)
        want = rows * bw * depth
        if len(raw) < want * kind.itemsize:
            raise TiffError("a block is too short")
        values = np.frombuffer(raw, kind.newbyteorder(tags["order"]), want).reshape(rows, bw, depth)
        if tags.get(PREDICTOR, (1,))[0] == 2:
            values = np.cumsum(values, axis=1, dtype=kind)
        elif tags.get(PREDICTOR, (1,))[0] != 1:
            raise TiffError("this predictor isn't supported")
        yield y, x, plane if apart else 0, values[: height - y, : width - x]


def transform(tags: dict) -> list[float] | None:
    """(a, b, c, d, e, f) with X = a x + b y + c and Y = d x + e y + f, from the scale and a tie point or the full matrix."""
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        return [m[0], m[1], m[3], m[4], m[5], m[7]]
    if SCALE not in tags or TIEPOINT not in tags:
        return None
    (sx, sy), (i, j, _, X, Y, _) = tags[SCALE][:2], tags[TIEPOINT][:6]
    return [sx, 0.0, X - i * sx, 0.0, -sy, Y + j * sy]


def epsg(tags: dict) -> str | None:
    """The projected or else the geographic system's code."""
    keys = tags.get(GEO_KEYS, ())
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = found.get(3072, found.get(2048))
    return None if code is None else f"EPSG:{code}"


_META = "raster_id string, crs string, transform array<double>, width int, height int, band_count int, dtype string, no_data string"
_PIXELS = pa.schema([("raster_id", pa.string()), ("band", pa.int32()), ("y", pa.int64()), ("x", pa.int64()), ("v", pa.float64())])


def _metas(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, data in zip(batch["path"], batch["content"], strict=True):
            t = header(data)
            rows.append((path, epsg(t), transform(t), t[WIDTH][0], t[HEIGHT][0], t.get(BANDS, (1,))[0], _type(t).name, t.get(NO_DATA)))
        yield pd.DataFrame(rows, columns=["raster_id", "crs", "transform", "width", "height", "band_count", "dtype", "no_data"])


def _pixels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            for y, x, band, values in blocks(content.as_py()):
                rows, columns, depth = values.shape
                step = max(1, 1 << 16 >> (columns - 1).bit_length())
                for first in range(0, rows, step):
                    part = values[first : first + step]
                    n = part.shape[0] * columns
                    ys = np.repeat(np.arange(y + first, y + first + part.shape[0]), columns)
                    xs = np.tile(np.arange(x, x + columns), part.shape[0])
                    for b in range(depth):
                        yield pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.repeat(pa.scalar(band + b + 1, pa.int32()), n), pa.array(ys), pa.array(xs), pa.array(part[:, :, b].reshape(-1).astype(float))], schema=_PIXELS)


def read_tiff(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One row of facts for each file under path, and (raster_id, band from 1, y, x, v) of its pixels.

    A missing path, a cut file and an unknown form fail. A file is read as one value, so it may have up to 2 GB.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_metas, _META), files.mapInArrow(_pixels, "raster_id string, band int, y long, x long, v double")


def _encoder(width: int, height: int, rows: int, bands: int, dtype: str, compression: str):
    kind = np.dtype(dtype)

    def encode(frame: pd.DataFrame) -> pd.DataFrame:
        strip = int(frame["strip"].iloc[0])
        block = np.zeros((min(rows, height - strip * rows), width, bands), kind)
        at = (frame["y"].to_numpy() - strip * rows, frame["x"].to_numpy())
        for b in range(bands):
            v = frame[f"v{b}"].to_numpy(float)
            if kind.kind != "f":
                limits = np.iinfo(kind)
                v = np.clip(np.trunc(np.nan_to_num(v)), limits.min, limits.max)
            block[(*at, b)] = v
        raw = block.astype(kind.newbyteorder("<")).tobytes()
        data = {"none": lambda d: d, "deflate": zlib.compress, "lzw": pack_lzw}[compression](raw)
        return pd.DataFrame({"strip": [strip], "bytes": [len(data)], "data": [data]})

    return encode


def write_tiff(pixels: DataFrame, columns: list[str], path: str, width: int, height: int, dtype: str = "uint16", compression: str = "lzw", affine: list[float] | None = None, crs: str | None = None, strip_bytes: int = 1 << 18) -> str:
    """One GeoTIFF of the columns of pixels (y, x, ...), as bands in that order; missing pixels and nulls are 0.

    Values are cut to the type's range and cut off, not rounded. The driver holds one encoded strip at a time, and the
    lengths of all. affine keeps (a, 0, c, 0, -e, f) forms; crs an EPSG code.
    """
    kind, bands = np.dtype(dtype), len(columns)
    rows = max(1, min(height, strip_bytes // (width * bands * kind.itemsize) or 1))
    count = -(-height // rows)
    spark = pixels.sparkSession
    frame = pixels.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).select(F.expr(f"y div {rows}").alias("strip"), "y", "x", *[F.col(c).cast("double").alias(f"v{b}") for b, c in enumerate(columns)])
    every = spark.range(count).select(F.col("id").alias("strip"), (F.col("id") * rows).alias("y"), F.lit(0).cast("long").alias("x"), *[F.lit(None).cast("double").alias(f"v{b}") for b in range(bands)])
    every = every.join(frame.select("strip").distinct(), "strip", "left_anti")  # a strip without any pixel is written as zeros
    strips = written(frame.unionByName(every).groupBy("strip").applyInPandas(_encoder(width, height, rows, bands, dtype, compression.lower()), "strip long, bytes long, data binary"))
    sizes = [r[0] for r in strips.select("strip", "bytes").orderBy("strip").select("bytes").collect()]
    fields = [(WIDTH, "I", (width,)), (HEIGHT, "I", (height,)), (BITS, "H", (kind.itemsize * 8,) * bands), (COMPRESSION, "H", ({"none": PLAIN, "lzw": LZW, "deflate": DEFLATE}[compression.lower()],)), (PHOTOMETRIC, "H", (1,)), (STRIP_AT, "Q", (0,) * count), (BANDS, "H", (bands,)), (STRIP_ROWS, "I", (rows,)), (STRIP_BYTES, "Q", tuple(sizes)), (PLANAR, "H", (1,)), (SAMPLE, "H", ({"u": 1, "i": 2, "f": 3}[kind.kind],) * bands)]
    if affine is not None:
        fields += [(SCALE, "d", (affine[0], -affine[4], 0.0)), (TIEPOINT, "d", (0.0, 0.0, 0.0, affine[2], affine[5], 0.0))]
    if crs is not None:
        code = int(crs.split(":")[1])
        flat = 4000 <= code < 5000
        fields += [(GEO_KEYS, "H", (1, 1, 0, 3, 1024, 0, 1, 2 if flat else 1, 1025, 0, 1, 1, 2048 if flat else 3072, 0, 1, code))]
    head = _directory(fields, sizes)
    ordered = strips.orderBy("strip").select("data").toLocalIterator()
    return write_bytes(spark, path, (part for rows_ in ([head], (bytes(r[0]) for r in ordered)) for part in rows_))


def _directory(fields: list, sizes: list[int]) -> bytes:
    """A 64-bit header and its one directory, which end where the first strip begins."""
    size = lambda code, values: struct.calcsize(f"<{len(values)}{code}")
    extra_at = 16 + 8 + 20 * len(fields) + 8
    first = extra_at + sum(-(-size(c, v) // 8) * 8 for _, c, v in fields if size(c, v) > 8)
    starts = tuple(int(v) for v in first + np.concatenate([[0], np.cumsum(sizes[:-1], dtype=np.int64)]))
    entries, extra = b"", b""
    number = {"H": 3, "I": 4, "d": 12, "Q": 16}
    for tag, code, values in sorted(fields):
        raw = struct.pack(f"<{len(values)}{code}", *(starts if tag == STRIP_AT else values))
        if len(raw) > 8:
            cell = struct.pack("<Q", extra_at + len(extra))
            extra += raw + b"\0" * (-len(raw) % 8)
        else:
            cell = raw.ljust(8, b"\0")
        entries += struct.pack("<HHQ", tag, number[code], len(values)) + cell
    return b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) + struct.pack("<Q", len(fields)) + entries + struct.pack("<Q", 0) + extra
