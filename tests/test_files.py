import datetime as dt
import struct
import zlib

import numpy as np
import pytest

from clearstack.sources import files, png, tiff


def _rows(spark, values):
    h, w, n = values.shape
    return spark.createDataFrame([(y, x, *map(float, values[y, x])) for y in range(h) for x in range(w)], "y long, x long, " + ", ".join(f"b{i} double" for i in range(n)))


@pytest.mark.parametrize("compression", ["lzw", "deflate", "none"])
def test_tiff_round_trip(spark, tmp_path, compression):
    values = np.random.default_rng(1).integers(0, 400, (37, 90, 2)) * 5
    path = f"file://{tmp_path}/a.tif"
    affine = [10.0, 0.0, 500000.0, 0.0, -10.0, 4400000.0]
    tiff.write_tiff(_rows(spark, values), ["b0", "b1"], path, 90, 37, compression=compression, affine=affine, crs="EPSG:32633", strip_bytes=2000)
    meta, pixels = tiff.read_tiff(spark, path)
    m = meta.first()
    assert (m.width, m.height, m.band_count, m.dtype, m.crs, list(m.transform)) == (90, 37, 2, "uint16", "EPSG:32633", affine)
    back = np.zeros_like(values)
    rows = pixels.collect()
    assert len(rows) == values.size
    for r in rows:
        back[r.y, r.x, r.band - 1] = r.v
    assert (back == values).all()


def test_lzw_over_many_tables():
    for data in (b"", b"a" * 100000, np.random.default_rng(2).integers(0, 7, 60000).astype(np.uint8).tobytes(), np.random.default_rng(3).bytes(30000)):
        assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data
    for n in range(1, 4200):  # every table size at the end of the data
        data = struct.pack(f">{n}H", *range(n))
        assert tiff.unpack_lzw(tiff.pack_lzw(data[: n + 1])) == data[: n + 1]


def test_classic_tiled_big_endian():
    a = np.arange(20 * 20, dtype=">u2").reshape(20, 20)
    tiles = [np.zeros((16, 16), ">u2") for _ in range(4)]
    for k, t in enumerate(tiles):
        part = a[k // 2 * 16 : k // 2 * 16 + 16, k % 2 * 16 : k % 2 * 16 + 16]
        t[: part.shape[0], : part.shape[1]] = part
    packed = [zlib.compress(np.diff(t.astype(np.int64), axis=1, prepend=0).astype(">u2").tobytes()) for t in tiles]
    at = 8 + sum(map(len, packed))
    at += at % 2
    starts = [8 + sum(map(len, packed[:i])) for i in range(4)]
    fields = [(256, 3, [20]), (257, 3, [20]), (258, 3, [16]), (259, 3, [8]), (317, 3, [2]), (322, 3, [16]), (323, 3, [16]), (324, 4, starts), (325, 4, [len(p) for p in packed])]
    extra_at, entries, extra = at + 2 + 12 * len(fields) + 4, b"", b""
    for tag, kind, v in fields:
        raw = struct.pack(f">{len(v)}{'H' if kind == 3 else 'I'}", *v)
        cell = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">I", extra_at + len(extra))
        extra += raw if len(raw) > 4 else b""
        entries += struct.pack(">HHI", tag, kind, len(v)) + cell
    data = (b"MM" + struct.pack(">HI", 42, at) + b"".join(packed)).ljust(at, b"\0") + struct.pack(">H", len(fields)) + entries + b"\0" * 4 + extra
    back = np.zeros((20, 20), int)
    for y, x, _, v in tiff.blocks(data):
        back[y : y + v.shape[0], x : x + v.shape[1]] = v[:, :, 0]
    assert (back == a).all()


def test_broken_and_missing_files(spark, tmp_path):
    for data in (b"", b"II*\0", b"nonsense", b"II" + struct.pack("<HI", 42, 5000)):
        with pytest.raises(tiff.TiffError):
            tiff.header(data)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tiff.read_tiff(spark, f"file://{tmp_path}/none.tif")


def _open_png(path):
    data = path.read_bytes()
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack_from(">I", data, at + 8 + n)[0] == zlib.crc32(kind + part)
        if kind == b"IHDR":
            w, h, _, colour = struct.unpack_from(">IIBB", part)
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, -1)  # checks the sum, too
    return raw[:, 1:].reshape(h, w, 3 if colour == 2 else 1)


def test_png(spark, tmp_path):
    values = np.random.default_rng(4).integers(0, 3000, (30, 20, 3))
    png.write_png(_rows(spark, values), ["b0", "b1", "b2"], f"file://{tmp_path}/a.png", 20, 30, strip_bytes=300)
    got = _open_png(tmp_path / "a.png")
    want = np.stack([np.trunc(np.clip(values[:, :, i] / np.percentile(values[:, :, i], 99), 0, 1) * 255) for i in range(3)], axis=2)
    assert (got == want).all()
    mask = _rows(spark, values).selectExpr("y", "x", "b0 > 1000 AS m").where("y < 25")  # rows without pixels are black
    png.write_png(mask, ["m"], f"file://{tmp_path}/m.png", 20, 30, strip_bytes=100)
    want = (values[:, :, :1] > 1000) * 255
    want[25:] = 0
    assert (_open_png(tmp_path / "m.png") == want).all()
    png.write_png(mask, ["m"], f"file://{tmp_path}/r.png", 20, 30, ramp=True)
    assert {tuple(p) for p in _open_png(tmp_path / "r.png").reshape(-1, 3)} <= {png.RAMP[0], png.RAMP[-1]}


def test_run_folders(spark, tmp_path):
    now = dt.datetime(2024, 5, 6, 7, 8, 9)
    names = [files.RunFolder(spark, f"file://{tmp_path}", now).folder.rsplit("/", 1)[1] for _ in range(3)]
    assert names == ["run_20240506_070809", "run_20240506_070809_1", "run_20240506_070809_2"]
    assert (tmp_path / names[2] / "03_downloaded_images").is_dir()
