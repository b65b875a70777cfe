"""Elevation files written by hand in every form that is read, and fetched with a cache."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillway import flows
from rillway.sources import dem
from rillway.sources import geotiff as G


def tiff(grid, west, north, cell, tile=None, deflate=False, predictor=1, kind="<f4", middle=False, nodata=None, samples=1):
    """A one-band file with the blocks, packing and predictor that are asked for."""
    rows, cols = grid.shape
    high, wide = tile or (5, cols)
    blocks = []
    for r in range(0, rows, high):
        for c in range(0, cols, wide):
            part = np.zeros((high, wide)) if tile else np.zeros((min(high, rows - r), wide))
            inner = grid[r : r + high, c : c + wide]
            part[: inner.shape[0], : inner.shape[1]] = inner
            values = part.astype(kind)
            if predictor == 2:
                values = np.diff(values, axis=1, prepend=values.dtype.type(0)).astype(kind)
            raw = values.tobytes()
            if predictor == 3:
                size = values.dtype.itemsize
                planes = values.astype(f">f{size}").view(np.uint8).reshape(*part.shape, size).transpose(0, 2, 1).reshape(part.shape[0], -1)
                raw = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
            blocks.append(zlib.compress(raw) if deflate else raw)
    order, at = kind[0], 8
    starts = []
    for b in blocks:
        starts.append(at)
        at += len(b)
    body = b"".join(blocks)
    shift = 0.5 if middle else 0.0
    form = {"f": 3, "i": 2, "u": 1}[kind[1]]
    fields = [(256, "H", [cols]), (257, "H", [rows]), (258, "H", [np.dtype(kind).itemsize * 8]), (259, "H", [8 if deflate else 1]), (277, "H", [samples]), (317, "H", [predictor]), (339, "H", [form])]
    fields += [(322, "H", [wide]), (323, "H", [high]), (324, "I", starts), (325, "I", [len(b) for b in blocks])] if tile else [(273, "I", starts), (278, "H", [high]), (279, "I", [len(b) for b in blocks])]
    fields += [(33550, "d", [cell, cell, 0.0]), (33922, "d", [0.0, 0.0, 0.0, west + shift * cell, north - shift * cell, 0.0]), (34735, "H", [1, 1, 0, 1, 1025, 0, 1, 2 if middle else 1])]
    fields += [(42113, "s", nodata)] if nodata else []
    code = {"H": 3, "I": 4, "d": 12, "s": 2}
    head, extra, more = b"", b"", 8 + len(body) + 2 + 12 * len(fields) + 4
    for tag, letter, values in sorted(fields):
        raw = values if letter == "s" else struct.pack(f"{order}{len(values)}{letter}", *values)
        n = len(values)
        if len(raw) <= 4:
            head += struct.pack(f"{order}HHI", tag, code[letter], n) + raw.ljust(4, b"\0")
        else:
            head += struct.pack(f"{order}HHII", tag, code[letter], n, more + len(extra))
            extra += raw
    return (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8 + len(body)) + body + struct.pack(f"{order}H", len(fields)) + head + b"\0\0\0\0" + extra


FORMS = [{}, {"tile": (16, 16)}, {"deflate": True}, {"tile": (16, 16), "deflate": True, "predictor": 3}, {"kind": "<i2", "predictor": 2, "deflate": True}, {"kind": ">f4", "tile": (16, 32)}, {"kind": ">i2"}, {"kind": "<f8", "predictor": 3}, {"middle": True}]


@pytest.mark.parametrize("form", FORMS)
def test_forms(form):
    grid = np.random.default_rng(4).integers(-50, 3000, (23, 37)).astype(float)
    got, at = G.decode(tiff(grid, 1.0, 43.0, 0.001, **form))
    assert (got == grid).all() and at[3:] == (23, 37) and at[:3] == pytest.approx((1.0, 43.0, 0.001))


def test_what_is_refused():
    grid = np.ones((4, 4))
    grid[1, 2] = -9999
    assert np.isnan(G.decode(tiff(grid, 0, 0, 1, nodata=b"-9999\0"))[0][1, 2])
    for blob, why in ((b"GIF89a" + bytes(20), "not a TIFF"), (tiff(grid, 0, 0, 1, samples=3), "band"), (tiff(grid, 0, 0, 1).replace(struct.pack("<HHI", 259, 3, 1) + b"\x01", struct.pack("<HHI", 259, 3, 1) + b"\x05"), "compression 5")):
        with pytest.raises(ValueError, match=why):
            G.decode(blob)


def test_fetch_read_delineate(spark, tmp_path):
    # A valley over two files of a store; a third tile isn't there, a fourth one is broken.
    shop, cell = tmp_path / "shop", 0.001
    shop.mkdir()
    r, c = np.mgrid[0:60, 0:41]
    z = 900.0 - 4 * r + 10 * abs(c - 20)
    (shop / "N42.tif").write_bytes(tiff(z[:30], 1.0, 43.0, cell, tile=(16, 16), deflate=True, predictor=3))
    (shop / "N41.tif").write_bytes(tiff(z[30:], 1.0, 42.97, cell, middle=True))
    (shop / "bad.tif").write_bytes(b"<html>busy</html>")
    tiles = spark.createDataFrame([("N42",), ("N41",), ("sea",), ("bad",), ("N42",)], "tile string")
    cache = f"file://{tmp_path}/cache"
    got = {x.tile: x for x in G.fetch(tiles, f"file://{shop}/{{tile}}.tif", cache).collect()}
    assert got["N42"].error is None and got["N41"].file.endswith("N41.tif") and "URLError" in got["sea"].error and "not a TIFF" in got["bad"].error
    (shop / "N42.tif").unlink()
    assert G.fetch(tiles.filter("tile = 'N42'"), f"file://{shop}/{{tile}}.tif", cache).first().error is None
    assert sorted(p.name for p in (tmp_path / "cache").iterdir()) == ["N41.tif", "N42.tif"]
    cells, frames = G.read(spark, cache)
    assert cells.count() == 60 * 41 and {(x.tile, round(x.north, 6), x.rows) for x in frames.collect()} == {("N42", 43.0, 30), ("N41", 42.97, 30)}
    at = lambda r, c: {"lon": 1 + (c + 0.5) * cell, "lat": 43 - (r + 0.5) * cell}
    schema = "cleabs string, ini string, fin string, sens string, ord string, river_key string, toponyme string, fictif boolean, length_m double, line array<struct<lon:double,lat:double>>"
    river = spark.createDataFrame([("v1", "a", "b", "Sens direct", "1", "RV_V", "Val", False, 3000.0, [at(4, 20), at(8, 4), at(12, 36), at(16, 20), at(56, 20)])], schema)
    found = flows.delineate(river, cells, frames, ["Val"], offsets=(0,), thresholds=(15,)).first()
    assert found.source == "dem" and found.frac > 0.95 and found.n_cells > 30 * 30
    with pytest.raises(Exception, match="broken: not a TIFF"):
        (tmp_path / "cache" / "broken.tif").write_bytes(b"no")
        G.read(spark, cache)[1].collect()


def test_tiles_of_a_box(spark):
    boxes = spark.createDataFrame([(0.3, 42.95, 0.35, 43.05), (-1.2, -0.5, -0.9, 0.0)], "west double, south double, east double, north double")
    assert {x.tile for x in dem.tile_name(dem.tile_grid(boxes)).select(F.col("tile")).collect()} == {"N42_00_E000_00", "N43_00_E000_00", "S01_00_W002_00", "S01_00_W001_00"}
