"""Map tiles: PNG images written with every filter, pixels as a table, and colours of places."""

import base64
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillway.functions import terrain
from rillway.operators import delineate as D
from rillway.sources import basemap as B


def png(pixels, colour, filters, palette=None):
    """An image whose rows take the filters in turn."""
    rows, cols, n = pixels.shape
    body, above = b"", np.zeros(cols * n, dtype=np.int64)
    for k, row in enumerate(pixels.reshape(rows, cols * n).astype(np.int64)):
        kind = filters[k % len(filters)]
        left, corner = np.r_[np.zeros(n, int), row[:-n]], np.r_[np.zeros(n, int), above[:-n]]
        base = left + above - corner
        near = np.abs(np.stack([base - left, base - above, base - corner])).argmin(axis=0)
        guess = [0, left, above, (left + above) // 2, np.choose(near, [left, above, corner])][kind]
        body += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(body)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, colour, 0, 0, 0)) + (part(b"PLTE", palette.tobytes()) if palette is not None else b"") + part(b"IDAT", packed[:50]) + part(b"IDAT", packed[50:]) + part(b"IEND", b"")


@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [4, 2, 0, 3, 1]])
def test_filters_and_colours(filters):
    rng = np.random.default_rng(2)
    for colour, n in B.CHANNELS.items():
        pixels, palette = rng.integers(0, 256, (9, 7, n), dtype=np.uint8), None
        want = pixels[..., :3] if n > 2 else np.repeat(pixels[..., :1], 3, axis=2)
        if colour == 3:
            palette = rng.integers(0, 256, (256, 3), dtype=np.uint8)
            want = palette[pixels[..., 0]]
        assert (B.decode(png(pixels, colour, filters, palette)) == want).all()
    assert (B.decode(terrain.png(rng.integers(0, 256, (4, 5, 4), dtype=np.uint8))).shape) == (4, 5, 3)


def test_pixels_and_places(spark, tmp_path):
    rng = np.random.default_rng(5)
    whole = rng.integers(0, 256, (512, 512, 3), dtype=np.uint8)
    for tx in (0, 1):
        (tmp_path / "1" / str(tx)).mkdir(parents=True)
        for ty in (0, 1):
            (tmp_path / "1" / str(tx) / f"{ty}.png").write_bytes(png(whole[ty * 256 : ty * 256 + 256, tx * 256 : tx * 256 + 256], 2, [1, 2]))
    (tmp_path / "1" / "1" / "7.png").write_bytes(b"busy")
    pixels = B.read(spark, f"file://{tmp_path}")
    assert pixels.count() == 512 * 512
    # Places all over the map, some in the middle of four tiles; the outermost half pixel has no four around it.
    lon, lat = rng.uniform(-179, 179, 60), rng.uniform(-84, 84, 60)
    lon[:2], lat[:2] = [0.0, 0.01], [0.0, -0.01]
    places = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(zip(lon, lat, strict=True))], "k int, lon double, lat double")
    radius = np.pi * 6378137.0
    for r in B.coloured(places, pixels, 1, ["k"]).collect():
        box = {"west": lon[r.k] - 1e-9, "east": lon[r.k] + 1e-9, "south": lat[r.k] - 1e-9, "north": lat[r.k] + 1e-9}
        want = terrain.warp(whole, (-radius, -radius, radius, radius), box, 1, 1)[0, 0]
        assert np.abs(np.array([r.red, r.green, r.blue]) - want).max() < 1e-3
    assert B.coloured(places, pixels.filter("x < 256"), 1, ["k"]).filter("k < 2").count() == 0


def test_payload_with_basemap(spark):
    cell, zoom = 0.01, 8
    tiles = spark.createDataFrame([("t", r, c, 100.0 + r + c) for r in range(40) for c in range(40)], "tile string, r int, c int, z double")
    frames = spark.createDataFrame([("t", 1.0, 43.0, cell, 40, 40)], "tile string, west double, north double, cell double, rows int, cols int")
    p = lambda x, y: {"lon": 1.0 + x * cell, "lat": 43.0 - y * cell}
    ring = [p(15, 15), p(24, 15), p(24, 24), p(15, 24), p(15, 15)]
    rivers = spark.createDataFrame([("a", [ring])], "river_id string, rings array<array<struct<lon:double,lat:double>>>")
    streams = spark.createDataFrame([("a", ring[:2])], "river_id string, line array<struct<lon:double,lat:double>>")
    y, x = (int(spark.range(1).select(v).first()[0]) for v in B.pixel_at(F.lit(1.2), F.lit(42.8), F.lit(zoom)))
    pixels = spark.range(6400).select(F.lit(zoom).alias("zoom"), (F.expr("cast(id div 80 as int)") + (y - 40)).alias("y"), (F.expr("cast(id % 80 as int)") + (x - 40)).alias("x"), F.lit(10).alias("red"), F.lit(200).alias("green"), F.lit(30).alias("blue"))
    made = json.loads(D.payloads(tiles, frames, rivers, streams, pixels=pixels, zoom=zoom).first().payload)
    image = B.decode(base64.b64decode(made["basemap"].split(",")[1]))
    assert image.shape == (made["meta"]["rows"], made["meta"]["cols"], 3) and (image[image.shape[0] // 2, image.shape[1] // 2] == [10, 200, 30]).all()
    assert "basemap" not in json.loads(D.payloads(tiles, frames, rivers, streams, pixels=pixels.filter("x % 2 = 0"), zoom=zoom).first().payload)
