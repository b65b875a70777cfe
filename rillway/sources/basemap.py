"""Map tiles as a table of pixels, and places on the ground that take their colour from it.

Tiles are PNG files of a Web Mercator pyramid whose paths end in ``zoom/column/row.png``. Pixels
count from the pyramid's north-west corner over all tiles of a zoom, so a place between four
pixels finds them by an equi-join, whichever tiles they are of.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels along a tile's side.
SIDE = 256
#: PNG's numbers of channels by colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(rows: np.ndarray, kinds: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes without PNG's filters; ``width``: bytes of a pixel."""
    out = np.zeros((len(rows) + 1, rows.shape[1]), dtype=np.uint8)
    for k, (row, kind) in enumerate(zip(rows, kinds.tolist(), strict=True)):
        above = out[k]
        if kind == 0:
            out[k + 1] = row
        elif kind == 1:
            out[k + 1] = np.cumsum(row.reshape(-1, width), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[k + 1] = row + above
        elif kind in (3, 4):
            raw, up, got = row.tolist(), above.tolist(), [0] * len(row)
            for i, x in enumerate(raw):
                left, corner = (got[i - width], up[i - width]) if i >= width else (0, 0)
                if kind == 3:
                    guess = (left + up[i]) // 2
                else:
                    base = left + up[i] - corner
                    near = abs(base - left), abs(base - up[i]), abs(base - corner)
                    guess = (left, up[i], corner)[near.index(min(near))]
                got[i] = (x + guess) & 255
            out[k + 1] = got
        else:
            raise ValueError(f"PNG filter {kind}")
    return out[1:]


def decode(blob: bytes) -> np.ndarray:
    """Rows x columns x 3 of a PNG image with eight bits a channel, not interlaced."""
    if blob[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, data, palette, head = 8, b"", None, None
    while at < len(blob):
        size, kind = struct.unpack(">I4s", blob[at : at + 8])
        body = blob[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("PNG images need eight bits a channel and no interlacing")
    cols, rows, colour, n = head[0], head[1], head[3], CHANNELS[head[3]]
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(rows, 1 + cols * n)
    pixels = _unfiltered(lines[:, 1:], lines[:, 0], n).reshape(rows, cols, n)
    if colour == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if colour in (0, 4) else pixels[..., :3]


def read(spark: SparkSession, path: str) -> DataFrame:
    """``zoom``, ``y``, ``x``, ``red``, ``green``, ``blue``: the pixels of all tiles under ``path``; a tile that can't be decoded is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path)
    place = [F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.png$", k).alias(c) for k, c in ((1, "zoom"), (2, "tx"), (3, "ty"))]
    named = files.select(*place, "content").filter("zoom <> ''").select(*[F.col(c).cast("int") for c in ("zoom", "tx", "ty")], "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for zoom, tx, ty, blob in zip(pdf["zoom"], pdf["tx"], pdf["ty"], pdf["content"], strict=True):
                try:
                    image = decode(blob).astype("int32")
                except (ValueError, TypeError, zlib.error, struct.error):
                    continue
                r, c = np.indices(image.shape[:2]).reshape(2, -1)
                yield pd.DataFrame({"zoom": np.int32(zoom), "y": (ty * SIDE + r).astype("int32"), "x": (tx * SIDE + c).astype("int32"), "red": image[..., 0].ravel(), "green": image[..., 1].ravel(), "blue": image[..., 2].ravel()})

    return named.mapInPandas(run, "zoom int, y int, x int, red int, green int, blue int")


def pixel_at(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """Where a place lies among a zoom's pixels: row and column, whole at pixels' middles."""
    whole = F.pow(F.lit(2.0), zoom) * SIDE
    return (1.0 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2.0 * whole - 0.5, (lon + 180.0) / 360.0 * whole - 0.5


def coloured(places: DataFrame, pixels: DataFrame, zoom: int, keys: list[str]) -> DataFrame:
    """``keys`` of ``places`` (unique; with ``lon``, ``lat``) and ``red``, ``green``, ``blue`` between the four pixels around each, if all are there."""
    y, x = pixel_at(F.col("lon"), F.col("lat"), F.lit(zoom))
    at = places.select(*keys, y.alias("_y"), x.alias("_x")).withColumns({"_r": F.floor("_y").cast("int"), "_c": F.floor("_x").cast("int")})
    u, v = F.col("_y") - F.col("_r"), F.col("_x") - F.col("_c")
    corner = lambda dr, dc: F.struct((F.col("_r") + dr).alias("y"), (F.col("_c") + dc).alias("x"), ((u if dr else 1 - u) * (v if dc else 1 - v)).alias("w"))
    around = at.select(*keys, F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).alias("p")).select(*keys, "p.*")
    met = around.join(pixels.filter(F.col("zoom") == zoom), ["y", "x"])
    found = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("red", "green", "blue")])
    return found.filter("_n = 4").drop("_n")
