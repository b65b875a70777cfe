"""Elevation tiles in GeoTIFF files as the tables that the terrain operators take.

A file is one tile: its task decodes it and hands its cells on, some rows at a time. Files come
through Spark's ``binaryFile`` reader, or are fetched by tasks into a folder where a file that
is there isn't fetched again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers of TIFF's tags, and sizes and letters of its field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, FORMAT = 317, 322, 323, 324, 325, 339
SCALE, TIE, KEYS, NODATA = 33550, 33922, 34735, 42113
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
#: The geo key that says what a tie point is of, and its value for a cell's middle.
RASTER_TYPE, MIDDLE = 1025, 2
#: Rows of cells that a task hands on at once.
ROWS = 128


def tags(blob: bytes) -> dict[int, tuple]:
    """The fields of the first image."""
    order = {b"II": "<", b"MM": ">"}.get(blob[:2])
    if order is None or struct.unpack(f"{order}H", blob[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(f"{order}I", blob[4:8])[0]
    found: dict[int, tuple] = {0: (order,)}
    for k in range(struct.unpack(f"{order}H", blob[at : at + 2])[0]):
        entry = at + 2 + 12 * k
        tag, kind, n = struct.unpack(f"{order}HHI", blob[entry : entry + 8])
        if kind not in FIELDS:
            continue
        size = struct.calcsize(FIELDS[kind]) * n
        where = entry + 8 if size <= 4 else struct.unpack(f"{order}I", blob[entry + 8 : entry + 12])[0]
        found[tag] = (blob[where : where + size],) if kind == 2 else struct.unpack(f"{order}{n}{FIELDS[kind]}", blob[where : where + size])
    return found


def frame(found: dict[int, tuple]) -> tuple[float, float, float, int, int]:
    """West and north of the corner of cell (0, 0), the cell's size, rows and columns."""
    if SCALE not in found or TIE not in found:
        raise ValueError("the file doesn't say where it lies")
    (dx, dy), (column, row, _, x, y) = found[SCALE][:2], found[TIE][:5]
    if abs(dx - dy) > 1e-9 * dx:
        raise ValueError("cells aren't square")
    keys = found.get(KEYS, ())
    middle = any(keys[k] == RASTER_TYPE and keys[k + 3] == MIDDLE for k in range(4, len(keys) - 3, 4))
    shift = 0.5 if middle else 0.0
    return x - (column + shift) * dx, y + (row + shift) * dy, dx, found[HEIGHT][0], found[WIDTH][0]


def _block(raw: bytes, rows: int, cols: int, found: dict[int, tuple]) -> np.ndarray:
    """One strip or tile of the image."""
    order, bits, kind = found[0][0], found[BITS][0], found.get(FORMAT, (1,))[0]
    packed = found.get(COMPRESSION, (1,))[0]
    if packed in (8, 32946):
        raw = zlib.decompress(raw)
    elif packed != 1:
        raise ValueError(f"compression {packed}")
    size, predictor = bits // 8, found.get(PREDICTOR, (1,))[0]
    if predictor == 3:
        # Each row holds the first bytes of all its numbers, then the second ones, as differences.
        summed = np.cumsum(np.frombuffer(raw, np.uint8, rows * cols * size).reshape(rows, cols * size), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(summed.reshape(rows, size, cols).transpose(0, 2, 1)).view(f">f{size}").reshape(rows, cols).astype(float)
    letter = {1: "u", 2: "i", 3: "f"}[kind]
    values = np.frombuffer(raw, f"{order}{letter}{size}", rows * cols).reshape(rows, cols)
    return (np.cumsum(values, axis=1, dtype=values.dtype) if predictor == 2 else values).astype(float)


def decode(blob: bytes) -> tuple[np.ndarray, tuple[float, float, float, int, int]]:
    """Heights, NaN where there are none, and the frame. One band, plain or deflated, in strips or tiles."""
    found = tags(blob)
    if found.get(SAMPLES, (1,))[0] != 1:
        raise ValueError("more than one band")
    at = frame(found)
    rows, cols = at[3:]
    tiled = TILE_AT in found
    high, wide = (found[TILE_HEIGHT][0], found[TILE_WIDTH][0]) if tiled else (min(found.get(STRIP_ROWS, (rows,))[0], rows), cols)
    grid = np.full((rows, cols), np.nan)
    across = -(-cols // wide)
    for k, (start, size) in enumerate(zip(found[TILE_AT if tiled else STRIP_AT], found[TILE_SIZE if tiled else STRIP_SIZE], strict=True)):
        r, c = k // across * high, k % across * wide
        held = high if tiled else min(high, rows - r)
        part = _block(blob[start : start + size], held, wide, found)
        grid[r : r + held, c : c + wide] = part[: rows - r, : cols - c]
    if NODATA in found:
        grid[grid == float(found[NODATA][0].split(b"\0")[0])] = np.nan
    return grid, at


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``cells`` (``tile``, ``r``, ``c``, ``z``, without those that have no height) and ``frames`` (``tile``, ``west``, ``north``, ``cell``, ``rows``, ``cols``) of GeoTIFF files.

    A tile is named after its file. A file that can't be decoded stops the job, and says which it is.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("tile"), "content")

    def each(pdf: pd.DataFrame) -> Iterator[tuple[str, bytes]]:
        yield from zip(pdf["tile"], pdf["content"], strict=True)

    def told(name: str, call):
        try:
            return call()
        except Exception as e:
            raise ValueError(f"{name}: {e}") from e

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, blob in each(pdf):
                grid, _ = told(name, lambda blob=blob: decode(blob))
                for k in range(0, len(grid), ROWS):
                    r, c = np.nonzero(~np.isnan(grid[k : k + ROWS]))
                    yield pd.DataFrame({"tile": name, "r": (r + k).astype("int32"), "c": c.astype("int32"), "z": grid[r + k, c]})

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(name, *told(name, lambda blob=blob: frame(tags(blob)))) for name, blob in each(pdf)]
            yield pd.DataFrame(rows, columns=["tile", "west", "north", "cell", "rows", "cols"]).astype({"rows": "int32", "cols": "int32"})

    return files.mapInPandas(cells, "tile string, r int, c int, z double"), files.mapInPandas(frames, "tile string, west double, north double, cell double, rows int, cols int")


def fetch(tiles: DataFrame, url: str, folder: str) -> DataFrame:
    """``tile``, ``file``, ``error``: fetches each of ``tiles`` from ``url`` (``{tile}`` stands for its name) into ``folder``, by tasks.

    A file that is there isn't fetched again; one appears only when it is whole. A tile that the
    store doesn't have, as over the sea, or whose fetch fails, says so, and the others go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import urllib.request
        import uuid

        import pyarrow.fs

        store, base = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for pdf in batches:
            out = []
            for name in pdf["tile"]:
                file, error = f"{base}/{name}.tif", None
                try:
                    if store.get_file_info(file).type == pyarrow.fs.FileType.NotFound:
                        with urllib.request.urlopen(url.replace("{tile}", name), timeout=120) as answer:
                            body = answer.read()
                        tags(body)
                        store.create_dir(base, recursive=True)
                        part = f"{base}/.{name}-{uuid.uuid4().hex}"
                        with store.open_output_stream(part) as f:
                            f.write(body)
                        store.move(part, file)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                out.append((name, None if error else file, error))
            yield pd.DataFrame(out, columns=["tile", "file", "error"])

    return tiles.select("tile").distinct().mapInPandas(run, "tile string, file string, error string")
