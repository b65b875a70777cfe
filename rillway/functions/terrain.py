"""Numpy kernels of a river's drawn terrain: clipped heights, shading, height map, draped lines, contours."""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np

from rillway.functions import delineation, geo, kernels

#: Fixed values, as are the keys of ``clip``'s facts and of ``payload``, which a viewer reads: light and weight of the relief, metres between contours and between those drawn strongly, cells around a catchment.
AZIMUTH, ALTITUDE, SLOPE_WEIGHT = 315.0, 45.0, 0.55
INTERVAL_M, INDEX_M, APRON, MARGIN, DECIMALS = 20, 100, 6, 0.05, 5


def gradient(z: np.ndarray, dx: float, dy: float) -> tuple[np.ndarray, np.ndarray]:
    """Rise to the east and to the north, in metres a metre."""
    return (np.gradient(z, dx, axis=1) if z.shape[1] > 1 else np.zeros_like(z)), (-np.gradient(z, dy, axis=0) if z.shape[0] > 1 else np.zeros_like(z))


def shaded(grid: np.ndarray, dx: float, dy: float, azimuth: float = AZIMUTH, altitude: float = ALTITUDE) -> dict[str, np.ndarray]:
    """``hillshade``, ``slope``, ``core`` (turned away from the sun) and ``cast`` (hidden from it, though not turned away)."""
    z = kernels.fill_nan(grid)
    east, north = gradient(z, dx, dy)
    a, h = np.radians(azimuth), np.radians(altitude)
    sun = np.sin(a) * np.cos(h), np.cos(a) * np.cos(h), np.sin(h)
    light = (sun[2] - east * sun[0] - north * sun[1]) / np.sqrt(east**2 + north**2 + 1)
    core = light <= 0
    hidden = kernels.cast_shadow(grid, azimuth, altitude, dx, dy)
    return {"hillshade": np.clip(light, 0, 1), "slope": np.arctan(np.hypot(east, north)) / (np.pi / 2), "core": core, "cast": hidden & ~core}


def composed(hillshade: np.ndarray, slope: np.ndarray, weight: float = SLOPE_WEIGHT) -> np.ndarray:
    return hillshade if weight == 0 else np.clip((1 - weight) * hillshade + weight * (1 - slope), 0, 1)


def clip(grid: np.ndarray, rings: list[np.ndarray], west: float, north: float, cell: float, span: tuple[float, float], apron: int = APRON, exaggeration: float = 1.0) -> tuple[np.ndarray, dict]:
    """Heights within a catchment and an apron around it, NaN elsewhere, and what a viewer must know of them; ``span``: the least and largest height of the whole terrain."""
    mask = np.zeros(grid.shape, dtype=bool)
    for ring in rings:
        mask |= delineation.ring_mask(ring, grid.shape, west, north, cell)
    mask = delineation.dilated(mask, apron) & ~np.isnan(grid)
    if not mask.any():
        raise ValueError("the catchment has no cell in the terrain")
    r, c = np.nonzero(mask)
    r0, r1, c0, c1 = r.min(), r.max() + 1, c.min(), c.max() + 1
    part = delineation.largest_part(mask[r0:r1, c0:c1])
    band = np.where(part, grid[r0:r1, c0:c1], np.nan)
    west, north = west + c0 * cell, north - r0 * cell
    east, south = west + band.shape[1] * cell, north - band.shape[0] * cell
    meta = {
        "rows": band.shape[0], "cols": band.shape[1], "bounds": {"west": west, "south": south, "east": east, "north": north}, "cell_deg": cell,
        "m_per_deg_lon": geo.M_PER_DEG_LON * float(np.cos(np.radians((north + south) / 2))), "m_per_deg_lat": geo.M_PER_DEG_LAT,
        "z_min": float(np.nanmin(band)), "z_max": float(np.nanmax(band)), "z_min_tile": float(span[0]), "z_max_tile": float(span[1]),
        "n_valid": int(part.sum()), "z_exaggeration": exaggeration,
    }
    return band, meta


def png(pixels: np.ndarray) -> bytes:
    """Rows x columns x 4 bytes as a PNG image."""
    rows, cols, _ = pixels.shape
    raw = np.concatenate([np.zeros((rows, 1), dtype=np.uint8), pixels.reshape(rows, cols * 4)], axis=1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 9)) + part(b"IEND", b"")


def height_pixels(band: np.ndarray, meta: dict) -> np.ndarray:
    """Red and green: low and high byte of the height over the tile's range; blue: relief; alpha: 255 inside."""
    valid = ~np.isnan(band)
    span = max(meta["z_max_tile"] - meta["z_min_tile"], 1e-9)
    share = np.clip((np.where(valid, band, meta["z_min_tile"]) - meta["z_min_tile"]) / span, 0, 1)
    q = np.where(valid, np.round(share * 65535), 0).astype(np.uint16)
    lit = shaded(band, meta["cell_deg"] * meta["m_per_deg_lon"], meta["cell_deg"] * meta["m_per_deg_lat"])
    shade = np.where(valid, np.round(composed(lit["hillshade"], lit["slope"]) * 255), 0)
    return np.stack([q & 255, q >> 8, shade, np.where(valid, 255, 0)], axis=2).astype(np.uint8)


def draped(lines: list[np.ndarray], meta: dict) -> list[list[list[float]]]:
    """Lines with a vertex a cell or closer, as shares (u, v) of the box from its south-west corner; what is far outside goes."""
    b, out = meta["bounds"], []
    for line in lines:
        dense = [line[:1]]
        for p, q in zip(line[:-1], line[1:], strict=True):
            n = max(1, int(np.hypot(*(q - p)) / meta["cell_deg"] + 1e-9))
            dense.append(p + (q - p) * (np.arange(1, n + 1) / n)[:, None])
        at = np.concatenate(dense)
        u, v = (at[:, 0] - b["west"]) / (b["east"] - b["west"]), (at[:, 1] - b["south"]) / (b["north"] - b["south"])
        ok = (u >= -MARGIN) & (u <= 1 + MARGIN) & (v >= -MARGIN) & (v <= 1 + MARGIN)
        if ok.sum() >= 2:
            out.append([[round(float(x), DECIMALS), round(float(y), DECIMALS)] for x, y in zip(u[ok], v[ok], strict=True)])
    return out


def contour_lines(band: np.ndarray, meta: dict) -> tuple[list, list]:
    """Contours as (u, v) lines: the usual ones, and those of whole ``INDEX_M`` metres."""
    rows, cols = band.shape
    usual, strong = [], []
    first = np.floor(meta["z_min"] / INTERVAL_M) * INTERVAL_M + INTERVAL_M
    for level in np.arange(first, meta["z_max"], INTERVAL_M):
        for line in kernels.chains(kernels.contours(band, level)):
            at = [[round(float(c) / max(cols - 1, 1), DECIMALS), round(1 - float(r) / max(rows - 1, 1), DECIMALS)] for r, c in line]
            (strong if round(level) % INDEX_M == 0 else usual).append(at)
    return usual, strong


def flat(lines: list) -> list:
    """All numbers of all lines in one list; two nulls end each line."""
    return [x for line in lines for x in [*(n for p in line for n in p), None, None]]


def payload(grid: np.ndarray, rings: list[np.ndarray], streams: list[np.ndarray], west: float, north: float, cell: float, span: tuple[float, float], exaggeration: float = 1.0, colours: np.ndarray | None = None) -> dict:
    """All that a viewer needs of one river's terrain; ``colours``: red, green and blue of the grid's cells, NaN where unknown."""
    band, meta = clip(grid, rings, west, north, cell, span, exaggeration=exaggeration)
    usual, strong = contour_lines(band, meta)
    link = lambda pixels: "data:image/png;base64," + base64.b64encode(png(pixels)).decode("ascii")
    made = {"meta": meta, "heightmap": link(height_pixels(band, meta)), "streams": draped(streams, meta), "contours_minor": flat(usual), "contours_index": flat(strong)}
    if colours is not None:
        r, c = round((north - meta["bounds"]["north"]) / cell), round((meta["bounds"]["west"] - west) / cell)
        part, inside = colours[r : r + band.shape[0], c : c + band.shape[1]], ~np.isnan(band)
        if not np.isnan(part[inside]).any():
            shown = np.where(np.isnan(part), 255, np.round(part))
            made["basemap"] = link(np.concatenate([shown, np.full((*inside.shape, 1), 255.0)], axis=2).astype(np.uint8))
    return made


def warp(image: np.ndarray, bounds: tuple[float, float, float, float], box: dict, rows: int, cols: int) -> np.ndarray:
    """An image in Mercator ``bounds`` (west, south, east, north, in metres) resampled to a grid of degrees."""
    radius = 6378137.0
    lon = box["west"] + (np.arange(cols) + 0.5) / cols * (box["east"] - box["west"])
    lat = box["north"] - (np.arange(rows) + 0.5) / rows * (box["north"] - box["south"])
    x, y = np.radians(lon) * radius, np.arcsinh(np.tan(np.radians(lat))) * radius
    west, south, east, north = bounds
    c = (x - west) / (east - west) * image.shape[1] - 0.5
    r = (north - y) / (north - south) * image.shape[0] - 0.5
    rr, cc = np.meshgrid(r, c, indexing="ij")
    return np.stack([kernels.bilinear(image[..., k].astype(float), rr, cc) for k in range(image.shape[2])], axis=2)
