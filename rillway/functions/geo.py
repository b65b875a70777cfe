"""Geometry as column expressions: Lambert-93, lengths, areas, tiles. Lines are arrays of (lon, lat)."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constants of Lambert-93 (EPSG:2154) and metres in a degree.
N, C, XS, YS, E, LON0 = 0.7256077650532670, 11754255.426096, 700000.0, 12655612.049876, 0.08181919104281579, 3.0
M_PER_DEG_LON, M_PER_DEG_LAT = 111320.0, 110540.0


def lambert93(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Planar easting and northing in metres."""
    s = F.sin(F.radians(lat))
    iso = F.atanh(s) - E * F.atanh(E * s)
    r, turn = C * F.exp(-N * iso), N * F.radians(lon - LON0)
    return XS + r * F.sin(turn), YS - r * F.cos(turn)


def lambert93_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of planar metres, by five rounds of the latitude's fixed point."""
    dx, dy = x - XS, YS - y
    iso = -F.log(F.sqrt(dx * dx + dy * dy) / C) / N
    phi = F.asin(F.tanh(iso))
    for _ in range(5):
        phi = F.asin(F.tanh(iso + E * F.atanh(E * F.sin(phi))))
    return LON0 + F.degrees(F.atan2(dx, dy)) / N, F.degrees(phi)


def line_length(line: Column) -> Column:
    """Planar metres of an array of structs with ``lon`` and ``lat``."""
    def xy(p: Column) -> Column:
        x, y = lambert93(p["lon"], p["lat"])
        return F.struct(x.alias("x"), y.alias("y"))

    pts = F.transform(line, xy)
    pairs = F.arrays_zip(F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))).alias("a"), F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))).alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda t, p: t + F.hypot(p["a"]["x"] - p["b"]["x"], p["a"]["y"] - p["b"]["y"]))


def numbered_points(lines: Column) -> Column:
    """All points of an array of lines in one array, each with its line's number, as ``kernels.parts`` takes them: lines of unequal lengths don't pass to a task as nested arrays."""
    return F.flatten(F.transform(lines, lambda line, k: F.transform(line, lambda p: F.struct(k.alias("k"), p["lon"].alias("lon"), p["lat"].alias("lat")))))


def ring_area_km2(ring: Column) -> Column:
    """Planar area of a closed ring of structs with ``lon`` and ``lat``."""
    def xy(p: Column) -> Column:
        x, y = lambert93(p["lon"], p["lat"])
        return F.struct(x.alias("x"), y.alias("y"))

    pts = F.transform(ring, xy)
    pairs = F.arrays_zip(F.slice(pts, 1, F.size(pts) - 1).alias("a"), F.slice(pts, 2, F.size(pts) - 1).alias("b"))
    twice = F.aggregate(pairs, F.lit(0.0), lambda t, p: t + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])
    return F.abs(twice) / 2e6


def tile_xy(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """Web Mercator tile column and row, kept inside the grid."""
    n = F.pow(F.lit(2.0), zoom)
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * n)
    last = n - 1
    return F.greatest(F.lit(0), F.least(x, last)).cast("long"), F.greatest(F.lit(0), F.least(y, last)).cast("long")


def pick_zoom(west: Column, south: Column, east: Column, north: Column, target_px: int, most: int = 64) -> Column:
    """The largest zoom from 16 to 5 whose tiles over a box number at most ``most`` and reach ``target_px`` (or any, up to 6); else 6."""
    def fits(z: Column) -> Column:
        x0, y0 = tile_xy(west, north, z)
        x1, y1 = tile_xy(east, south, z)
        nx, ny = x1 - x0 + 1, y1 - y0 + 1
        return (nx * ny <= most) & ((F.greatest(nx, ny) * 256 >= target_px) | (z <= 6))

    return F.coalesce(F.get(F.filter(F.sequence(F.lit(16), F.lit(5), F.lit(-1)), fits), F.lit(0)), F.lit(6))


def padded_bbox(west: Column, south: Column, east: Column, north: Column, lon: Column, lat: Column) -> list[Column]:
    """A box widened by 15 % on all sides and 10 % more on those away from the outlet."""
    w, h = F.greatest(east - west, F.lit(1e-4)), F.greatest(north - south, F.lit(1e-4))
    more = lambda far: F.when(far, 0.25).otherwise(0.15)
    mid_x, mid_y = (west + east) / 2, (south + north) / 2
    return [west - w * more(lon > mid_x), south - h * more(lat > mid_y), east + w * more(lon <= mid_x), north + h * more(lat <= mid_y)]


def point_segment_m(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment, in the units of its coordinates."""
    dx, dy = x2 - x1, y2 - y1
    d2 = dx * dx + dy * dy
    t = F.when(d2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / d2))).otherwise(0.0)
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def _ascii_of() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition leaves in ASCII of each character of the Latin, phonetic,
    letter-like and form blocks: characters that leave one, these, and the others with what they leave."""
    one, left, more = [], [], {}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x2190), *range(0x2460, 0x2500), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append(chr(code))
            left.append(plain)
        elif plain:
            more[chr(code)] = plain
    return "".join(one), "".join(left), more


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits joined by single hyphens; accented and composed letters are decomposed."""
    one, left, more = _ascii_of()
    plain = F.translate(text, one, left)
    rare = plain
    for char, ascii_ in more.items():
        rare = F.replace(rare, F.lit(char), F.lit(ascii_))
    plain = F.when(plain.rlike("[^\\x00-\\x7f]"), rare).otherwise(plain)
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(plain, "[^\\x00-\\x7f]", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
