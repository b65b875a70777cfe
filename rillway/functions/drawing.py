"""What a viewer computes for each row: local metres, camera shots, tints, strokes, tile bounds, flat line buffers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillway.functions.geo import M_PER_DEG_LAT, M_PER_DEG_LON

#: The height tint's stops, from the lowest to the highest ground.
RAMP = [(0.00, (0.86, 0.88, 0.79)), (0.25, (0.90, 0.90, 0.82)), (0.55, (0.93, 0.91, 0.84)), (0.82, (0.92, 0.90, 0.86)), (1.00, (0.95, 0.95, 0.94))]
#: Width and colour of a river's stroke in the tree, from order 1 to 7 and more.
STROKES = [(1.1, "#9db8d0"), (1.4, "#7ba3c9"), (1.8, "#5b8bbf"), (2.3, "#3f74af"), (2.8, "#2f6096"), (3.4, "#244d7c"), (4.0, "#1c3e63")]
#: How a stroke on the map grows with the order, and what each state of a river makes of it.
MAP_WIDTH, MAP_STEP, MAP_LEAST = 1.1, 0.7, 2.2
BOOST = {"selected": 1.7, "preview": 1.5, "upstream": 1.25}
#: Fixed value: the radius of the Web Mercator sphere.
RADIUS = 6378137.0
#: Fixed value: how far outside its box, in shares of it, a draped line is kept.
MARGIN = 0.05


def local_xz(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """Metres east and south of a box's middle."""
    mid = (south + north) / 2
    return (lon - (west + east) / 2) * M_PER_DEG_LON * F.cos(F.radians(mid)), (mid - lat) * M_PER_DEG_LAT


def world_scale(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The longer side of a box in metres."""
    return F.greatest((east - west) * M_PER_DEG_LON * F.cos(F.radians((south + north) / 2)), (north - south) * M_PER_DEG_LAT)


def camera_shot(ox: Column, oz: Column, ex: Column, ez: Column, size: Column, camera: Column | None = None) -> dict[str, Column]:
    """Where a camera stands and looks: ``x``, ``y``, ``z``, ``target_y``; it looks at (``ox``, ``oz``).

    ``camera`` (``azimuth_deg``, ``elevation_deg``, ``distance_m``, ``target_height_m``) is a set
    shot; without one the camera stands behind the outlet (``ex``, ``ez``), on the line to the middle.
    """
    long_ = F.hypot(ox - ex, oz - ez)
    long_ = F.when(long_ > 0, long_).otherwise(1.0)
    own = {"x": ex - (ox - ex) / long_ * size * 0.15, "y": size * 0.28, "z": ez - (oz - ez) / long_ * size * 0.15, "target_y": size * 0.28 * 0.12}
    if camera is None:
        return own
    turn, up = F.radians(F.coalesce(camera["azimuth_deg"], F.lit(0.0))), F.radians(F.coalesce(camera["elevation_deg"], F.lit(20.0)))
    far, target = F.coalesce(camera["distance_m"], size * 0.6), F.coalesce(camera["target_height_m"], size * 0.03)
    flat = far * F.cos(up)
    set_ = {"x": ox + flat * F.sin(turn), "y": target + far * F.sin(up), "z": oz + flat * F.cos(turn), "target_y": target}
    return {k: F.when(camera.isNotNull(), set_[k]).otherwise(own[k]) for k in own}


def height_tint(share: Column) -> list[Column]:
    """Red, green and blue of a height's share of the range, linear between the stops."""
    out = []
    for k in range(3):
        tint = F.lit(RAMP[-1][1][k])
        for (a, low), (b, high) in reversed(list(zip(RAMP, RAMP[1:], strict=False))):
            tint = F.when(share <= b, low[k] + (high[k] - low[k]) * (share - a) / (b - a)).otherwise(tint)
        out.append(tint)
    return out


def tree_stroke(order: Column) -> tuple[Column, Column]:
    """Width and colour of a river in the tree; no order counts as the first."""
    at = F.greatest(F.lit(1), F.least(F.lit(len(STROKES)), F.coalesce(order, F.lit(1)))).cast("int")
    return F.element_at(F.array(*[F.lit(w) for w, _ in STROKES]), at), F.element_at(F.array(*[F.lit(c) for _, c in STROKES]), at)


def map_width(order: Column, state: Column | None = None) -> Column:
    """Width of a river on the map, more for one in a state of ``BOOST``."""
    width = MAP_WIDTH + MAP_STEP * (F.least(F.lit(7), F.greatest(F.coalesce(order, F.lit(1)), F.lit(1))) - 1)
    if state is None:
        return width
    shown = width
    for name, boost in BOOST.items():
        shown = F.when(state == name, F.greatest(width * boost, F.lit(MAP_LEAST))).otherwise(shown)
    return shown


def tile_block_bounds(x0: Column, y0: Column, x1: Column, y1: Column, zoom: Column) -> list[Column]:
    """West, south, east and north, in Mercator metres, of the tiles from (x0, y0) to (x1, y1), both included."""
    turn = 2 * math.pi * RADIUS / F.pow(F.lit(2.0), zoom)
    half = math.pi * RADIUS
    return [x0 * turn - half, half - (y1 + 1) * turn, (x1 + 1) * turn - half, half - y0 * turn]


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator metres."""
    return F.radians(lon) * RADIUS, F.asinh(F.tan(F.radians(lat))) * RADIUS


def flat_with_breaks(lines: Column) -> Column:
    """Lines of (u, v) as one array ``u, v, u, v, ..., null, null, ...``; two nulls end each line."""
    numbers = F.flatten(F.transform(lines, lambda line: F.concat(F.flatten(F.transform(line, lambda p: F.array(p["u"], p["v"]))), F.array(F.lit(None).cast("double"), F.lit(None).cast("double")))))
    return numbers


def inside(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring of structs (lon, lat), by the parity of the edges east of it."""
    n = F.size(ring)
    edges = F.arrays_zip(F.slice(ring, 1, n - 1).alias("a"), F.slice(ring, 2, n - 1).alias("b"))

    def east(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (a["lon"] + (lat - a["lat"]) / (b["lat"] - a["lat"]) * (b["lon"] - a["lon"]) > lon)

    return F.size(F.filter(edges, east)) % 2 == 1


def draped(line: Column, west: Column, south: Column, east: Column, north: Column, cell: float) -> Column:
    """A line's points, a cell or less apart, as structs (``u``, ``v``): shares of a box from its south-west corner; those far outside go."""
    n = lambda a, b: F.greatest(F.lit(1), F.floor(F.hypot(b["lon"] - a["lon"], b["lat"] - a["lat"]) / cell + 1e-9).cast("int"))
    pairs = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    share = lambda x, y: F.struct(F.round((x - west) / (east - west), 5).alias("u"), F.round((y - south) / (north - south), 5).alias("v"))
    between = lambda e, k: share(e["a"]["lon"] + (e["b"]["lon"] - e["a"]["lon"]) * k / n(e["a"], e["b"]), e["a"]["lat"] + (e["b"]["lat"] - e["a"]["lat"]) * k / n(e["a"], e["b"]))
    dense = F.flatten(F.transform(pairs, lambda e: F.transform(F.sequence(F.lit(1), n(e["a"], e["b"])), lambda k: between(e, k))))
    whole = F.concat(F.array(share(F.get(line, F.lit(0))["lon"], F.get(line, F.lit(0))["lat"])), dense)
    return F.filter(whole, lambda p: p["u"].between(-MARGIN, 1 + MARGIN) & p["v"].between(-MARGIN, 1 + MARGIN))
