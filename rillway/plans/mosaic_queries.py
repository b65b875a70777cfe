"""Queries on boxes over a terrain of tiles: mosaics, catchments searched in them, drawn terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillway.operators import courses as K
from rillway.operators import delineate as D
from rillway.operators import mosaic as M
from rillway.plans.views import CELL, view
from rillway.sources import basemap

#: The valley's cells in tiles of 16 rows and 25 columns, each with two more columns than it should, which lie higher in the second tile.
TILE_CELL = f"""
SELECT concat(CAST(floor(r / 16) AS INT), '_', t) AS tile, CAST(r % 16 AS INT) AS r, CAST(c - 25 * t AS INT) AS c, z + t / 2.0D AS z
FROM ({CELL}) JOIN (SELECT 0 AS t UNION ALL SELECT 1 AS t) ON c >= 25 * t AND c < 25 * t + 27
"""
#: Boxes of the suppliers, in degrees; the terrain's corner is at 0 east, 43 north, its cells a thousandth wide.
BOX = """
SELECT concat('V', s_suppkey) AS key, (s_suppkey % 40) * 0.001D + 0.0004D AS west, 43 - (s_suppkey % 31 + 8) * 0.001D - 0.0003D AS south,
 (s_suppkey % 40) * 0.001D + 0.0097D AS east, 43 - (s_suppkey % 31) * 0.001D + 0.0002D AS north FROM supplier
"""


def _tiles(spark, sf):
    """The tiles' cells, and a frame for each tile that has any."""
    cells = view(spark, sf, TILE_CELL)
    at = cells.select("tile").distinct().withColumns({"_r": F.split_part("tile", F.lit("_"), F.lit(1)).cast("int"), "_c": F.split_part("tile", F.lit("_"), F.lit(2)).cast("int")})
    return cells, at.select("tile", (F.col("_c") * 0.025).alias("west"), (43 - F.col("_r") * 0.016).alias("north"), F.lit(0.001).alias("cell"), F.lit(16).alias("rows"), F.lit(27).alias("cols"))


def q_mosaic(spark, sf):
    cells, frames = _tiles(spark, sf)
    found = M.mosaic(view(spark, sf, BOX), cells, frames)
    # Rows count from 43 degrees north again.
    return found.select("key", (F.col("r") + 43000).alias("r"), "c", "z")


def q_met(spark, sf):
    _, frames = _tiles(spark, sf)
    return M.met(view(spark, sf, BOX), frames)


def q_delineate(spark, sf):
    """Catchments of places in the valley, searched over thresholds in the mosaics of their boxes."""
    cells, frames = _tiles(spark, sf)
    places = view(spark, sf, "SELECT s_suppkey AS k FROM supplier").select(F.concat(F.lit("V"), "k").alias("river_id"), (0.0255 + (F.col("k") % 5) * 0.001).alias("lon"), (43.0 - 0.0005 - F.col("k") % 38 * 0.001).alias("lat"), F.lit(0.0).alias("offset_m"))
    tries = K.candidates(places, thresholds=(8, 20))
    lines = places.select("river_id", F.array(F.struct("lon", F.col("lat").alias("lat")), F.struct("lon", (F.col("lat") - 0.002).alias("lat"))).alias("line"))
    boxes = places.select("river_id", F.lit(0.0).alias("west"), (F.col("lat") - 0.02).alias("south"), F.lit(0.05).alias("east"), (F.col("lat") + 0.02).alias("north"))
    return D.delineate(cells, frames, tries, lines, boxes).select("river_id", "source", F.round("area_km2", 6).alias("area_km2"), "n_cells", F.round("frac", 6).alias("frac"), "threshold", "note", "error")


def q_payload(spark, sf):
    """The drawn terrain of a rectangle in each supplier's box: cells drawn, their heights' range, and the whole box's."""
    cells, frames = _tiles(spark, sf)
    boxes = view(spark, sf, BOX)
    corner = lambda x, y: F.struct((F.col("_w") + x).alias("lon"), (F.col("_n") - y).alias("lat"))
    at = boxes.withColumns({"_w": F.col("west") - 0.0004 + 0.003, "_n": F.col("north") - 0.0002 - 0.003})
    ring = F.array(F.array(corner(0.0, 0.0), corner(0.004, 0.0), corner(0.004, 0.003), corner(0.0, 0.003), corner(0.0, 0.0)))
    rivers = at.select(F.col("key").alias("river_id"), ring.alias("rings"), "west", "south", "east", "north")
    streams = at.select(F.col("key").alias("river_id"), F.array(corner(0.002, 0.0), corner(0.002, 0.003)).alias("line"))
    made = D.payloads(cells, frames, rivers, streams)
    meta = lambda k, kind: F.get_json_object("payload", f"$.meta.{k}").cast(kind).alias(k)
    return made.select("river_id", meta("n_valid", "long"), meta("z_min", "double"), meta("z_max", "double"), meta("z_min_tile", "double"), meta("z_max_tile", "double"))


#: The valley as an image at zoom 12, from a pixel near 0 east and 43 north on.
_ZOOM, _ROW, _COLUMN = 12, 384000, 524288
_SPOT = "SELECT s_suppkey AS k, (s_suppkey * 37 % 331) / 10.0D AS v, (s_suppkey * 53 % 452) / 10.0D AS u FROM supplier"


def q_coloured(spark, sf):
    """Places between an image's pixels take their colour from the four around each."""
    z = F.col("z").cast("int")
    pixels = view(spark, sf, CELL).select(F.lit(_ZOOM).alias("zoom"), (F.col("r") + _ROW).alias("y"), (F.col("c") + _COLUMN).alias("x"), (z % 256).alias("red"), (F.col("r") * 5).alias("green"), (F.col("c") * 5).alias("blue"))
    whole = 2.0**_ZOOM * basemap.SIDE
    lat = F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * (F.col("v") + _ROW + 0.5) / whole))))
    places = view(spark, sf, _SPOT).select("k", ((F.col("u") + _COLUMN + 0.5) / whole * 360 - 180).alias("lon"), lat.alias("lat"))
    return basemap.coloured(places, pixels, _ZOOM, ["k"]).select("k", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("red", "green", "blue")])


_DUCK = {k: v.replace("D AS", "::DOUBLE AS").replace("001D", "001::DOUBLE").replace("0.0004D", "0.0004::DOUBLE").replace("0.0003D", "0.0003::DOUBLE").replace("0.0097D", "0.0097::DOUBLE").replace("0.0002D", "0.0002::DOUBLE").replace("2.0D", "2.0::DOUBLE") for k, v in (("t", TILE_CELL), ("b", BOX))}
#: Which cells lie in a supplier's box, in whole cells; the first tile's height counts where two overlap.
_IN = f"""cell AS ({CELL}), spot AS (SELECT concat('V', s_suppkey) AS key, s_suppkey % 40 AS w, s_suppkey % 31 AS n FROM supplier),
mos AS (SELECT key, w, n, r, c, z + CASE WHEN c >= 27 THEN 0.5::DOUBLE ELSE 0 END AS z FROM spot JOIN cell ON c BETWEEN w AND w + 9 AND r BETWEEN n - 1 AND n + 8)"""

QUERIES = {
    "terrain_mosaic": (q_mosaic, f"WITH {_IN} SELECT key, r, c, z FROM mos"),
    "box_tiles": (q_met, f"""WITH tile AS (SELECT DISTINCT tile FROM ({_DUCK['t']})),
spread AS (SELECT tile, CAST(split_part(tile, '_', 1) AS INT) * 16 AS tr, CAST(split_part(tile, '_', 2) AS INT) * 25 AS tc FROM tile),
spot AS (SELECT concat('V', s_suppkey) AS key, s_suppkey % 40 AS w, s_suppkey % 31 AS n FROM supplier),
b AS (SELECT key, tile, CAST(greatest(n - 1 - tr, 0) AS INT) AS r0, CAST(least(n + 8 - tr, 15) AS INT) AS r1, CAST(greatest(w - tc, 0) AS INT) AS c0, CAST(least(w + 9 - tc, 26) AS INT) AS c1 FROM spot CROSS JOIN spread)
SELECT key, tile, r0, r1, c0, c1 FROM b WHERE r0 <= r1 AND c0 <= c1"""),
    "basemap_warp": (q_coloured, f"""WITH cell AS ({CELL}), p AS (SELECT k, v, u, floor(v) AS i, floor(u) AS j FROM ({_SPOT.replace('10.0D', '10.0::DOUBLE')})),
q AS (SELECT k, CASE WHEN r = i THEN 1 - (v - i) ELSE v - i END * CASE WHEN c = j THEN 1 - (u - j) ELSE u - j END AS w, r, c, CAST(z AS BIGINT) % 256 AS red FROM p JOIN cell ON r BETWEEN i AND i + 1 AND c BETWEEN j AND j + 1)
SELECT k, round(sum(w * red) + 1e-7::DOUBLE, 4) AS red, round(sum(w * r * 5) + 1e-7::DOUBLE, 4) AS green, round(sum(w * c * 5) + 1e-7::DOUBLE, 4) AS blue FROM q GROUP BY k HAVING count(*) = 4"""),
    "delineate_search": (q_delineate, None),
    "terrain_payload": (q_payload, f"""WITH {_IN}, m AS (SELECT key, min(z) AS z_min_tile, max(z) AS z_max_tile FROM mos GROUP BY key),
core AS (SELECT key, n + 3 + i AS r, w + 3 + j AS c FROM spot, (SELECT unnest(range(3)) AS i), (SELECT unnest(range(4)) AS j)),
near AS (SELECT DISTINCT k.key, k.r + i AS r, k.c + j AS c FROM core k, (SELECT unnest(range(-6, 7)) AS i), (SELECT unnest(range(-6, 7)) AS j) WHERE i * i + j * j <= 36),
drawn AS (SELECT key, r, c, z + CASE WHEN c >= 27 THEN 0.5::DOUBLE ELSE 0 END AS z FROM near JOIN cell USING (r, c))
SELECT key AS river_id, count(*) AS n_valid, min(z) AS z_min, max(z) AS z_max, any_value(z_min_tile) AS z_min_tile, any_value(z_max_tile) AS z_max_tile FROM drawn JOIN m USING (key) GROUP BY key"""),
}
