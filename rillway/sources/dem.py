"""Elevation tiles of one degree: which ones a box needs, their names, and a mosaic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tile_grid(boxes: DataFrame) -> DataFrame:
    """``lat``, ``lon`` of the south-west corners of all tiles that ``west``, ``south``, ``east``, ``north`` touch."""
    span = lambda lo, hi: F.sequence(F.floor(lo).cast("int"), F.greatest(F.ceil(hi).cast("int") - 1, F.floor(lo).cast("int")))
    lat = boxes.withColumn("lat", F.explode(span(F.col("south"), F.col("north"))))
    return lat.withColumn("lon", F.explode(span(F.col("west"), F.col("east"))))


def tile_name(tiles: DataFrame) -> DataFrame:
    """Adds ``tile``, such as N42_00_W002_00."""
    ns, ew = F.when(F.col("lat") >= 0, "N").otherwise("S"), F.when(F.col("lon") >= 0, "E").otherwise("W")
    return tiles.withColumn("tile", F.format_string("%s%02d_00_%s%03d_00", ns, F.abs("lat"), ew, F.abs("lon")))


def mosaic(cells: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Cells (``tile``, ``lon``, ``lat``, ``z``) in a box; where tiles overlap the first by name counts."""
    inside = cells.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    first = Window.partitionBy("lon", "lat").orderBy("tile")
    return inside.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
