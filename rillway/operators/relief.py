"""Relief of a terrain table (``r``, ``c``, ``z``, and any tile columns): gradients, light, shadows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where light comes from unless told otherwise, and the weight of slope.
AZIMUTH, ALTITUDE, SLOPE_WEIGHT = 315.0, 45.0, 0.55


def sun(azimuth: float = AZIMUTH, altitude: float = ALTITUDE) -> tuple[float, float, float]:
    """East, north and up parts of the unit vector towards the sun."""
    az, alt = math.radians(azimuth), math.radians(altitude)
    return math.sin(az) * math.cos(alt), math.cos(az) * math.cos(alt), math.sin(alt)


def _slope(z: str, keys: list[str], along: str, cell: float) -> Column:
    """Central difference inside, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy(along)
    before, after = F.lag(z).over(w), F.lead(z).over(w)
    span = F.when(before.isNotNull() & after.isNotNull(), 2.0).otherwise(1.0)
    return (F.coalesce(after, F.col(z)) - F.coalesce(before, F.col(z))) / (span * cell)


def gradient(cells: DataFrame, cell: float = 20.0, tile: list[str] | None = None) -> DataFrame:
    """``dx``: rise to the east; ``dy``: rise to the north (row 0 is north)."""
    t = tile or []
    return cells.withColumn("dx", _slope("z", [*t, "r"], "c", cell)).withColumn("dy", -_slope("z", [*t, "c"], "r", cell))


def lit(graded: DataFrame, azimuth: float = AZIMUTH, altitude: float = ALTITUDE) -> DataFrame:
    """``hillshade``, ``slope`` (share of a right angle) and ``core`` (turned away from the sun)."""
    e, n, u = sun(azimuth, altitude)
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + 1)
    facing = (F.lit(u) - F.col("dx") * e - F.col("dy") * n) / size
    steep = F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))) / (math.pi / 2)
    return graded.withColumn("hillshade", F.greatest(F.lit(0.0), F.least(F.lit(1.0), facing))).withColumn("slope", steep).withColumn("core", facing <= 0)


def composed(shaded: DataFrame, weight: float = SLOPE_WEIGHT) -> DataFrame:
    """Hillshade mixed with flatness; weight 0 leaves the hillshade."""
    mix = (1 - weight) * F.col("hillshade") + weight * (1 - F.col("slope"))
    return shaded.withColumn("relief", F.col("hillshade") if weight == 0 else F.greatest(F.lit(0.0), F.least(F.lit(1.0), mix)))


def cast_shadow_east(cells: DataFrame, altitude: float, cell: float = 20.0, tile: list[str] | None = None) -> DataFrame:
    """Cells that higher ground to the east hides from a sun due east: one running maximum a row."""
    drop = cell * math.tan(math.radians(altitude))
    level = F.col("z") - F.col("c") * drop
    east = Window.partitionBy(*(tile or []), "r").orderBy("c").rowsBetween(1, Window.unboundedFollowing)
    return cells.withColumn("_l", level).withColumn("shadow", F.coalesce(F.max("_l").over(east) > F.col("_l"), F.lit(False))).drop("_l")


def box_blur(cells: DataFrame, radius: int, tile: list[str] | None = None) -> DataFrame:
    """Mean over a square of ``2 * radius + 1``, rows then columns; cells beyond the edge repeat the edge."""
    t, n = tile or [], 2 * radius + 1

    def pass_(df: DataFrame, value: str, along: str, across: str, out: str) -> DataFrame:
        w = Window.partitionBy(*t, across).orderBy(along)
        near = w.rowsBetween(-radius, radius)
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        k, size = F.row_number().over(w), F.count(F.lit(1)).over(every)
        low, high = F.greatest(F.lit(0), radius + 1 - k), F.greatest(F.lit(0), radius + k - size)
        total = F.sum(value).over(near) + low * F.first(value).over(every) + high * F.last(value).over(every)
        return df.withColumn(out, total / n)

    return pass_(pass_(cells, "z", "c", "r", "_rows"), "_rows", "r", "c", "blurred").drop("_rows")
