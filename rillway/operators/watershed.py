"""Drainage sub-basins: membership, area, dissolve by edge parity, and which catchment counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.operators.rivers import upstream_sums

AREA_MIN, AREA_MAX, MIN_BOX_DEG = 5.0, 150.0, 0.003


def membership(basins: DataFrame, closed: DataFrame, rivers: DataFrame) -> DataFrame:
    """Each river with the sub-basins of itself and of all rivers upstream."""
    every = rivers.select("river_id", F.col("river_id").alias("_of")).unionByName(closed.select("river_id", F.col("ancestor").alias("_of")))
    own = basins.filter("river_id is not null and trim(river_id) <> ''").withColumnRenamed("river_id", "_of")
    return every.join(own, "_of").drop("_of")


def areas(members: DataFrame, area: str = "area_km2") -> DataFrame:
    """Drainage area and number of sub-basins of a river, for sub-basins that don't overlap."""
    return members.groupBy("river_id").agg(F.round(F.sum(area), 1).alias("area_km2"), F.count(F.lit(1)).alias("n_sub_basins"))


def drainage_areas(rivers: DataFrame, links: DataFrame, basins: DataFrame, area: str = "area_km2") -> DataFrame:
    """As ``areas`` of ``membership``, without the pairs of rivers: a sum over each river's tree, and what forks add to it."""
    own = basins.filter("river_id is not null and trim(river_id) <> ''").groupBy("river_id").agg(F.sum(area).alias("area_km2"), F.count(F.lit(1)).alias("n_sub_basins"))
    sums = upstream_sums(rivers, links, own, ["area_km2", "n_sub_basins"]).filter("n_sub_basins > 0")
    return sums.select("river_id", F.round("area_km2", 1).alias("area_km2"), "n_sub_basins")


def dissolve_edges(members: DataFrame, ring: str = "ring") -> DataFrame:
    """Boundary edges of the union of abutting polygons: those that an odd number of rings have.

    ``ring``: closed array of structs with ``x`` and ``y``. An inner edge belongs to two rings.
    """
    n = F.size(ring)
    pairs = F.arrays_zip(F.slice(ring, 1, n - 1).alias("a"), F.slice(ring, 2, n - 1).alias("b"))
    e = members.select("river_id", F.explode(pairs).alias("e"))
    flat = e.select("river_id", F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b"))
    return flat.groupBy("river_id", "a", "b").agg(F.count(F.lit(1)).alias("_n")).filter("_n % 2 = 1").select("river_id", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def precedence(rivers: DataFrame, measured: DataFrame, cache: DataFrame, low: float = AREA_MIN, high: float = AREA_MAX) -> DataFrame:
    """Which catchment a river shows: the sub-basins' if their area is in range, else the terrain's."""
    j = rivers.select("river_id").join(measured.select("river_id", "area_km2"), "river_id", "left").join(cache.select("river_id", "source", F.col("area_km2").alias("dem_km2")), "river_id", "left")
    from_basins = F.col("area_km2").between(low, high)
    from_dem = F.coalesce(F.col("source") == "dem", F.lit(False))
    return j.select("river_id", F.when(from_basins, "basins").when(from_dem, "dem").alias("shown"), F.when(from_basins, F.col("area_km2")).when(from_dem, F.col("dem_km2")).alias("km2"))


def never_gets_catchment(rivers: DataFrame, measured: DataFrame, cache: DataFrame) -> DataFrame:
    """Headwaters without sub-basins that the batch has discarded or couldn't determine."""
    kids = rivers.filter("parent_id is not null").select(F.col("parent_id").alias("river_id")).distinct()
    out = cache.filter(F.col("source").isin("discarded", "undetermined"))
    return rivers.join(kids, "river_id", "left_anti").join(measured.select("river_id"), "river_id", "left_anti").join(out.select("river_id"), "river_id", "left_semi").select("river_id")


def area_gate(areas: DataFrame, low: float = AREA_MIN, high: float = AREA_MAX) -> DataFrame:
    """``dem`` for areas in range, both ends included, else ``discarded``."""
    return areas.withColumn("source", F.when(F.col("area_km2").between(low, high), "dem").otherwise("discarded"))


def too_narrow(west, south, east, north):
    """Boxes under ``MIN_BOX_DEG`` wide or high can't be delineated."""
    return ((east - west) < MIN_BOX_DEG) | ((north - south) < MIN_BOX_DEG)
