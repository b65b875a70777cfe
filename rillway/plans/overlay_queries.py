"""Queries on unions of sub-basins that overlap, and on rings that cross themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillway.operators import overlay, watershed
from rillway.operators import rivers as R
from rillway.plans.river_queries import network
from rillway.plans.tables import written
from rillway.plans.terrain_queries import _MEM
from rillway.plans.views import BASIN, view

#: A ring of a figure of two loops that cross, from a corner on.
_LOOPS = [(0, 0), (2, 0), (2, 2), (1, 2), (1, 1), (3, 1), (3, 3), (0, 3)]
#: The unit cells that it encloses an odd number of times.
_LOOP_CELLS = [(0, 0), (1, 0), (0, 1), (2, 1), (0, 2), (1, 2), (2, 2)]


def _overlapping(spark, sf):
    """The sub-basins as squares of one to three cells a side, which overlap; every eleventh is a ring that crosses itself."""
    b = view(spark, sf, BASIN)
    ring = lambda points: F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in [*points, points[0]]])
    n = (F.col("basin") % 3 + 1).cast("int")
    square = ring([(F.lit(0), F.lit(0)), (n, F.lit(0)), (n, n), (F.lit(0), n)])
    return b.withColumn("rings", F.array(F.when(F.col("basin") % 11 == 0, ring([(F.lit(i), F.lit(j)) for i, j in _LOOPS])).otherwise(square)))


def _unions(spark, sf):
    basins = _overlapping(spark, sf)
    members = watershed.membership(basins, R.downstream(network(spark, sf), basins), network(spark, sf).rivers)
    return overlay.union_edges(members, overlay.cover(basins))


def q_union(spark, sf):
    edges = written(_unions(spark, sf))
    long_ = edges.groupBy("river_id").agg(F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).cast("long").alias("boundary"))
    return overlay.union_areas(edges).join(long_, "river_id").select("river_id", F.round("area").cast("long").alias("area"), "boundary")


def q_repaired(spark, sf):
    """The boundary of each sub-basin by itself, as repaired."""
    basins = _overlapping(spark, sf)
    edges = overlay.repaired(basins)
    return overlay.union_areas(edges).select(F.col("river_id").cast("long").alias("basin"), F.round("area", 6).alias("area"))


_OFFSETS = ", ".join(f"({i}, {j})" for i, j in _LOOP_CELLS)
_FILLED = f"""SELECT DISTINCT m.river_id, m.x + o.i AS x, m.y + o.j AS y FROM mem m JOIN (
  SELECT k, i, j FROM (SELECT unnest([1, 2, 3]) AS k), (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1, 2]) AS j) WHERE i < k AND j < k
  UNION ALL SELECT 0, i, j FROM (VALUES {_OFFSETS}) v(i, j)) o ON o.k = CASE WHEN m.basin % 11 = 0 THEN 0 ELSE m.basin % 3 + 1 END"""

QUERIES = {
    "basin_union": (q_union, f"""{_MEM}, filled AS ({_FILLED}), side AS (SELECT f.river_id, count(*) AS n FROM filled f CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy)
  WHERE NOT EXISTS (SELECT 1 FROM filled g WHERE g.river_id = f.river_id AND g.x = f.x + d.dx AND g.y = f.y + d.dy) GROUP BY f.river_id)
SELECT river_id, count(*) AS area, any_value(n) AS boundary FROM filled JOIN side USING (river_id) GROUP BY river_id"""),
    "basin_repair": (q_repaired, f"SELECT basin, CASE WHEN basin % 11 = 0 THEN {len(_LOOP_CELLS)}.0::DOUBLE ELSE CAST((basin % 3 + 1) * (basin % 3 + 1) AS DOUBLE) END AS area FROM ({BASIN})"),
}
